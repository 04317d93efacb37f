"""The query specification: what a question asks, as plain data, and its validation against the dictionary.

A specification names one of three sources (entities, events, series), filters, elapsed-time conditions, computed
values, moving windows, grouping with date buckets, measures, conditions on groups, an order and a limit.
``parse`` reads it from a dict; ``problems`` lists what the dictionary does not allow.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, fields
from dataclasses import field as made
from typing import Any

from recordweave.plans.reltime import is_token

SOURCES = ("entities", "events", "series")
MODES = ("count", "list", "aggregate")
COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")
OPERATORS = (*COMPARISONS, "exists", "missing", "contains", "name_is", "reached")
BUCKETS = ("none", "day", "week", "month", "year")
AGGREGATES = ("count", "sum", "avg", "min", "max", "median", "first", "last", "change", "change_pct")
SPAN_AGGREGATES = ("sum", "avg", "min", "max", "median")
UNITS = ("hours", "days", "weeks")
EXPRESSIONS = ("add", "sub", "mul", "div")
LIST_OPERATORS = ("eq", "ne", "reached")
MAX_ROWS = 1000
_WORD = re.compile(r"[^\W\d]\w{0,40}")


class SpecError(ValueError):
    """A specification that cannot be read or is not allowed; ``problems`` lists why."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class FieldDef:
    type: str = "string"
    format: str | None = None
    enum: tuple[str, ...] = ()
    ref: str | None = None
    identifier: bool = False
    indexed: bool = False
    required: bool = False
    description: str = ""
    labels: dict[str, list[str]] = made(default_factory=dict, hash=False)
    implies: dict[str, list[str]] = made(default_factory=dict, hash=False)
    #: A date that is the day of an event: {"kind": "created"} or {"kind": "status_changed", "to": "viewed"}.
    event: dict[str, Any] | None = made(default=None, hash=False)
    #: Phrases that mean several enum values.
    groups: dict[str, list[str]] = made(default_factory=dict, hash=False)
    #: Stored but not registered: the whole field, or some of its values.
    draft: bool = False
    draft_values: tuple[str, ...] = ()

    @property
    def is_date(self) -> bool:
        return self.format in ("date", "date-time")

    @property
    def is_number(self) -> bool:
        return self.type in ("integer", "number")


@dataclass(frozen=True)
class TypeDef:
    """A record type (kind entity) or a series type: ``key`` fields, a ``time`` field and numeric measures."""

    name: str
    fields: dict[str, FieldDef]
    kind: str = "entity"
    key: tuple[str, ...] = ()
    time: str | None = None
    granularity: str = "day"
    version: int = 1
    description: str = ""
    keywords: tuple[str, ...] = ()
    #: The field a bare date refers to.
    default_date: str | None = None
    #: (other type, what connects them) and (vague word, how it is read by default).
    relations: tuple[tuple[str, str], ...] = ()
    vague: tuple[tuple[str, str], ...] = ()

    @property
    def measures(self) -> list[str]:
        return [n for n, f in self.fields.items() if n not in self.key and n != self.time and f.is_number]


EVENT_TYPE = TypeDef(
    "event",
    {
        "kind": FieldDef(enum=("created", "updated", "status_changed", "corrected", "retracted", "migrated")),
        "by": FieldDef(), "entity_type": FieldDef(), "entity_id": FieldDef(), "at": FieldDef(format="date-time"),
        "evidence": FieldDef(), "to": FieldDef(), "from": FieldDef(), "payload": FieldDef(), "recorded_at": FieldDef(format="date-time"), "target_event_id": FieldDef(),
    },
)


@dataclass
class Filter:
    field: str
    op: str
    value: Any = None


@dataclass
class GroupKey:
    field: str
    bucket: str = "none"


@dataclass
class EventRef:
    kind: str
    to: list[str] = made(default_factory=list)


@dataclass
class TimePoint:
    field: str | None = None
    event: EventRef | None = None
    today: bool = False
    as_dated: bool = False


@dataclass
class Span:
    start: TimePoint
    end: TimePoint


@dataclass
class Elapsed:
    start: TimePoint
    end: TimePoint
    unit: str
    op: str
    value: float


@dataclass
class Measure:
    name: str
    agg: str
    field: str | None = None
    span: Span | None = None
    unit: str | None = None
    where: list[Filter] = made(default_factory=list)
    elapsed: list[Elapsed] = made(default_factory=list)


@dataclass
class MovingWindow:
    name: str
    measure: str
    agg: str = "avg"
    size: int = 1
    unit: str = "points"


@dataclass
class Compare:
    measure: str
    op: str
    window: str | None = None
    value: float | None = None


@dataclass
class Value:
    name: str
    asof: dict[str, str] | None = None
    expr: dict[str, Any] | None = None
    span: Span | None = None
    unit: str | None = None


@dataclass
class Having:
    measure: str
    op: str
    value: float


@dataclass
class QuerySpec:
    entity_type: str
    source: str = "entities"
    mode: str = "list"
    filters: list[Filter] = made(default_factory=list)
    record_filters: list[Filter] = made(default_factory=list)
    elapsed: list[Elapsed] = made(default_factory=list)
    window: list[MovingWindow] = made(default_factory=list)
    compare: list[Compare] = made(default_factory=list)
    values: list[Value] = made(default_factory=list)
    group_by: list[GroupKey] = made(default_factory=list)
    measures: list[Measure] = made(default_factory=list)
    having: list[Having] = made(default_factory=list)
    list_fields: list[str] = made(default_factory=list)
    order_by: str | None = None
    order_by_event: EventRef | None = None
    descending: bool = False
    limit: int = 100
    interpretation: str = ""
    defaults_used: list[str] = made(default_factory=list)
    asks: dict[str, Any] | None = None


def is_date(value: object) -> bool:
    if not isinstance(value, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return False
    try:
        dt.date.fromisoformat(value)
    except ValueError:
        return False
    return True


def _build(cls: type, data: Any, where: str) -> Any:
    if isinstance(data, cls):
        return data
    if not isinstance(data, dict):
        raise SpecError([f"{where}: an object is needed"])
    known = {f.name for f in fields(cls)}
    if extra := sorted(set(data) - known):
        raise SpecError([f"{where}: unknown keys {extra}"])
    try:
        return cls(**data)
    except TypeError as e:
        raise SpecError([f"{where}: {e}"]) from None


def _filter(data: Any, where: str) -> Filter:
    f = _build(Filter, data, where)
    f.op = {"in": "eq", "not_in": "ne"}.get(f.op, f.op)
    return f


def _event(data: Any, where: str) -> EventRef:
    e = _build(EventRef, data, where)
    e.to = [] if e.to is None else [e.to] if isinstance(e.to, str) else list(e.to)
    return e


def _point(data: Any, where: str) -> TimePoint:
    p = _build(TimePoint, {"today": True} if data is None else data, where)
    if isinstance(p.event, dict):
        p.event = _event(p.event, f"{where}.event")
    return p


def _span(data: Any, where: str) -> Span:
    if isinstance(data, Span):
        return data
    return Span(_point(data.get("start"), f"{where}.start"), _point(data.get("end"), f"{where}.end"))


def _elapsed(data: Any, where: str) -> Elapsed:
    if isinstance(data, Elapsed):
        return data
    span = _span(data, where)
    return _build(Elapsed, {**data, "start": span.start, "end": span.end}, where)


def _measure(data: Any, where: str) -> Measure:
    if isinstance(data, Measure):
        return data
    data = dict(data)
    if data.get("agg") == "count_if":
        data["agg"] = "count"
    elif data.get("agg") == "avg_days_between":
        data |= {"agg": "avg", "unit": data.get("unit") or "days", "span": {"start": {"field": data.pop("field", None)}, "end": {"field": data.pop("field_end", None)}}}
    elif data.get("agg") == "avg_hours_between_events":
        data |= {"agg": "avg", "unit": data.get("unit") or "hours", "span": {"start": {"event": data.pop("event_from", None)}, "end": {"event": data.pop("event_to", None)}}}
    m = _build(Measure, data, where)
    m.where = [_filter(f, f"{where}.where") for f in m.where]
    m.elapsed = [_elapsed(e, f"{where}.elapsed") for e in m.elapsed]
    m.span = None if m.span is None else _span(m.span, f"{where}.span")
    return m


def _compare(data: Any, where: str) -> Compare:
    if isinstance(data, Compare):
        return data
    data = dict(data)
    data |= data.pop("baseline", {})
    return _build(Compare, data, where)


def _value(data: Any, where: str) -> Value:
    v = _build(Value, data, where)
    v.span = None if v.span is None else _span(v.span, f"{where}.span")
    return v


def parse(data: dict[str, Any]) -> QuerySpec:
    """Read a specification; older operator and aggregate names are accepted."""
    s = _build(QuerySpec, data, "spec")
    for name, one in (("filters", _filter), ("record_filters", _filter), ("elapsed", _elapsed), ("measures", _measure), ("compare", _compare), ("values", _value)):
        setattr(s, name, [one(x, f"{name}[{i}]") for i, x in enumerate(getattr(s, name))])
    for name, cls in (("window", MovingWindow), ("group_by", GroupKey), ("having", Having)):
        setattr(s, name, [_build(cls, x, f"{name}[{i}]") for i, x in enumerate(getattr(s, name))])
    if isinstance(s.order_by_event, dict):
        s.order_by_event = _event(s.order_by_event, "order_by_event")
    s.limit = 100 if s.limit is None else s.limit
    return s


class _Check:
    """Collects what is wrong with one specification."""

    def __init__(self, spec: QuerySpec, types: dict[str, TypeDef]) -> None:
        self.spec, self.types, self.errors = spec, types, []
        self.type = EVENT_TYPE if spec.source == "events" else types[spec.entity_type]
        self.values = {v.name: v for v in spec.values}

    def need(self, holds: bool, text: str) -> bool:
        if not holds:
            self.errors.append(text)
        return holds

    def filter(self, f: Filter, of: TypeDef, where: str) -> None:
        d = of.fields.get(f.field)
        if not self.need(f.op in OPERATORS, f"{where}: no operator {f.op!r}") or not self.need(d is not None, f"{where}: {of.name} has no field {f.field!r}"):
            return
        many = isinstance(f.value, list)
        self.need(not many or f.op in LIST_OPERATORS, f"{where}: {f.op} takes one value")
        self.need(not many or bool(f.value), f"{where}: an empty list matches nothing")
        if f.op in ("exists", "missing"):
            return
        self.need(f.value is not None, f"{where}: {f.op} needs a value")
        if f.op == "reached":
            self.need(f.field == "status", f"{where}: reached is for the status")
        if f.op == "name_is":
            self.need(d.ref is not None, f"{where}: name_is is for references")
            return
        if f.op in ("gt", "gte", "lt", "lte"):
            self.need(d.is_number or d.is_date, f"{where}: {f.op} needs a number or a date")
        if f.op == "contains":
            self.need(d.type in ("string", "array"), f"{where}: contains needs text or a list")
            return
        for v in f.value if many else [f.value]:
            if d.enum and of is not EVENT_TYPE or f.field == "kind":
                self.need(v in d.enum, f"{where}: {v!r} is not one of {list(d.enum)}")
            if d.format == "date" or of is EVENT_TYPE and f.field == "at":
                self.need(is_date(v) or is_token(v), f"{where}: {v!r} is no date")

    def point(self, p: TimePoint, unit: str, where: str) -> str:
        given = [p.field is not None, p.event is not None, p.today]
        if not self.need(sum(given) == 1, f"{where}: give one of field, event, today"):
            return "none"
        if p.field is not None:
            d = self.type.fields.get(p.field)
            self.need(d is not None and d.is_date, f"{where}: {p.field!r} is no date field")
            self.need(unit != "hours", f"{where}: hours need events")
            return "field"
        if p.event is not None:
            self.need(p.event.kind in ("created", "updated", "status_changed"), f"{where}: no event kind {p.event.kind!r}")
            allowed = self.type.fields.get("status", FieldDef()).enum
            for s in p.event.to:
                self.need(not allowed or s in allowed, f"{where}: no status {s!r}")
            self.need(not p.event.to or p.event.kind == "status_changed", f"{where}: only a status change has a status")
            return "event"
        return "today"

    def points(self, s: Span | Elapsed, unit: str | None, where: str) -> None:
        if self.need(unit in UNITS, f"{where}: the unit is one of {UNITS}"):
            kinds = {self.point(s.start, unit, f"{where}.start"), self.point(s.end, unit, f"{where}.end")}
            self.need(kinds != {"field", "event"}, f"{where}: a date and an event cannot be mixed")
            self.need(kinds != {"today"}, f"{where}: both ends are today")

    def entities_and_events(self) -> None:
        s, t = self.spec, self.type
        self.need(not s.window and not s.compare, "window and compare are for series")
        self.need(not s.record_filters or s.source == "events", "record_filters are for events")
        self.need(not s.values or s.source == "entities", "values are for entities")
        for i, f in enumerate(s.filters):
            self.filter(f, t, f"filters[{i}]")
        for i, f in enumerate(s.record_filters):
            self.filter(f, self.types[s.entity_type], f"record_filters[{i}]")
        for i, e in enumerate(s.elapsed):
            self.need(s.source == "entities", "elapsed is for entities")
            self.need(e.op in ("eq", "gt", "gte", "lt", "lte"), f"elapsed[{i}]: no operator {e.op!r}")
            self.points(e, e.unit, f"elapsed[{i}]")
        self.computed()
        for i, g in enumerate(s.group_by):
            d = t.fields.get(g.field)
            if self.need(d is not None, f"group_by[{i}]: no field {g.field!r}"):
                self.need(g.bucket in BUCKETS and (g.bucket == "none" or d.is_date), f"group_by[{i}]: bucket {g.bucket!r} needs a date field")
                self.need(d.type != "array", f"group_by[{i}]: a list cannot be a group")
        for i, m in enumerate(s.measures):
            where = f"measures[{i}]"
            for j, f in enumerate(m.where):
                self.filter(f, t, f"{where}.where[{j}]")
            for j, e in enumerate(m.elapsed):
                self.points(e, e.unit, f"{where}.elapsed[{j}]")
            d = t.fields.get(m.field or "")
            if s.source == "events":
                self.need(m.agg == "count", f"{where}: events are only counted")
            elif m.agg in ("change", "change_pct") or m.agg in ("first", "last") and not (d and d.is_date):
                self.errors.append(f"{where}: {m.agg} is for series")
            elif m.span is not None:
                self.need(m.agg in SPAN_AGGREGATES and m.field is None, f"{where}: a span is summed, averaged or ranked on its own")
                self.points(m.span, m.unit, f"{where}.span")
            elif m.agg in SPAN_AGGREGATES and m.field in self.values:
                self.need(self.values[m.field].span is None, f"{where}: aggregate the span itself")
            elif m.agg in SPAN_AGGREGATES:
                if self.need(d is not None, f"{where}: no field {m.field!r}"):
                    self.need(d.is_number or m.agg in ("min", "max"), f"{where}: {m.agg} needs a number")
            self.need(m.span is not None or m.unit is None, f"{where}: a unit belongs to a span")
        for f in s.list_fields:
            self.need(f in t.fields or f in self.values, f"list_fields: no field {f!r}")
        if s.order_by_event is not None:
            self.need(s.mode == "list" and s.source == "entities", "order_by_event is for lists of entities")

    def computed(self) -> None:
        s, t = self.spec, self.type
        before: set[str] = set()
        used = {*s.list_fields, s.order_by, *(m.field for m in s.measures)}
        for i, v in enumerate(s.values):
            where = f"values[{i}]"
            self.need(bool(_WORD.fullmatch(v.name)) and v.name not in t.fields and v.name not in before, f"{where}: {v.name!r} must be a new short word")
            if self.need(sum(x is not None for x in (v.asof, v.expr, v.span)) == 1, f"{where}: give one of asof, expr, span"):
                if v.span is not None:
                    self.points(v.span, v.unit, f"{where}.span")
                elif v.asof is not None:
                    self.asof(v.asof, where)
                else:
                    args = v.expr.get("args", [])
                    self.need(v.expr.get("op") in EXPRESSIONS and len(args) >= 2, f"{where}: an expression has an operator and at least two arguments")
                    for a in args:
                        ok = not isinstance(a, str) or a in before or (a in t.fields and t.fields[a].is_number)
                        self.need(ok, f"{where}: {a!r} is neither a number nor an earlier value")
                        used.add(a)
            before.add(v.name)
        if s.mode != "list":
            for v in s.values:
                self.need(v.name in used, f"value {v.name!r} is computed but not used")

    def asof(self, a: dict[str, str], where: str) -> None:
        series, d = self.types.get(a.get("series", "")), self.type.fields.get(a.get("field", ""))
        if not self.need(series is not None and series.kind == "series", f"{where}: {a.get('series')!r} is no series"):
            return
        if self.need(len(series.key) == 1 and series.fields[series.time].format == "date", f"{where}: as-of needs a daily series with one key"):
            ref = series.fields[series.key[0]].ref
            self.need(d is not None and d.ref is not None and d.ref == ref, f"{where}: {a.get('field')!r} does not refer to what the series is keyed by")
        self.need(a.get("measure") in series.measures, f"{where}: {a.get('measure')!r} is no measure of {series.name}")
        at = a.get("at", "@today")
        self.need(is_date(at) or is_token(at) or (at in self.type.fields and self.type.fields[at].is_date), f"{where}: {at!r} is no date")

    def series(self) -> None:
        s, t = self.spec, self.type
        self.need(not (s.elapsed or s.order_by_event or s.values or s.record_filters), "elapsed, values, record_filters and order_by_event are not for series")
        for i, f in enumerate(s.filters):
            self.filter(f, t, f"filters[{i}]")
        names: set[str] = set()
        for i, w in enumerate(s.window):
            self.need(w.measure in t.measures, f"window[{i}]: no measure {w.measure!r}")
            self.need(bool(_WORD.fullmatch(w.name)) and w.name not in names and w.name not in t.fields, f"window[{i}]: {w.name!r} must be a new short word")
            self.need(w.agg in ("avg", "min", "max", "sum") and 1 <= w.size <= 5000 and w.unit in ("points", "days"), f"window[{i}]: size or aggregate")
            names.add(w.name)
        for i, c in enumerate(s.compare):
            self.need(c.measure in t.measures and c.op in ("gt", "gte", "lt", "lte"), f"compare[{i}]: measure or operator")
            self.need((c.window is None) != (c.value is None) and (c.window is None or c.window in names), f"compare[{i}]: give a known window or a value")
        for i, g in enumerate(s.group_by):
            ok = g.field == t.time if g.bucket != "none" else g.field in t.key
            self.need(ok, f"group_by[{i}]: group by a key, or by the time in buckets")
        for i, m in enumerate(s.measures):
            self.need(m.agg == "count" or m.field in t.measures or m.field in names, f"measures[{i}]: no measure {m.field!r}")
            self.need(m.agg != "median" and not m.elapsed and m.span is None, f"measures[{i}]: {m.agg} is not for series")
            for j, f in enumerate(m.where):
                self.filter(f, t, f"measures[{i}].where[{j}]")

    def common(self) -> None:
        s = self.spec
        names: set[str] = set()
        for i, m in enumerate(s.measures):
            self.need(m.agg in AGGREGATES, f"measures[{i}]: no aggregate {m.agg!r}")
            self.need(bool(_WORD.fullmatch(m.name)) and m.name not in names, f"measures[{i}]: {m.name!r} must be a new short word")
            names.add(m.name)
        self.need(s.mode == "aggregate" or not s.group_by, "group_by needs mode aggregate")
        self.need(not s.having or bool(s.group_by), "having needs group_by")
        for h in s.having:
            self.need(h.measure == "count" or h.measure in names, f"having: no measure {h.measure!r}")
            self.need(h.op in COMPARISONS, f"having: no operator {h.op!r}")
        sortable = {*self.type.fields, *names, *self.values, *(w.name for w in s.window), "count", None}
        self.need(s.order_by in sortable, f"order_by: nothing is called {s.order_by!r}")
        self.need(1 <= s.limit <= MAX_ROWS, f"limit: 1 to {MAX_ROWS}")
        self.asked()

    def asked(self) -> None:
        a = self.spec.asks or {}
        calc, unit = a.get("calc"), a.get("unit")
        spans = [m for m in self.spec.measures if m.span is not None]
        if calc == "list":
            self.need(self.spec.mode == "list", "the question asks for a list")
        elif calc in SPAN_AGGREGATES:
            lists = self.spec.mode == "list" and calc in ("min", "max")
            self.need(lists or any(m.agg == calc for m in self.spec.measures), f"the question asks for {calc}")
        if unit and calc in SPAN_AGGREGATES and spans:
            self.need(any(m.unit == unit for m in spans), f"the question asks in {unit}")


def problems(spec: QuerySpec, types: dict[str, TypeDef]) -> list[str]:
    """What the dictionary does not allow; empty if the specification can be planned."""
    if spec.source not in SOURCES or spec.mode not in MODES:
        return [f"source is one of {SOURCES}, mode one of {MODES}"]
    if spec.entity_type not in types:
        return [f"no type {spec.entity_type!r}; there are {sorted(types)}"]
    if spec.source != "events" and (spec.source == "series") != (types[spec.entity_type].kind == "series"):
        return [f"{spec.entity_type} is of kind {types[spec.entity_type].kind}"]
    check = _Check(spec, types)
    check.series() if spec.source == "series" else check.entities_and_events()
    check.common()
    return check.errors
