"""From a specification to lazy DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.functions.names import candidates, identify
from recordweave.functions.times import UNIT_US, bucket
from recordweave.operators.asof import asof_join
from recordweave.operators.moving import moving
from recordweave.plans import reltime
from recordweave.plans.spec import EVENT_TYPE, Elapsed, EventRef, Filter, GroupKey, QuerySpec, SpecError, TimePoint, TypeDef, Value, is_token, parse, problems

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: ~a.eqNullSafe(b), "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Book:
    """What can be asked: types, one typed DataFrame per entity and series type, and the event log.

    entities[type]: ``id``, the type's fields, and optionally ``retracted``, ``created_at``, ``reached`` (array).
    events: ``id, seq, entity_id, entity_type, kind, to, from, at_us, local_day, by, evidence, at_precision, applied``.
    series[type]: the type's fields. ``names[type]`` is the field that labels a record.
    """

    types: dict[str, TypeDef]
    entities: dict[str, DataFrame] = field(default_factory=dict)
    events: DataFrame | None = None
    series: dict[str, DataFrame] = field(default_factory=dict)
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc))
    zone: str = "Asia/Seoul"
    names: dict[str, str] = field(default_factory=dict)

    @property
    def today(self) -> dt.date:
        return self.now.astimezone(ZoneInfo(self.zone)).date()

    def instant_us(self, moment: dt.datetime) -> int:
        return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


class AskBack(SpecError):
    """A name that cannot be read with certainty; ``options`` are the records it may mean."""

    def __init__(self, problem: str, options: list[str]) -> None:
        super().__init__([problem])
        self.options = options


@dataclass
class Answer:
    """``rows``: the listed rows, or one row per group with ``n``. ``matching`` holds every row that counts, with its
    group columns, so evidence stays distributed. ``total`` is a one-row DataFrame."""

    mode: str
    rows: DataFrame
    matching: DataFrame
    resolved: dict[str, dt.date] = field(default_factory=dict)
    names: dict[str, list[str]] = field(default_factory=dict)

    @property
    def total(self) -> DataFrame:
        return self.matching.agg(F.count("*").alias("total"))

    @property
    def entity_ids(self) -> DataFrame:
        """The different records that the matching events belong to."""
        return self.matching.select("entity_id").distinct()

    @property
    def evidence(self) -> DataFrame:
        return self.matching.select([c for c in self.matching.columns if c in self.rows.columns or c == "id"])


def ascii_folded(text: Column) -> Column:
    """Only the letters A to Z are lower-cased."""
    return F.translate(text, _UPPER, _LOWER)


def later_statuses(wanted: list[str], implies: dict[str, list[str]]) -> list[str]:
    """Statuses that count as having reached one of ``wanted``: those whose implied statuses meet the set so far, in
    one pass over the dictionary's order."""
    found = list(wanted)
    for status, earlier in implies.items():
        if status not in found and set(earlier) & set(found):
            found.append(status)
    return found


def with_groups(spec: QuerySpec, types: dict[str, TypeDef]) -> QuerySpec:
    """The specification with phrases that stand for several values of a field read as these values."""
    t = types.get(spec.entity_type)
    if t is None or spec.source == "events" and not spec.record_filters:
        return spec

    def read(f: Filter) -> Filter:
        groups = t.fields[f.field].groups if f.field in t.fields and f.op in ("eq", "ne") else {}
        said = f.value if isinstance(f.value, list) else [f.value]
        if not any(isinstance(v, str) and v.strip().lower() in groups for v in said):
            return f
        values = [x for v in said for x in (groups.get(v.strip().lower(), [v]) if isinstance(v, str) else [v])]
        return Filter(f.field, f.op, list(dict.fromkeys(values)))

    own = spec.filters if spec.source == "events" else [read(f) for f in spec.filters]
    return replace(spec, filters=own, record_filters=[read(f) for f in spec.record_filters])


class Planner:
    """Plans one specification over a book."""

    def __init__(self, book: Book, spec: QuerySpec | dict) -> None:
        self.book = book
        self.spec = with_groups(parse(spec) if isinstance(spec, dict) else spec, book.types)
        if found := problems(self.spec, book.types):
            raise SpecError(found)
        self.type = EVENT_TYPE if self.spec.source == "events" else book.types[self.spec.entity_type]
        self.resolved: dict[str, dt.date] = {}
        #: Names and keys that were read as record ids.
        self.read_names: dict[str, list[str]] = {}
        if self.spec.source != "series":
            self.spec = replace(self.spec, filters=self.with_ids(self.spec.filters, self.type))
        self.refs: dict[tuple[str, tuple[str, ...]], str] = {}

    # conditions

    def literal(self, f: str, value: object, of: TypeDef) -> Column:
        d = of.fields.get(f)
        if d is not None and d.format == "date":
            return F.lit(self.day(value))
        return F.lit(value)

    def day(self, value: object) -> dt.date:
        day = reltime.resolve(value, self.book.today)
        if is_token(value):
            self.resolved[value] = day
        return day

    def condition(self, f: Filter, of: TypeDef) -> Column:
        c = F.col(f.field)
        if of is EVENT_TYPE and f.field == "at" and f.op not in ("exists", "missing"):
            return self.local_days(f)
        if f.op == "exists":
            return c.isNotNull()
        if f.op == "missing":
            return c.isNull()
        if f.op == "reached":
            wanted = f.value if isinstance(f.value, list) else [f.value]
            return F.arrays_overlap("reached", F.array(*map(F.lit, later_statuses(wanted, of.fields["status"].implies))))
        if f.op == "contains":
            if of.fields[f.field].type == "array":
                return F.array_contains(c, f.value)
            return ascii_folded(c).contains(str(f.value).translate(str.maketrans(_UPPER, _LOWER)))
        if f.op == "name_is":
            return c.isin(self.named(of.fields[f.field].ref, str(f.value)))
        if isinstance(f.value, list):
            inside = c.isin([self.literal(f.field, v, of) for v in f.value])
            return inside if f.op == "eq" else c.isNull() | ~inside
        return _COMPARE[f.op](c, self.literal(f.field, f.value, of))

    def named(self, kind: str, name: str) -> list[str]:
        """Ids of the records that a name or identifier means, by the identity cascade. Records that share an identifier are
        all meant; else a name that several bear, or that only resembles some, is asked back (AskBack). A name that nothing
        resembles means no record."""
        records = self.book.entities[kind]
        if "retracted" in records.columns:
            records = records.where(~F.coalesce("retracted", F.lit(False)))
        spark = records.sparkSession
        asked = spark.createDataFrame([(0, name)], "query_id int, query string")
        marks = [f for f, d in self.book.types[kind].fields.items() if d.identifier and f in records.columns] if kind in self.book.types else []
        label = self.book.names.get(kind, "name")
        known = records.withColumn("id", F.col("id").cast("string"))
        for mark in marks or [None]:
            hit = identify(asked, known, mark, label if label in known.columns else None).first()
            if hit.status == "match" or hit.status == "ambiguous" and hit.rule.startswith("identifier:"):
                self.read_names[name] = hit.ids.split(",")
                return self.read_names[name]
            if hit.status == "ambiguous":
                raise AskBack(f"{name!r} is what several records of type {kind} are called", hit.ids.split(","))
        near = candidates(asked, known, 5, label).orderBy(F.desc("score"), "id").collect() if label in known.columns else []  # at most 5
        if near:
            raise AskBack(f"no record of type {kind} is called {name!r}", [r.id for r in near])
        self.read_names[name] = []
        return ["\0"]

    def identified(self, f: Filter, kind: str) -> Filter:
        """A filter on the id of a record of ``kind``, with values that are no ids read as source keys, else as names."""
        said = f.value if isinstance(f.value, list) else [f.value]
        records = self.book.entities[kind]
        text = F.col("id").cast("string")
        there = {r[0] for r in records.where(text.isin([str(v) for v in said])).select(text).distinct().collect()}  # as many as are asked for
        ids: list[object] = []
        for v in said:
            if not isinstance(v, str) or v in there:
                ids.append(v)
                continue
            keyed = [r.id for r in records.where(F.col("source_key") == v).select("id").orderBy("id").limit(1001).collect()] if "source_key" in records.columns else []
            if not keyed:
                keyed = [i for i in self.named(kind, v) if i != "\0"]
            if not keyed:
                raise AskBack(f"{v!r} is no id, source key or name of a record of type {kind}", [])
            self.read_names[v] = keyed
            ids += keyed
        return Filter(f.field, f.op, ids[0] if len(ids) == 1 else ids)

    def with_ids(self, filters: list[Filter], of: TypeDef) -> list[Filter]:
        """Filters that compare ids of records name recorded ones."""
        out = []
        for f in filters:
            kind = self.spec.entity_type if of is EVENT_TYPE and f.field == "entity_id" else of.fields[f.field].ref if of is not EVENT_TYPE and f.field in of.fields else None
            texts = any(isinstance(v, str) for v in (f.value if isinstance(f.value, list) else [f.value]))
            out.append(self.identified(f, kind) if kind in self.book.entities and f.op in ("eq", "ne") and texts else f)
        return out

    def local_days(self, f: Filter) -> Column:
        """Instants of local days: a day is the range from its midnight to the next in the book's zone."""
        zone = ZoneInfo(self.book.zone)
        edge = lambda v, n=0: self.book.instant_us(dt.datetime.combine(self.day(v) + dt.timedelta(days=n), dt.time(), zone))
        at = F.col("at_us")
        if f.op == "eq":
            days = f.value if isinstance(f.value, list) else [f.value]
            return reduce(lambda a, b: a | b, [(at >= edge(v)) & (at < edge(v, 1)) for v in days])
        return {"gte": lambda: at >= edge(f.value), "gt": lambda: at >= edge(f.value, 1), "lt": lambda: at < edge(f.value), "lte": lambda: at < edge(f.value, 1)}.get(f.op, self.refuse(f))()

    @staticmethod
    def refuse(f: Filter) -> Callable[[], Column]:
        def fail() -> Column:
            raise SpecError([f"{f.op} does not apply to the time of an event"])

        return fail

    # time points

    def event_column(self, ref: EventRef) -> str:
        """Name of the column that holds the first exact time of a matching event of the record (``…_day``: its day)."""
        return self.refs.setdefault((ref.kind, tuple(ref.to)), f"_event{len(self.refs)}")

    def with_event_times(self, df: DataFrame) -> DataFrame:
        """Joins the event times that the plan refers to; the log is aggregated once for all of them."""
        if not self.refs:
            return df
        log = self.book.events.where((F.col("entity_type") == self.spec.entity_type) & F.col("applied") & (F.col("at_precision") == "time"))
        log = log.where(F.col("kind").isin(sorted({k for k, _ in self.refs})))
        aggregates = []
        for (kind, to), name in self.refs.items():
            match = F.col("kind") == kind
            if to:
                match = match & F.col("to").isin(list(to))
            aggregates += [F.min(F.when(match, F.col("at_us"))).alias(name), F.max(F.when(match, F.col("at_us"))).alias(f"{name}_last"), F.min_by("local_day", F.when(match, F.struct("at_us", "seq"))).alias(f"{name}_day")]
        return df.join(log.groupBy(F.col("entity_id").alias("id")).agg(*aggregates), "id", "left")

    def collect_refs(self) -> None:
        """Registers every event the specification measures from, before the log is joined."""
        s = self.spec
        spans = [*s.elapsed, *(e for m in s.measures for e in m.elapsed), *(m.span for m in s.measures if m.span), *(v.span for v in s.values if v.span)]
        for span in spans:
            for p in (span.start, span.end):
                if p.event:
                    self.event_column(p.event)
        for span in [*(m.span for m in s.measures if m.span), *(v.span for v in s.values if v.span)]:
            if all(tied := [self.tied_event(span.start), self.tied_event(span.end)]):
                for e in tied:
                    self.event_column(e)
        if s.order_by_event:
            self.event_column(s.order_by_event)

    def tied_event(self, p: TimePoint) -> EventRef | None:
        d = self.type.fields.get(p.field or "")
        if p.as_dated or d is None or d.event is None:
            return None
        to = d.event.get("to")
        return EventRef(d.event["kind"], [] if to is None else [to] if isinstance(to, str) else list(to))

    def span(self, start: TimePoint, end: TimePoint, unit: str) -> Column:
        """Time from start to end, exact in microseconds and divided once; null if a point is missing."""
        return (self.point_us(end, start) - self.point_us(start, end)) / F.lit(float(UNIT_US[unit]))

    def point_us(self, p: TimePoint, other: TimePoint) -> Column:
        if p.event is not None:
            return F.col(self.event_column(p.event))
        if p.field is not None:
            return F.unix_date(F.col(p.field).cast("date")).cast("long") * F.lit(UNIT_US["days"])
        if other.event is not None:
            return F.lit(self.book.instant_us(self.book.now))
        return F.lit((self.book.today - dt.date(1970, 1, 1)).days * UNIT_US["days"]).cast("long")

    def measured_span(self, start: TimePoint, end: TimePoint, unit: str) -> Column:
        """A span between dates that are days of events is measured from the events where both fell on those days."""
        a, b = self.tied_event(start), self.tied_event(end)
        dated = self.span(start, end, unit)
        if a is None or b is None:
            return dated
        same = (F.col(f"{self.event_column(a)}_day") == F.col(start.field).cast("date")) & (F.col(f"{self.event_column(b)}_day") == F.col(end.field).cast("date"))
        return F.when(same, self.span(TimePoint(event=a), TimePoint(event=b), unit)).otherwise(dated)

    def elapsed(self, e: Elapsed) -> Column:
        return _COMPARE[e.op](self.span(e.start, e.end, e.unit), F.lit(float(e.value)))

    # values

    def with_values(self, df: DataFrame) -> DataFrame:
        for v in self.spec.values:
            if v.asof is not None:
                df = self.with_asof(df, v)
            elif v.expr is not None:
                args = [F.col(a) if isinstance(a, str) else F.lit(float(a)) for a in v.expr["args"]]
                op = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))}[v.expr["op"]]
                df = df.withColumn(v.name, reduce(op, args))
            else:
                df = df.withColumn(v.name, self.measured_span(v.span.start, v.span.end, v.unit))
        return df

    def with_asof(self, df: DataFrame, v: Value) -> DataFrame:
        a, series = v.asof, self.book.types[v.asof["series"]]
        at = a.get("at", "@today")
        day = F.col(at).cast("date") if at in self.type.fields else F.lit(self.day(at))
        points = self.book.series[series.name]
        number = lambda c: F.unix_date(c.cast("date")).cast("long")
        return asof_join(df, points, F.col(a["field"]), number(day), F.col(series.key[0]), number(F.col(series.time)), F.col(a["measure"]), v.name)

    # sources

    def base(self) -> DataFrame:
        s = self.spec
        if s.source == "events":
            df = self.book.events.where(F.col("entity_type") == s.entity_type)
            if s.record_filters:
                live = self.live(s.entity_type)
                for f in s.record_filters:
                    live = live.where(self.condition(f, self.book.types[s.entity_type]))
                df = df.join(live.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
            return df
        if s.source == "series":
            return self.series_base()
        self.collect_refs()
        plain = [f for f in s.filters]
        df = self.live(s.entity_type)
        for f in plain:
            df = df.where(self.condition(f, self.type))
        df = self.with_event_times(df)
        for e in s.elapsed:
            df = df.where(self.elapsed(e))
        return self.with_values(df)

    def live(self, kind: str) -> DataFrame:
        df = self.book.entities[kind]
        return df.where(~F.coalesce("retracted", F.lit(False))) if "retracted" in df.columns else df

    def series_base(self) -> DataFrame:
        """Key filters first, then windows over each key's whole history, then the other filters."""
        s, t = self.spec, self.type
        df = self.book.series[s.entity_type]
        for f in s.filters:
            if f.field in t.key:
                df = df.where(self.condition(f, t))
        for w in s.window:
            if t.granularity != "day":
                df = moving(df, list(t.key), t.time, w.measure, w.agg, w.size, w.unit, w.name)
                continue
            # a key has at most one point a day, so its whole history is a few tens of thousands of rows
            over = W.partitionBy(*t.key) if t.key else W.partitionBy(F.lit(0))
            over = over.orderBy(t.time).rowsBetween(-(w.size - 1), 0) if w.unit == "points" else over.orderBy(F.unix_date(F.col(t.time).cast("date"))).rangeBetween(-(w.size - 1), 0)
            df = df.withColumn(w.name, getattr(F, w.agg)(w.measure).over(over))
        for f in s.filters:
            if f.field not in t.key:
                df = df.where(self.condition(f, t))
        for c in s.compare:
            df = df.where(_COMPARE[c.op](F.col(c.measure), F.col(c.window) if c.window else F.lit(c.value)))
        return df

    # results

    def group_column(self, g: GroupKey) -> Column:
        if g.bucket == "none":
            return F.col(g.field).alias(g.field)
        day = F.col("local_day") if self.type is EVENT_TYPE and g.field == "at" else F.col(g.field).cast("date")
        return bucket(day, g.bucket).alias(f"{g.field}_{g.bucket}")

    def measure(self, m) -> Column:
        holds = [self.condition(f, self.type) for f in m.where] + [self.elapsed(e) for e in m.elapsed]
        only = reduce(lambda a, b: a & b, holds) if holds else None
        if m.agg == "count":
            return (F.count("*") if only is None else F.sum(F.when(only, 1).otherwise(0))).alias(m.name)
        x = F.col(m.field) if m.span is None else self.measured_span(m.span.start, m.span.end, m.unit)
        x = x if only is None else F.when(only, x)
        if self.spec.source == "series" and m.agg in ("first", "last", "change", "change_pct"):
            t = F.when(x.isNotNull(), F.struct(self.type.time, *self.type.key))
            first, last = F.min_by(x, t), F.max_by(x, t)
            return {"first": first, "last": last, "change": last - first, "change_pct": F.try_divide((last - first) * 100.0, first)}[m.agg].alias(m.name)
        return {"first": F.min, "last": F.max}.get(m.agg, getattr(F, m.agg, None))(x).alias(m.name)

    def answer(self) -> Answer:
        s = self.spec
        df = self.base()
        if s.source == "events":
            for f in s.filters:
                df = df.where(self.condition(f, self.type))
        if s.mode == "list":
            return Answer("list", self.listed(df), df, self.resolved, self.read_names)
        groups = [self.group_column(g) for g in s.group_by]
        names = [g.field if g.bucket == "none" else f"{g.field}_{g.bucket}" for g in s.group_by]
        matching = df.select("*", *[c for c, g in zip(groups, s.group_by) if g.bucket != "none"])
        measures = [self.measure(m) for m in s.measures]
        grouped = (matching.groupBy(*names) if names else matching.groupBy()).agg(*measures, F.count("*").alias("n"))
        for h in s.having:
            grouped = grouped.where(_COMPARE[h.op](F.col("n" if h.measure == "count" else h.measure), F.lit(h.value)))
        if names:
            by = "n" if s.order_by == "count" else s.order_by
            if by in grouped.columns:
                grouped = grouped.orderBy(F.col(by).desc() if s.descending else F.col(by).asc(), *names)
            else:
                grouped = grouped.orderBy(*names)
        return Answer(s.mode, grouped, matching, self.resolved, self.read_names)

    def listed(self, df: DataFrame) -> DataFrame:
        s, t = self.spec, self.type
        key = {"entities": ["id"], "events": ["seq"], "series": [t.time, *t.key]}[s.source]
        if s.order_by_event is not None:
            name = self.event_column(s.order_by_event)
            order = [F.col(f"{name}_last").desc_nulls_last() if s.descending else F.col(name).asc_nulls_last(), *key]
        elif s.order_by in {v.name for v in s.values}:
            order = [F.col(s.order_by).desc_nulls_last() if s.descending else F.col(s.order_by).asc_nulls_last(), *key]
        elif s.order_by and s.order_by != "count":
            order = [F.col(s.order_by).desc() if s.descending else F.col(s.order_by).asc(), *key]
        else:
            order = [F.col(c).desc() if s.descending and i == 0 and s.source == "series" else F.col(c).asc() for i, c in enumerate(key)]
        if s.source == "series":
            shown = s.list_fields or [*t.key, t.time, *t.measures, *(w.name for w in s.window)]
        elif s.source == "events":
            every = ["seq", "entity_id", "entity_type", "kind", "to", "from", "payload", "at", "recorded_at", "by", "evidence", "target_event_id"]
            shown = list(dict.fromkeys(["id", *(s.list_fields or [c for c in every if c in df.columns])]))
        else:
            default = [f for f, d in t.fields.items() if d.ref or f == "status"]
            shown = list(dict.fromkeys(["id", *(s.list_fields or default), *(v.name for v in s.values)]))
        return df.orderBy(*order).limit(s.limit).select(*shown)


def ask(book: Book, spec: QuerySpec | dict) -> Answer:
    """Validate and plan a specification; nothing runs until the answer's DataFrames are used."""
    return Planner(book, spec).answer()


def with_labels(rows: DataFrame, book: Book, kind: str) -> DataFrame:
    """Adds ``<field>_label``, the name of the referred record, for every reference of a type."""
    for f, d in book.types[kind].fields.items():
        if d.ref and f in rows.columns and d.ref in book.entities:
            label = book.names.get(d.ref, "name")
            rows = rows.join(book.entities[d.ref].select(F.col("id").alias(f), F.col(label).alias(f"{f}_label")), f, "left")
    return rows
