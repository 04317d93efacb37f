"""What is said with an answer: notes on how far it can be trusted, plain text, and what a narrator may see.

Everything here works on a bounded view of an answer (``Shown``): the listed rows or the groups, and ids of evidence up to
a limit. The notes are one small aggregate each, run only where they apply.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.functions.times import bucket
from recordweave.plans import diagnostics as diag
from recordweave.plans.planner import Answer, Book, Planner
from recordweave.plans.spec import QuerySpec, TypeDef

SHOWN_IDS = 50
GROUP_IDS = 10
#: Groups that are shown; the answer's DataFrame has them all.
SHOWN_GROUPS = 1_000


@dataclass
class Shown:
    """An answer as it is put into words."""

    mode: str
    total: int
    rows: list[dict[str, Any]] = field(default_factory=list)
    groups: list[dict[str, Any]] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


def number(x: Any) -> Any:
    """A number as it is shown: two decimals, rounded half to even on its binary value; the engine itself never rounds."""
    return round(x, 2) if isinstance(x, float) else x


def shown(answer: Answer, spec: QuerySpec) -> Shown:
    """Collects what is shown of an answer: at most the listed rows, or SHOWN_GROUPS groups with GROUP_IDS ids each."""
    out = Shown(answer.mode, answer.total.first().total)
    has_id = "id" in answer.matching.columns
    if answer.mode == "list":
        out.rows = [{k: number(v) for k, v in r.asDict().items()} for r in answer.rows.collect()]  # at most the limit of the specification
        out.ids = [str(r["id"]) for r in out.rows if "id" in r]
        return out
    names = [c for c in answer.rows.columns[: len(spec.group_by)]]
    rows = [r.asDict() for r in answer.rows.limit(SHOWN_GROUPS).collect()]
    ids: dict[tuple, list[str]] = {}
    if has_id and names:
        for r in _some_ids(answer.matching, names, GROUP_IDS).limit(SHOWN_GROUPS).collect():
            ids[tuple(r[n] for n in names)] = [str(i) for i in r.ids]
    if has_id and not names:
        out.ids = [str(r.id) for r in answer.matching.select("id").orderBy("id").limit(SHOWN_IDS).collect()]
    for r in rows:
        key = tuple(r[n] for n in names)
        measures = {k: number(v) for k, v in r.items() if k not in names and k != "n"}
        out.groups.append({"group": {n: r[n] for n in names}, "measures": measures, "n": r["n"], "ids": ids.get(key, out.ids[:GROUP_IDS] if not names else [])})
    return out


def _some_ids(matching: DataFrame, names: list[str], most: int) -> DataFrame:
    """names, ids: the ``most`` least ids of each group; no group is gathered."""
    from pyspark.sql import Window as W

    ranked = matching.select(*names, "id").withColumn("_k", F.row_number().over(W.partitionBy(*names).orderBy("id"))).where(F.col("_k") <= most)
    return ranked.groupBy(*names).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def notes(book: Book, spec: QuerySpec, answer: Answer, seen: Shown, planner: Planner | None = None, coverage: DataFrame | None = None) -> list[str]:
    """The notes that apply to an answer, each a sentence."""
    said = [f"Read with a default: {d}." for d in spec.defaults_used]
    t = None if spec.source == "events" else book.types[spec.entity_type]
    if spec.source == "entities":
        for r in diag.missing_fields(book, spec).orderBy("field").collect():  # one row per field of the question
            draft = " (not registered yet)" if t.fields[r.field].draft else ""
            said.append(f"{r.missing} live record(s) have no {r.field}{draft} and cannot match.")
        if coverage is not None:
            said += [f"{r.records} record(s) have {r.field} from only some of their sources." for r in diag.partial_coverage(coverage, book.entities[spec.entity_type]).orderBy("field").collect()]
        said += _time_notes(book, spec, answer, planner)
    if spec.source == "events" and any(f.field == "kind" and f.op == "eq" and f.value != "created" for f in spec.filters) and seen.total:
        r = diag.history_start(book, answer, spec.entity_type).first()
        if r.first:
            said.append(f"The history of these records begins when each was first recorded ({str(r.first)[:10]} to {str(r.last)[:10]}); changes before that are known only if recorded later.")
    if seen.total == 0:
        said.append("Nothing matches. What was expected may not be recorded yet.")
    elif seen.mode == "aggregate" and spec.group_by:
        small = [f"{label(g['group'])} ({g['n']})" for g in seen.groups if g["n"] < diag.SMALL]
        if small:
            said.append(f"Fewer than {diag.SMALL} records in: {', '.join(small)}.")
    elif seen.mode == "aggregate" and seen.total < diag.SMALL:
        said.append(f"Only {seen.total} record(s).")
    for g in spec.group_by:
        if g.bucket != "none":
            column, now = f"{g.field}_{g.bucket}", _current(book, answer.rows, g.bucket)
            if any(x["group"].get(column) == now for x in seen.groups):
                said.append(f"{column} {now} is still in progress.")
    if spec.source == "entities" and t.default_date and t.default_date in answer.matching.columns and diag.asks_for_outcomes(spec) and seen.total:
        n = diag.immature(answer, t.default_date, book.today).first().records
        if n:
            said.append(f"{n} of these records have {t.default_date} within the last {diag.RECENT_DAYS} days; their outcome may still come.")
    if t is not None:
        said += [f"This rests on words in the free text of {f}; records worded otherwise are missed. A field of its own would not miss them." for f in diag.free_text(spec, t.fields)]
    if answer.resolved:
        said.append("Dates read as: " + ", ".join(f"{k} = {v}" for k, v in answer.resolved.items()) + f" ({book.zone}).")
    said += [f"{name!r} was read as {', '.join(map(str, ids))}." if ids else f"No record is called {name!r}." for name, ids in answer.names.items()]
    return said


def _time_notes(book: Book, spec: QuerySpec, answer: Answer, planner: Planner | None) -> list[str]:
    """Notes on answers that measure from the times of events."""
    said = []
    spans = [m.span for m in spec.measures if m.span] + [v.span for v in spec.values if v.span]
    points = [p for s in spans for p in (s.start, s.end)] + [p for e in spec.elapsed for p in (e.start, e.end)]
    if book.events is not None and (any(p.event for p in points) or spec.order_by_event):
        n = diag.inexact_times(book, spec.entity_type).first().records
        if n:
            said.append(f"{n} record(s) have changes whose time is only a date or unknown; these are not measured.")
        for status in sorted({s for p in points if p.event and p.event.kind == "status_changed" for s in p.event.to}):
            n = diag.reached_without_time(book, spec.entity_type, status).count()
            if n:
                said.append(f"{n} record(s) reached {status} at a time that no exact change tells.")
    if planner is not None and any(m.span and planner.tied_event(m.span.start) and planner.tied_event(m.span.end) for m in spec.measures):
        n = sum(v or 0 for v in diag.dated_spans(answer, planner).first())
        said.append("Times between dates are measured from the exact times of their events" + (f"; {n} record(s) have none on those days and keep the dates." if n else "."))
    for v in spec.values:
        if v.asof is not None and f"{v.name}_t" in answer.matching.columns:
            at = v.asof.get("at", "@today")
            if at not in book.types[spec.entity_type].fields:
                r = diag.asof_gaps(answer, v.name, answer.resolved.get(at) or book.today, book.types[v.asof["series"]].granularity).first()
                if r["none"] or r["old"]:
                    said.append(f"{v.name}: {r['none'] or 0} record(s) have no value, {r['old'] or 0} an old one (the oldest of {r['oldest']}).")
    return said


def _current(book: Book, rows: DataFrame, size: str) -> str:
    return rows.sparkSession.range(1).select(bucket(F.lit(book.today), size)).first()[0]


def label(group: dict[str, Any], labels: dict[str, str] | None = None) -> str:
    named = lambda v: f"{v} ({labels[v]})" if labels and v in labels else f"{v}"
    return " / ".join(f"{k}={named(v)}" for k, v in group.items()) or "all"


def text(spec: QuerySpec, seen: Shown, t: TypeDef | None = None) -> str:
    """An answer in plain text, with its evidence and notes."""
    lines = [f"Interpretation: {spec.interpretation}"] if spec.interpretation else []
    named = lambda v: f"{v} ({seen.labels[v]})" if v in seen.labels else f"{v}"
    more = lambda ids, most: ", ".join(ids[:most]) + (" …" if len(ids) > most else "")
    if seen.mode == "count":
        lines += [f"Answer: {seen.total}"] + ([f"Evidence: {more(seen.ids, SHOWN_IDS)}" + (f" (+{seen.total - len(seen.ids)})" if seen.total > len(seen.ids) else "")] if seen.ids else [])
    elif seen.mode == "list":
        lines.append(f"Answer: {seen.total} record(s)" + (f", {len(seen.rows)} shown" if len(seen.rows) < seen.total else ""))
        keys = spec.list_fields or ([f for f, d in t.fields.items() if d.ref or f == "status"] if t else [])
        for r in seen.rows:
            if spec.source == "events":
                what = f"{r.get('kind')} {r.get('to') or ''}".strip() + (f" of {r['target_event_id']}" if r.get("target_event_id") else "")
                lines.append(f"- {r.get('id')} {r.get('entity_id')}: {what} at {r.get('at')} by {r.get('by')}" + (f" ({r['evidence']})" if r.get("evidence") else ""))
            else:
                extra = ", ".join(f"{k}={named(r[k])}" for k in keys if k in r)
                lines.append(f"- {r.get('id', '')}" + (f" ({extra})" if extra else ""))
    else:
        shares = {m.name for m in spec.measures if m.agg == "count" and (m.where or m.elapsed)}
        lines.append(f"Answer: {len(seen.groups)} group(s), {seen.total} record(s)")
        for g in seen.groups:
            parts = [f"{k}={v}/{g['n']} ({v / g['n']:.0%})" if k in shares and isinstance(v, int) and g["n"] else f"{k}={v}" for k, v in g["measures"].items()]
            lines.append(f"- {label(g['group'], seen.labels)}: n={g['n']}" + "".join(f", {p}" for p in parts) + (f"  [evidence: {more(g['ids'], GROUP_IDS)}]" if g["ids"] else ""))
    return "\n".join([*lines, *(f"Note: {n}" for n in seen.notes)])


def narration(question: str, spec: QuerySpec, seen: Shown) -> dict[str, Any]:
    """What a narrator may see: the question, how it was read, and figures; of a list only ids and the listed fields."""
    out: dict[str, Any] = {"question": question, "interpretation": spec.interpretation, "mode": seen.mode, "total": seen.total, "notes": seen.notes}
    if seen.mode == "aggregate":
        out["groups"] = [{k: g[k] for k in ("group", "n", "measures")} for g in seen.groups]
    elif seen.mode == "list":
        out["records"] = [{k: r.get(k) for k in ("id", *spec.list_fields)} for r in seen.rows[:SHOWN_IDS]]
    return out


def reference_labels(book: Book, kind: str, seen: Shown) -> dict[str, str]:
    """Names of the records that what is shown refers to: id -> name."""
    found: dict[str, str] = {}
    for f, d in book.types[kind].fields.items():
        if not d.ref or d.ref not in book.entities:
            continue
        ids = {str(r[f]) for r in seen.rows if r.get(f) is not None} | {str(g["group"][f]) for g in seen.groups if g["group"].get(f) is not None}
        name = book.names.get(d.ref, "name")
        if ids and name in book.entities[d.ref].columns:
            text_id = F.col("id").cast("string")
            found |= {r.i: r.n for r in book.entities[d.ref].where(text_id.isin(*ids)).select(text_id.alias("i"), F.col(name).alias("n")).collect() if r.n}  # as many as are shown
    return found
