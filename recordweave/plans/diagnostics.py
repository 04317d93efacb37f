"""What should be said with an answer, each as a DataFrame of its own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.functions.times import bucket
from recordweave.plans.planner import Answer, Book, Planner
from recordweave.plans.spec import FieldDef, QuerySpec

SMALL = 5
#: Days after which a series value is old, by granularity.
RECENT_DAYS = 3
STALE_DAYS = {"day": 7, "week": 21, "month": 62}


def fields_used(spec: QuerySpec) -> list[str]:
    """Fields an answer depends on: filters other than exists and missing, groups, measures and time points."""
    points = [p for s in [*spec.elapsed, *(m.span for m in spec.measures if m.span), *(e for m in spec.measures for e in m.elapsed)] for p in (s.start, s.end)]
    filters = [f.field for f in [*spec.filters, *(f for m in spec.measures for f in m.where)] if f.op not in ("exists", "missing")]
    return list(dict.fromkeys([*filters, *(g.field for g in spec.group_by), *(m.field for m in spec.measures if m.field), *(p.field for p in points if p.field)]))


def missing_fields(book: Book, spec: QuerySpec) -> DataFrame:
    """field, missing: live records without a field that the answer uses; all fields in one pass."""
    records = Planner(book, spec).live(spec.entity_type)
    used = [f for f in fields_used(spec) if f in records.columns]
    if not used:
        return records.sparkSession.createDataFrame([], "field string, missing long")
    counts = records.agg(*[F.sum(F.col(f).isNull().cast("long")).alias(f) for f in used])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit(0)).alias("missing")) for f in used])).alias("x")
    return counts.select(pairs).select("x.*").where("missing > 0")


def small_groups(answer: Answer) -> DataFrame:
    """The groups with fewer than SMALL rows; an answer without groups is one group, empty or not."""
    return answer.rows.where(F.col("n") < SMALL)


def free_text(spec: QuerySpec, fields: dict[str, FieldDef]) -> list[str]:
    """Fields in which the answer rests on matching words of free text."""
    used = [*spec.filters, *(f for m in spec.measures for f in m.where)]
    return sorted({f.field for f in used if f.op == "contains" and f.field in fields and fields[f.field].type == "string" and not fields[f.field].enum})


def incomplete_periods(answer: Answer, spec: QuerySpec, today: dt.date) -> DataFrame:
    """The groups whose bucket is the one today lies in."""
    rows = answer.rows
    now = F.lit(False)
    for g in spec.group_by:
        if g.bucket != "none":
            now = now | (F.col(f"{g.field}_{g.bucket}") == bucket(F.lit(today), g.bucket))
    return rows.where(now)


def inexact_times(book: Book, kind: str) -> DataFrame:
    """One row: records with an event whose time is only a date or unknown."""
    log = book.events.where((F.col("entity_type") == kind) & (F.col("at_precision") != "time"))
    return log.agg(F.countDistinct("entity_id").alias("records"))


def reached_without_time(book: Book, kind: str, status: str) -> DataFrame:
    """Ids of records that reached a status of which no exact event tells when."""
    told = book.events.where((F.col("entity_type") == kind) & F.col("applied") & (F.col("at_precision") == "time") & (F.col("to") == status))
    return book.entities[kind].where(F.array_contains("reached", status)).join(told.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


def history_start(book: Book, answer: Answer, kind: str) -> DataFrame:
    """One row: the first and last creation among the records whose events were asked for."""
    ids = answer.matching.select(F.col("entity_id").alias("id")).distinct()
    return book.entities[kind].join(ids, "id", "left_semi").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def asks_for_outcomes(spec: QuerySpec) -> bool:
    """Counts narrowed by conditions of their own, or a condition on the status."""
    return any(m.agg == "count" and (m.where or m.elapsed) for m in spec.measures) or any(f.field == "status" for f in spec.filters)


def immature(answer: Answer, date_field: str, today: dt.date, days: int = RECENT_DAYS) -> DataFrame:
    """One row: records of the answer whose date lies in the last ``days`` days, today among them, so that their outcome may
    still come."""
    since = today - dt.timedelta(days=days - 1)
    return answer.matching.where(F.col(date_field).cast("date") >= F.lit(since)).agg(F.count("*").alias("records"))


def dated_spans(answer: Answer, planner: Planner) -> DataFrame:
    """One row: records with both dates whose span was measured from the dates rather than from events."""
    spans = [m.span for m in planner.spec.measures if m.span and planner.tied_event(m.span.start) and planner.tied_event(m.span.end)]
    counts = []
    for i, s in enumerate(spans):
        a, b = planner.event_column(planner.tied_event(s.start)), planner.event_column(planner.tied_event(s.end))
        exact = F.coalesce((F.col(f"{a}_day") == F.col(s.start.field).cast("date")) & (F.col(f"{b}_day") == F.col(s.end.field).cast("date")), F.lit(False))
        both = F.col(s.start.field).isNotNull() & F.col(s.end.field).isNotNull()
        counts.append(F.sum((both & ~exact).cast("long")).alias(f"dated_{i}"))
    return answer.matching.agg(*counts)


def asof_gaps(answer: Answer, value: str, at: dt.date, granularity: str = "day") -> DataFrame:
    """One row: records without a point, with an old one, and the oldest point used."""
    day = F.date_from_unix_date(F.col(f"{value}_t").cast("int"))
    old = F.datediff(F.lit(at), day) > STALE_DAYS[granularity]
    return answer.matching.agg(F.sum(F.col(value).isNull().cast("long")).alias("none"), F.sum(old.cast("long")).alias("old"), F.min(day).alias("oldest"))


def partial_coverage(coverage: DataFrame, entities: DataFrame) -> DataFrame:
    """Per field: live records that only some of their sources have."""
    live = entities.select(F.col("id").alias("entity_id"))
    return coverage.where("present < sources").join(live, "entity_id", "left_semi").groupBy("field").agg(F.count("*").alias("records"))
