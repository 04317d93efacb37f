"""Record histories beyond the current document: statuses reached, times, conflicts, payload checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.operators.changefeed import replayable
from recordweave.operators.feed import DATA_KINDS, JSON_MAP, META_KINDS


def statuses_reached(events: DataFrame) -> DataFrame:
    """entity_id, reached: the statuses a record has had, in the order of their first appearance.
    Reduced per (record, status) before anything is gathered, so a long record costs one row per status."""
    return reached_of(replayable(events))


def reached_of(applied: DataFrame) -> DataFrame:
    payload = F.from_json("payload", JSON_MAP)
    value = F.when(F.col("kind") == "status_changed", payload["to"]).otherwise(payload["status"])
    place = F.struct((F.col("kind") != "created").alias("a"), F.col("place_us").alias("b"), F.col("seq").alias("c"))
    first = applied.select("entity_id", value.alias("status"), place.alias("place")).where("status is not null").groupBy("entity_id", "status").agg(F.min("place").alias("place"))
    return first.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("place", "status"))).alias("r")).select("entity_id", F.transform("r", lambda x: x["status"]).alias("reached"))


def record_times(events: DataFrame) -> DataFrame:
    """entity_id, created_us, updated_us (latest time of an applied change), n_applied."""
    return times_of(replayable(events))


def times_of(applied: DataFrame) -> DataFrame:
    created = F.min(F.when(F.col("kind") == "created", F.col("at_us"))).alias("created_us")
    return applied.groupBy("entity_id").agg(created, F.max("at_us").alias("updated_us"), F.count("*").alias("n_applied"))


#: A record's changes are ordered inside stretches of this many microseconds; what a stretch ends with is carried on.
STRETCH_US = 86_400_000_000


def status_conflicts(events: DataFrame) -> DataFrame:
    """event_id, expected, actual of each applied status change whose ``from`` is not the status just before it.

    Rows are ordered inside a record's days only, and the last status of every day is carried to the next that has one."""
    return _status_conflicts(replayable(events)).select("event_id", "expected", "actual")


def _status_conflicts(applied: DataFrame) -> DataFrame:
    payload = F.from_json("payload", JSON_MAP)
    value = F.when(F.col("kind") == "status_changed", payload["to"]).otherwise(payload["status"])
    sets = F.col("kind").isin("created", "status_changed") | F.map_contains_key(payload, "status")
    born = F.col("kind") == "created"
    stretch = F.when(born, F.lit(-(2**62))).otherwise(F.floor(F.col("place_us") / STRETCH_US)).cast("long")
    rows = applied.where(F.coalesce(sets, F.lit(False))).select("entity_id", "id", "kind", value.alias("status"), payload["from"].alias("expected"), F.map_contains_key(payload, "from").alias("asks"), stretch.alias("stretch"), F.struct("place_us", "seq").alias("place"))
    said = F.struct("status")  # a status removed is a status too: none
    ends = rows.groupBy("entity_id", "stretch").agg(F.max_by(said, "place").alias("end"))
    earlier = W.partitionBy("entity_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("entity_id", "stretch", F.last("end").over(earlier).alias("carried"))
    before = W.partitionBy("entity_id", "stretch").orderBy("place")
    known = rows.withColumn("near", F.lag(said).over(before)).where("kind = 'status_changed' and asks").join(carried, ["entity_id", "stretch"], "left")
    actual = F.coalesce("near", "carried")["status"]
    return known.where(~F.col("expected").eqNullSafe(actual)).select("entity_id", F.col("id").alias("event_id"), F.coalesce("expected", F.lit("")).alias("expected"), F.coalesce(actual, F.lit("")).alias("actual"))


def conflicts(events: DataFrame) -> DataFrame:
    """entity_id, event_id, problem of what a replay cannot apply: a status change from another status, a record with changes
    but without a creation (event_id ""), and every creation of a record but its first."""
    return conflicts_of(replayable(events))


def conflicts_of(applied: DataFrame) -> DataFrame:
    status = _status_conflicts(applied).select("entity_id", "event_id", F.format_string("status is %s, not %s", F.col("actual"), F.col("expected")).alias("problem"))
    births = applied.where("kind = 'created'").select("entity_id", "id", F.struct("place_us", "seq").alias("place"))
    first = births.groupBy("entity_id").agg(F.min("place").alias("first"))
    again = births.join(first, "entity_id").where("place > first").select("entity_id", F.col("id").alias("event_id"), F.lit("created already").alias("problem"))
    unborn = applied.select("entity_id").distinct().join(first, "entity_id", "left_anti").select("entity_id", F.lit("").alias("event_id"), F.lit("no creation").alias("problem"))
    return status.unionByName(again).unionByName(unborn)


def payload_problems(events: DataFrame) -> DataFrame:
    """event_id, problem of each event whose payload does not have the shape of its kind."""
    keys = F.json_object_keys("payload")
    has = lambda *k: F.size(F.array_except(keys, F.array(*map(F.lit, k)))) == 0
    body = F.get_json_object("payload", "$.payload")
    problem = (
        F.when(~F.col("kind").isin(*DATA_KINDS, *META_KINDS), "unknown kind").when(keys.isNull(), "no object")
        .when(F.col("kind").isin("updated", "migrated") & (F.size(keys) == 0), "sets nothing")
        .when((F.col("kind") == "status_changed") & ~(has("to", "from") & F.array_contains(keys, "to")), "not {to, from?}")
        .when((F.col("kind") == "corrected") & ~(has("target", "payload") & (F.size(keys) == 2) & body.startswith("{")), "not {target, payload}")
        .when((F.col("kind") == "retracted") & ~has("target"), "not {} or {target}")
    )
    return events.select(F.col("id").alias("event_id"), problem.alias("problem")).where("problem is not null").distinct()


def first_changes(events: DataFrame) -> DataFrame:
    """entity_id, first_seq of every record with changes."""
    return events.groupBy("entity_id").agg(F.min("seq").alias("first_seq"))
