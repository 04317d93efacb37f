"""Shared steps on a change feed: first recordings, voids, corrections, and the place of undated events.

A feed row has ``id, entity_id, kind, payload, at, recorded_at, seq, at_precision, target_event_id``.
Rows without ``id``, ``entity_id``, ``kind``, ``seq`` or a readable ``at`` address nothing and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.functions.times import ZONED, instant_us

DATA_KINDS = ("created", "updated", "status_changed", "migrated")
META_KINDS = ("corrected", "retracted")
FIRST = -(2**62)
#: Recording numbers per block when one record's history is cut into blocks.
BLOCK = 1 << 18

JSON_MAP = "map<string,string>"


def readable(events: DataFrame) -> DataFrame:
    """The addressable rows with ``at_us`` and ``rec_us``; a null precision counts as exact time."""
    rows = events.where(F.col("at").rlike(ZONED)).select(  # tested here, so that the filter below repeats only the cast
        "id", "entity_id", "entity_type", "kind", "payload", F.col("seq").cast("long").alias("seq"),
        F.unix_micros(F.col("at").try_cast("timestamp")).alias("at_us"), instant_us(F.col("recorded_at")).alias("rec_us"),
        F.coalesce("at_precision", F.lit("time")).alias("at_precision"),
        F.when(F.col("target_event_id") != "", F.col("target_event_id")).alias("target_event_id"),
    )
    return rows.where("id is not null and entity_id is not null and kind is not null and seq is not null and at_us is not null")


def first_recordings(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per (id, entity_id): the recording of lowest seq. Map-side combined, so an id that is
    delivered very often costs no skew; the result is partitioned by (id, entity_id)."""
    kept = F.struct("seq", *[c for c in columns if c != "seq"])
    return rows.groupBy("id", "entity_id").agg(F.min_by(kept, "seq").alias("r")).select("id", "entity_id", "r.*")


def status_payload(kind: Column, payload: Column) -> Column:
    """The payload as field -> text; a status change is an update of the field ``status``."""
    fields = F.from_json(payload, JSON_MAP)
    return F.when(kind == "status_changed", F.create_map(F.lit("status"), fields["to"])).otherwise(fields)


def voids_and_corrections(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(voids, corrections)`` of readable rows.

    voids: entity_id, target, known_us (when the first void of the target was known).
    corrections: entity_id, target, id, seq, known_us, void_us (null: never voided), payload.
    Both act on events of their own record only.
    """
    meta = first_recordings(rows.where(F.col("kind").isin(*META_KINDS) & F.col("target_event_id").isNotNull()), "kind", "payload", "at_us", "rec_us", "target_event_id")
    meta = meta.withColumn("known_us", F.greatest("at_us", F.coalesce("rec_us", "at_us")))
    voids = meta.where("kind = 'retracted'").groupBy("entity_id", F.col("target_event_id").alias("target")).agg(F.min("known_us").alias("known_us"))
    corrected = meta.where("kind = 'corrected'").select("entity_id", F.col("target_event_id").alias("target"), "id", "seq", "known_us", F.get_json_object("payload", "$.payload").alias("payload"))
    own = voids.select("entity_id", F.col("target").alias("id"), F.col("known_us").alias("void_us"))
    return voids, corrected.where("payload is not null").join(own, ["entity_id", "id"], "left")


def undated_places(rows: DataFrame) -> DataFrame:
    """(id, entity_id, place_us) of each event of unknown time: the latest known time recorded before it
    in its record, or FIRST where there is none.

    A running maximum in two levels: blocks of recording numbers are combined first, and rows are
    ordered only inside the blocks that hold an undated event, so a record of any length stays spread.
    Redelivered copies change nothing, as each has the time of its first recording.
    """
    undated = F.col("at_precision") == "unknown"
    slim = rows.select("entity_id", "seq", F.when(undated, F.col("id")).alias("id"), F.when(~undated, F.col("at_us")).alias("known"), F.expr(f"seq div {BLOCK}").alias("block"))
    needed = slim.where("id is not null").select("entity_id", "block").distinct()
    before = W.partitionBy("entity_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = slim.groupBy("entity_id", "block").agg(F.max("known").alias("known")).select("entity_id", "block", F.max("known").over(before).alias("carried"))
    inside = W.partitionBy("entity_id", "block").orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
    placed = slim.join(needed, ["entity_id", "block"], "left_semi").withColumn("near", F.max("known").over(inside)).where("id is not null")
    placed = placed.join(carried, ["entity_id", "block"], "left")
    place = F.coalesce(F.greatest("near", "carried"), F.lit(FIRST))
    return placed.groupBy("id", "entity_id").agg(F.min_by(place, "seq").alias("place_us"))
