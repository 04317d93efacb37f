"""Applying a stream of inserts, updates and deletes.

``apply_changes`` rebuilds the current state of every record from a feed with repeated, reordered,
corrected and voided changes, by newest-first resolution: changes are cut into batches of replay
order, the batches are taken backwards, each batch's newest image (or tombstone) per (record, field)
is kept unless a later batch has settled that key, and the created documents supply the fields no
change touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.operators.feed import DATA_KINDS, JSON_MAP, first_recordings, readable, status_payload, undated_places, voids_and_corrections
from recordweave.runtime import materialise

#: What a row of the resolution is: a field's image, a record's last applied change, its creation, its retraction.
FIELD, LAST, CREATED, RETRACTED = range(4)


def replayable(events: DataFrame) -> DataFrame:
    """Data events as the replay applies them: first recordings, voided ones left out, payloads corrected,
    with the place in replay order (``place_us``, ``seq``); created events come before all others.

    Columns: id, entity_id, entity_type, kind, payload, seq, at_us, place_us.
    """
    return replay_rows(readable(events))


def replay_rows(rows: DataFrame) -> DataFrame:
    """``replayable`` of readable rows."""
    voids, corrections = voids_and_corrections(rows)
    latest = corrections.where("void_us is null").select("entity_id", F.col("target").alias("id"), F.lit(None).cast("boolean").alias("voided"), F.struct("seq", "payload").alias("correction"), F.lit(None).cast("long").alias("place"))
    voided = voids.select("entity_id", F.col("target").alias("id"), F.lit(True).alias("voided"), F.lit(None).cast("struct<seq:bigint,payload:string>").alias("correction"), F.lit(None).cast("long").alias("place"))
    undated = undated_places(rows).select("entity_id", "id", F.lit(None).cast("boolean").alias("voided"), F.lit(None).cast("struct<seq:bigint,payload:string>").alias("correction"), F.col("place_us").alias("place"))
    notes = latest.unionByName(voided).unionByName(undated).groupBy("id", "entity_id").agg(F.max("voided").alias("voided"), F.max_by("correction.payload", "correction.seq").alias("corrected"), F.max("place").alias("place"))
    data = first_recordings(rows.where(F.col("kind").isin(*DATA_KINDS)), "entity_type", "kind", "payload", "at_us")
    joined = data.join(notes, ["id", "entity_id"], "left").where("voided is null")
    return joined.select("id", "entity_id", "entity_type", "kind", F.coalesce("corrected", "payload").alias("payload"), "seq", "at_us", F.coalesce("place", "at_us").alias("place_us"))


def apply_changes(events: DataFrame, batches: int = 4) -> DataFrame:
    """Current state per record: entity_id, entity_type, doc (field -> text, nulls left out), last_event_id, retracted.

    A record without a created event that holds gives no row. Repeated deliveries, equal times (recording
    order decides), empty feeds and feeds with further columns are handled; an unreadable payload sets nothing,
    a field may have any name, and of a name that a payload has twice the last value counts.

    Jobs run while the plan is built: the applied changes and what the middle batches settle are written.
    """
    rows = readable(events)
    spans = rows.agg(F.min("at_us").alias("a"), F.max("at_us").alias("b")).first()
    low, high = (spans.a or 0), (spans.b or 0)
    width = max(1, -(-(high - low + 1) // batches))
    age = F.greatest(F.lit(0), F.least(F.lit(batches - 1), F.floor((F.lit(high) - F.col("place_us")) / width)))
    applied = with_age(replay_rows(rows).drop("at_us"), age, batches)
    return resolved(materialise(applied, "applied", "age"), rows, batches)  # by batch, so that each reads its own


def with_age(applied: DataFrame, age: Column, batches: int) -> DataFrame:
    """Applied changes with their batch, counted from the newest; creations come in a batch after all others."""
    return applied.withColumn("age", F.when(F.col("kind") == "created", batches).otherwise(age).cast("int"))


def resolved(applied: DataFrame, rows: DataFrame, batches: int) -> DataFrame:
    """``apply_changes`` of applied changes with ``age``; of ``rows``, the readable feed, only retractions are read."""
    piece = lambda what, field, value: F.struct(F.lit(what).alias("what"), field.alias("field"), value.alias("value"))
    fields = F.map_entries(status_payload(F.col("kind"), F.col("payload")))
    images = F.concat(F.array(piece(LAST, F.lit(""), F.col("id"))), F.coalesce(F.transform(fields, lambda e: piece(FIELD, e["key"], e["value"])), F.array()))
    key = ["entity_id", "what", "field"]
    settled = None
    for k in range(batches):  # newest first
        batch = applied.where(F.col("age") == k).select("entity_id", "place_us", "seq", F.posexplode(images).alias("k", "p"))
        newest = F.max_by(F.struct("p.value"), F.struct("place_us", "seq", "k"))  # of a name given twice the last value
        batch = batch.groupBy("entity_id", F.col("p.what").alias("what"), F.col("p.field").alias("field")).agg(newest.alias("image"))
        settled = batch if settled is None else settled.unionByName(batch.join(settled, key, "left_anti"))
        if 0 < k < batches - 1:
            settled = materialise(settled, f"settled-{k}")

    no = F.lit(None).cast("struct<id:string,entity_type:string,payload:string>").alias("made")
    made = F.when(F.lit(True), F.struct("id", "entity_type", "payload")).alias("made")
    nothing = [F.lit("").alias("field"), F.lit(None).cast("string").alias("value")]
    births = applied.where(F.col("age") == batches).select("entity_id", F.lit(CREATED).alias("what"), *nothing, made, F.struct("place_us", "seq").alias("place"))
    gone = rows.where("kind = 'retracted' and target_event_id is null").select("entity_id", F.lit(RETRACTED).alias("what"), *nothing, no)
    never = F.lit(None).cast("struct<place_us:bigint,seq:bigint>").alias("place")
    parts = settled.select(*key, "image.value", no, never).unionByName(births).unionByName(gone.withColumn("place", never))
    is_ = lambda what: F.col("what") == what
    state = parts.groupBy("entity_id").agg(
        F.min_by("made", "place").alias("made"), F.collect_list(F.when(is_(FIELD), F.struct("field", "value"))).alias("changed"),
        F.max(F.when(is_(LAST), F.col("value"))).alias("last"), F.max(is_(RETRACTED)).alias("retracted"),
    ).where("made is not null")
    # base values of what no batch has settled come last
    touched = F.transform("changed", lambda c: c["field"])
    untouched = F.filter(entries(F.from_json("made.payload", JSON_MAP)), lambda e: ~F.array_contains(touched, e["key"]))
    fields = F.filter(F.concat(F.transform("changed", lambda c: F.struct(c["field"].alias("key"), c["value"].alias("value"))), untouched), lambda e: e["value"].isNotNull())
    return state.select(
        "entity_id", F.col("made.entity_type").alias("entity_type"), F.map_from_entries(fields).alias("doc"), F.coalesce("last", "made.id").alias("last_event_id"), "retracted",
    )


def entries(fields: Column) -> Column:
    """The entries of a parsed payload; of a name that stands in it twice the last."""
    every = F.map_entries(F.coalesce(fields, F.create_map().cast(JSON_MAP)))
    names = F.transform(every, lambda e: e["key"])
    last = F.filter(every, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return F.when(F.size(F.array_distinct(names)) == F.size(names), every).otherwise(last)


def p1_found(events: DataFrame) -> DataFrame:
    """entity_id, status, expected_rate, n_fields, last_event_id of every record that is not retracted as a whole."""
    state = apply_changes(events).where(~F.col("retracted"))
    text = lambda f: F.coalesce(F.col("doc")[f], F.lit("")).alias(f)
    return state.select("entity_id", text("status"), text("expected_rate"), F.size("doc").cast("long").alias("n_fields"), "last_event_id")
