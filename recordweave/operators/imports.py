"""Idempotent imports: differences of a source from the state, vanished keys, several sources combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(source: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Per source row: key, action (created, unchanged, updated) and the changed fields (sorted, joined by ",").
    Fields absent from the source count as removed; equal nulls are no change. Keys must be unique on both sides."""
    fields = [c for c in source.columns if c != key]
    old = state.select(key, F.struct(*fields).alias("_old"), F.lit(True).alias("_there"))
    joined = source.select(key, F.struct(*fields).alias("_new")).join(old, key, "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")), F.lit(f)) for f in sorted(fields)]))
    action = F.when(F.col("_there").isNull(), "created").when(F.size(changed) == 0, "unchanged").otherwise("updated")
    return joined.select(key, action.alias("action"), F.when(F.col("_there"), F.array_join(changed, ",")).otherwise("").alias("changed"))


def outcomes(source: DataFrame, state: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """Per source document (key, doc: JSON text): ``action`` and the ``payload`` of the event that brings the state to it.

    ``created``: the whole document. ``unchanged``: no event. ``updated``: the fields that differ, a null for each that is
    gone. With ``whole`` a difference is a correction of the record's creation (``corrected``), whose payload is the whole
    document. Values are compared as JSON, so spelling and the order of fields are no change."""
    new = source.select(key, F.from_json("doc", "map<string,variant>").alias("_new"), F.col("doc").alias("_doc"))
    old = state.select(key, F.from_json("doc", "map<string,variant>").alias("_old"), F.lit(True).alias("_there"))
    joined = new.join(old, key, "left")
    text = lambda m: F.transform_values(F.map_filter(m, lambda k, v: ~F.is_variant_null(v)), lambda k, v: F.to_json(v))
    a, b = text(F.col("_new")), text(F.coalesce("_old", F.create_map().cast("map<string,variant>")))
    differ = F.map_filter(a, lambda k, v: ~b[k].eqNullSafe(v))
    gone = F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k))
    patch = F.map_concat(differ, F.transform_values(gone, lambda k, v: F.lit("null")))
    fields = F.transform(F.array_sort(F.map_entries(patch)), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    made = joined.withColumn("_n", F.size(patch)).withColumn("_patch", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))
    action = F.when(F.col("_there").isNull(), "created").when(F.col("_n") == 0, "unchanged").otherwise("corrected" if whole else "updated")
    payload = F.when(F.col("_there").isNull(), F.col("_doc")).when(F.col("_n") > 0, F.col("_doc") if whole else F.col("_patch"))
    return made.select(key, action.alias("action"), payload.alias("payload"))


def vanished(source: DataFrame, state: DataFrame, key: str, owned: Column | None = None, created_by: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Keys of the state that the source no longer has. ``owned`` is a condition on state rows that are the source's to
    report; ``created_by`` (events, recorder) keeps the records (entity_id = the state's ``id``) whose creation that recorder made."""
    mine = state if owned is None else state.where(owned)
    if created_by is not None:
        events, recorder = created_by
        made = events.where((F.col("kind") == "created") & (F.col("recorded_by") == recorder)).select(F.col("entity_id").alias("id")).distinct()
        mine = mine.join(made, "id", "left_semi")
    return mine.select(key).distinct().join(source.select(key), key, "left_anti")


def combine(first: DataFrame, second: DataFrame, key: str, field: str, how: str) -> DataFrame:
    """Two sources of one field: key, value, present (sources that have it), mismatch (absent in one, or different).

    ``first``: the first source that has a value; ``any``: true if one says so; ``union``: all list items in order.
    """
    a = first.groupBy(key).agg(F.first(field, True).alias("_a"))
    b = second.groupBy(key).agg(F.first(field, True).alias("_b"))
    both = a.join(b, key, "full_outer")
    value = {
        "first": lambda: F.coalesce("_a", "_b"),
        "any": lambda: F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)),
        "union": lambda: F.array_distinct(F.concat(F.coalesce("_a", F.array()), F.coalesce("_b", F.array()))),
    }[how]()
    present = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    return both.select(key, value.alias(field), present.cast("long").alias("present"), (~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatch"))
