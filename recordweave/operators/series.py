"""Series: loading in revertible batches, and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _measures(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in keys and c != "batch_id"]


def classify(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Each point of the batch as inserted, updated or unchanged, with its image before (``before``, ``before_batch``).

    A batch that names a point twice, misses a key or has a row without a measure is refused as a whole: such rows
    come out as ``rejected``, and ``merge`` then keeps the current points.
    """
    measures = _measures(batch, keys)
    marked = batch.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*measures)).alias("after"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    empty = F.lit(True)
    for m in measures:
        empty = empty & F.col(f"after.{m}").isNull()
    old = current.select(*keys, F.struct(*measures).alias("before"), F.col("batch_id").alias("before_batch"))
    joined = marked.join(old, keys, "left")
    action = F.when(missing | empty | (F.col("_n") > 1), "rejected").when(F.col("before_batch").isNull(), "inserted").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("updated")
    return joined.select(*keys, action.alias("action"), "after", "before", "before_batch")


def merge(current: DataFrame, batch: DataFrame, keys: list[str], batch_id: str) -> DataFrame:
    """The points after a batch. Unchanged points keep their batch; a refused batch changes nothing."""
    changes = classify(current, batch, keys)
    refused = changes.where("action = 'rejected'").limit(1).count() > 0
    if refused:
        return current
    new = changes.where("action in ('inserted', 'updated')").select(*keys, "after.*", F.lit(batch_id).alias("batch_id"))
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def revert(current: DataFrame, changes: DataFrame, keys: list[str], batch_id: str) -> DataFrame:
    """The points before a batch; refused (ValueError) if a later batch has touched one of its points."""
    touched = changes.where("action in ('inserted', 'updated')")
    later = current.join(touched.select(*keys), keys, "left_semi").where(F.col("batch_id") != batch_id)
    if later.limit(1).count():
        raise ValueError(f"a later batch has changed points of {batch_id}; revert that one first")
    back = touched.where("action = 'updated'").select(*keys, "before.*", F.col("before_batch").alias("batch_id"))
    return current.join(touched.select(*keys), keys, "left_anti").unionByName(back.select(*current.columns))


def gaps(points: DataFrame, keys: list[str], time: str, low: object = None, high: object = None) -> DataFrame:
    """Per key: points, days expected between low and high (default: its first and last), and days without a point."""
    day = F.col(time).cast("date")
    inside = points.where((F.lit(low).isNull() | (day >= F.lit(low).cast("date"))) & (F.lit(high).isNull() | (day <= F.lit(high).cast("date"))))
    per_day = inside.select(*keys, day.alias("_d")).distinct()
    out = per_day.groupBy(*keys).agg(F.count("*").alias("points"), F.min("_d").alias("a"), F.max("_d").alias("b"))
    expected = F.datediff(F.coalesce(F.lit(high).cast("date"), F.col("b")), F.coalesce(F.lit(low).cast("date"), F.col("a"))) + 1
    return out.select(*keys, "points", expected.cast("long").alias("expected"), (expected - F.col("points")).cast("long").alias("missing"))
