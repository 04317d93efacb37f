"""As-of join: the latest value at or before a row's own time, per key.

Both sides are cut into blocks of time. Each block's last value is combined map-side, carried over the blocks of its
key, and rows are ordered only inside their block, so a key of any length stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: Column, at: Column, right_key: Column, right_at: Column, value: Column, name: str, block: int = 64, strict: bool = False) -> DataFrame:
    """``left`` with ``name`` (the value) and ``name_t`` (its time): the right row of the same key with the greatest
    time at or before ``at`` (before it, if ``strict``) whose value is not null; null where there is none.

    ``at`` and ``right_at`` are integers (days, microseconds); ``block`` is their span per block. Null keys and times
    match nothing; of values at one time the greatest is taken.
    """
    part = lambda c: F.floor(c / F.lit(block)).cast("long")
    seen = right.select(right_key.alias("_k"), right_at.cast("long").alias("_t"), value.alias("_v")).where("_k is not null and _t is not null and _v is not null")
    seen = seen.groupBy("_k", "_t").agg(F.max("_v").alias("_v")).withColumn("_b", part(F.col("_t")))
    mine = left.withColumn("_k", key).withColumn("_t", at.cast("long")).withColumn("_b", part(F.col("_t")))
    pair = F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))
    ends = seen.groupBy("_k", "_b").agg(F.max(pair).alias("p"))
    asked = mine.where("_k is not null and _t is not null").select("_k", "_b").distinct().withColumn("p", F.lit(None).cast(ends.schema["p"].dataType))
    blocks = ends.unionByName(asked).groupBy("_k", "_b").agg(F.max("p").alias("p"))
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select("_k", "_b", F.max("p").over(before).alias("_c"))

    columns = left.columns
    none = F.lit(None)
    rows = mine.select("_k", "_t", "_b", F.struct(*columns).alias("_row"), none.cast(ends.schema["p"].dataType).alias("_p"))
    marks = seen.select("_k", "_t", "_b", none.cast(rows.schema["_row"].dataType).alias("_row"), pair.alias("_p"))
    upto = -1 if strict else 0
    inside = W.partitionBy("_k", "_b").orderBy("_t").rangeBetween(W.unboundedPreceding, upto)
    merged = rows.unionByName(marks).withColumn("_near", F.max("_p").over(inside)).where("_row is not null")
    joined = merged.join(carried, ["_k", "_b"], "left")
    best = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_near", "_c"))
    return joined.select("_row.*", best["v"].alias(name), best["t"].alias(f"{name}_t"))
