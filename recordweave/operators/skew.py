"""Joins in which a few keys may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the left rows (and at least HOT_ROWS) is spread over SALT tasks; at most 1/HOT_SHARE keys are.
HOT_SHARE = 0.001
HOT_ROWS = 10_000
SALT = 64


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> list[tuple]:
    """The keys of ``counts`` (one row per key, with its rows) that are hot; at most 1/HOT_SHARE come to the driver."""
    busy = counts.where(F.col(n) >= HOT_ROWS)
    if busy.isEmpty():
        return []
    total = counts.agg(F.sum(n)).first()[0]
    return [tuple(r[k] for k in keys) for r in busy.where(F.col(n) >= F.lit(max(HOT_ROWS, HOT_SHARE * total))).select(*keys).collect()]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list[tuple] | None = None) -> DataFrame:
    """Inner join on ``keys``. Hot keys of the left side (found by a count that combines map-side, unless given) are dealt
    out over SALT tasks, to each of which the right side's rows of the key are copied; all other keys join as they are.
    Rows with a null key join nothing."""
    if hot is None:
        hot = hot_keys(left.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    hot = [h for h in hot if None not in h]
    if not hot:
        return left.join(right, keys)
    is_hot = lambda: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys, h)]) for h in hot]) if len(keys) > 1 else F.col(keys[0]).isin([h[0] for h in hot])
    spread = F.when(is_hot(), F.pmod(F.xxhash64(*left.columns), F.lit(SALT))).otherwise(F.lit(0)).cast("int")
    copies = F.when(is_hot(), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", spread).join(right.withColumn("_salt", F.explode(copies)), [*keys, "_salt"]).drop("_salt")
