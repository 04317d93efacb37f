import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.operators import moving


@pytest.mark.parametrize(("keys", "unit", "size"), [(["k"], "points", 5), (["k"], "points", 1), ([], "points", 12), (["k"], "days", 7), ([], "days", 40)])
def test_stretches_equal_one_window(spark, monkeypatch, keys, unit, size):
    monkeypatch.setattr(moving, "STRETCH_DAYS", 10)
    rng = random.Random(size)
    rows = [("a" if rng.random() < 0.7 else "b", f"2025-01-01 00:00:{i % 60:02d}.{i:06d}", rng.randrange(200), None if rng.random() < 0.1 else rng.randrange(50)) for i in range(400)]
    points = spark.createDataFrame(rows, "k string, s string, d int, v int").selectExpr("k", "CAST(s AS timestamp) + make_dt_interval(d) AS t", "v").dropDuplicates(["k", "t"])
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    over = over.orderBy("t").rowsBetween(-(size - 1), 0) if unit == "points" else over.orderBy(F.unix_date(F.col("t").cast("date"))).rangeBetween(-(size - 1), 0)
    want = sorted(map(tuple, points.withColumn("w", F.sum("v").over(over)).collect()), key=str)
    got = sorted(map(tuple, moving.moving(points, keys, "t", "v", "sum", size, unit, "w").select("k", "t", "v", "w").collect()), key=str)
    assert got == want and len(got) > 300
