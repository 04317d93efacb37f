"""Moving windows over series whose keys may hold any share of all points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a key's points that one task orders.
STRETCH_DAYS = 4_096


def moving(points: DataFrame, keys: list[str], time: str, measure: str, agg: str, size: int, unit: str, name: str) -> DataFrame:
    """``points`` with ``name``: avg, min, max or sum of ``measure`` over the ``size`` points of the key up to and with the
    point (unit ``points``), or over the points of the ``size`` days up to and with its day (``days``).

    Every key's points are cut into stretches of days. A stretch takes in the points before it that its windows reach: those
    of the days before (days), or as many as the window holds (points), which the stretch before hands over, and if it has
    too few, those before it. So a key of any length is ordered in pieces, the empty key of a series without one too.
    """
    if not keys:
        return moving(points.withColumn("_all", F.lit(0)), ["_all"], time, measure, agg, size, unit, name).drop("_all")
    day = F.unix_date(F.col(time).cast("date")).cast("long")
    marked = points.withColumn("_day", day).withColumn("_s", F.floor(F.col("_day") / STRETCH_DAYS).cast("long"))
    needed = [*keys, time, measure, "_day", "_s"]
    if unit == "days":
        reach = F.sequence(F.col("_s"), F.floor((F.col("_day") + F.lit(size - 1)) / STRETCH_DAYS).cast("long"))
        lent = marked.select(*needed[:-1], F.explode(reach).alias("_to"), "_s").where("_to > _s")
    else:
        lent = _last_points(marked.select(*needed), keys, time, size)
    own = marked.withColumn("_own", F.lit(True)).withColumnRenamed("_s", "_to")
    lent = lent.drop("_s").join(own.select(*keys, "_to").distinct(), [*keys, "_to"], "left_semi").withColumn("_own", F.lit(False))
    both = own.unionByName(lent, allowMissingColumns=True)
    over = W.partitionBy(*keys, "_to")
    over = over.orderBy(time).rowsBetween(-(size - 1), 0) if unit == "points" else over.orderBy("_day").rangeBetween(-(size - 1), 0)
    result: Column = getattr(F, agg)(measure).over(over)
    return both.withColumn(name, result).where("_own").drop("_day", "_to", "_own")


def _last_points(rows: DataFrame, keys: list[str], time: str, size: int) -> DataFrame:
    """For every stretch the ``size`` - 1 points of its key before it, as rows with the stretch in ``_to``.

    The points of a stretch are counted and summed from its end backwards over stretches (one row each), which tells how far
    back every stretch has to reach; then each point is handed to the stretches that reach it.
    """
    counts = rows.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    order = W.partitionBy(*keys).orderBy("_s")
    ends = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = rows.join(ends.select(*keys, "_s", "_before", "_n"), [*keys, "_s"])
    inside = F.row_number().over(W.partitionBy(*keys, "_s").orderBy(time))
    place = place.withColumn("_at", F.col("_before") + inside)  # the point's number in its key
    # a stretch that begins after number b reaches the points numbered above b - (size - 1)
    tail = place.where(F.col("_at") > F.col("_before") + F.col("_n") - F.lit(size - 1))
    # stretches are few per key: each is paired with those whose last points it needs
    reach = ends.select(*keys, F.col("_s").alias("_to"), F.greatest(F.lit(0), F.col("_before") - F.lit(size - 1)).alias("_from"))
    spans = ends.select(*keys, "_s", (F.col("_before") + F.col("_n")).alias("_hi"))
    pairs = reach.join(spans, keys).where("_s < _to and _hi > _from").select(*keys, "_s", "_to", "_from")
    return tail.join(pairs, [*keys, "_s"]).where("_at > _from").drop("_before", "_n", "_at", "_from")
