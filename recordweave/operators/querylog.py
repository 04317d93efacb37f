"""The log of questions: views and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.functions.times import instant_us

KEEP_SHARE = 0.2
FILL = 0.9


def view(log: DataFrame, which: str, n: int = 50) -> DataFrame:
    """The newest n (1..500) rows that are errors, diverging, empty, with warnings, or on one path; "recent" takes all."""
    n = max(1, min(500, n))
    chosen = {
        "recent": F.lit(True), "errors": F.col("error").isNotNull(), "diverging": F.col("diverging"),
        "empty": F.col("result_total") == 0, "warnings": F.size("warnings") > 0,
    }.get(which, F.col("path") == which)
    return log.where(chosen).orderBy(F.col("id").desc()).limit(n)


def by_path(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(F.count("*").alias("n"))


def readings(log: DataFrame) -> DataFrame:
    """question_norm, plans (different SQL texts it was answered with), asked: more than one plan means that the reading of
    the question has moved."""
    return log.where("question_norm is not null").groupBy("question_norm").agg(F.countDistinct("sql").alias("plans"), F.count("*").alias("asked"))


def variants(log: DataFrame) -> DataFrame:
    """question_norm, sql, n, first_id, last_id: every plan a question was answered with."""
    return log.where("question_norm is not null and sql is not null").groupBy("question_norm", "sql").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def trace_totals(traces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """calls and the sums of every numeric column (tokens, cost, milliseconds) of traces, over all or per group."""
    sums = [F.sum(c).alias(c) for c, t in traces.dtypes if c not in (by or []) and (t in ("int", "bigint", "float", "double") or t.startswith("decimal"))]
    return traces.groupBy(*(by or [])).agg(F.count("*").alias("calls"), *sums)


def summaries(results: DataFrame, by: list[str], seconds: str, correct: str) -> DataFrame:
    """Per group: runs, mean and 95th percentile (interpolated) of the seconds, and the share of correct answers."""
    return results.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(seconds).alias("mean"), F.percentile(seconds, F.lit(0.95)).alias("p95"), F.avg(F.col(correct).cast("double")).alias("share"))


def purged(log: DataFrame, before: str | None = None) -> DataFrame:
    """The log without the rows asked before an instant (compared as instants); without one, nothing stays."""
    return log.limit(0) if before is None else log.where(instant_us(F.col("asked_at")) >= instant_us(F.lit(before)))


def retained(log: DataFrame, max_rows: int, max_bytes: int, block: int = 1 << 16) -> DataFrame:
    """The rows that stay. Nothing goes while both limits hold; then the newest errors and diverging rows stay within a
    fifth of max_rows, and the newest others until nine tenths of either limit are used.

    Running sums go over blocks of ids first, so no task orders the whole log.
    """
    sizes = log.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    if sizes.n <= max_rows and (sizes.b or 0) <= max_bytes:
        return log
    special = F.col("error").isNotNull() | F.coalesce("diverging", F.lit(False))
    rows = log.withColumn("_s", special).withColumn("_b", F.expr(f"id div {block}"))

    def running(df: DataFrame) -> DataFrame:
        totals = df.groupBy("_b").agg(F.count("*").alias("_n"), F.sum("size").alias("_z"))
        newer = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)  # one row per block of ids
        head = totals.select("_b", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_z").over(newer), F.lit(0)).alias("_z0"))
        inside = W.partitionBy("_b").orderBy(F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
        return df.join(head, "_b").withColumn("_rows", F.col("_n0") + F.count("*").over(inside)).withColumn("_bytes", F.col("_z0") + F.sum("size").over(inside))

    kept = running(rows.where("_s")).where(F.col("_rows") <= int(KEEP_SHARE * max_rows)).select(*log.columns)
    used = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    others = running(rows.where("not _s")).where((F.col("_rows") <= int(FILL * max_rows) - used.n) & (F.col("_bytes") <= int(FILL * max_bytes) - used.b))
    return kept.unionByName(others.select(*log.columns))
