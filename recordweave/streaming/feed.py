"""The change feed as a stream.

Late, corrected and voided changes can alter any earlier state of a record, so a micro-batch is not folded into a state
store with a watermark: the records it touches are replayed from their whole history, which is exact, and their rows are
put beside the state as a new generation. The history lies in buckets of the record id, so a micro-batch reads the buckets
of its records only, replays these records only, and writes these records only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from recordweave.operators.changefeed import apply_changes
from recordweave.operators.skew import salted_join
from recordweave.runtime import delete, input_bytes

#: Bytes of history per bucket for which the number of buckets is chosen.
BUCKET_BYTES = 128 << 20
BUCKETS = 64
#: Generations of the state from which they are folded into one.
MOST_GENERATIONS = 32


def buckets_for(feed: DataFrame, growth: float = 4.0) -> int:
    """Buckets for a feed that is expected to grow ``growth`` times: a power of two, at least BUCKETS."""
    wanted, n = input_bytes(feed) * growth / BUCKET_BYTES, BUCKETS
    while n < wanted:
        n *= 2
    return n


def bucketed(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int"))


def replay_batch(history: str, state: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: appends the batch to ``history`` and puts the records it touches into ``state``.

    A batch has its folder in the history and its generation in the state by its number, and replaces them when it is
    delivered again, so a restart neither repeats changes nor lets the history grow.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            touched = [r.bucket for r in bucketed(batch, buckets).select("bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                return
            bucketed(batch, buckets).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(history)
            ids = batch.select("entity_id").distinct()
            past = spark.read.parquet(history).where(F.col("bucket").isin(touched)).drop("bucket", "batch")
            now = apply_changes(salted_join(past, ids, ["entity_id"]), 1)
            now.withColumn("generation", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(state)
            if number and number % MOST_GENERATIONS == 0:
                fold(spark, state)
        finally:
            batch.unpersist()

    return run


def current(spark: SparkSession, state: str) -> DataFrame:
    """The state: the newest generation of every record."""
    rows = spark.read.parquet(state)
    others = [c for c in rows.columns if c not in ("entity_id", "generation")]
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(*others), "generation").alias("r")).select("entity_id", "r.*")


def fold(spark: SparkSession, state: str) -> None:
    """Folds the generations of a state into its newest. The folded rows are written aside first, so they are whole before any
    generation goes; a fold that is cut short leaves generations that say the same twice."""
    newest = spark.read.parquet(state).agg(F.max("generation")).first()[0]
    aside = f"{state.rstrip('/')}-folded"
    current(spark, state).write.mode("overwrite").parquet(aside)
    spark.read.parquet(aside).withColumn("generation", F.lit(newest)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(state)
    for r in [x.generation for x in spark.read.parquet(state).select("generation").distinct().collect()]:  # at most a fold's worth
        if r < newest:
            delete(spark, f"{state.rstrip('/')}/generation={r}")
    delete(spark, aside)


def merge_points(points: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a series that is taken in again: of a point the last batch counts (``latest_points``), and
    a batch that is delivered again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        one = batch.groupBy(*keys).agg(F.last(F.struct(*[c for c in batch.columns if c not in keys])).alias("r")).select(*keys, "r.*")
        one.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(points)

    return run


def latest_points(spark: SparkSession, points: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(points)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def read_feed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """The append-only feed as a stream of parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_current(feed: DataFrame, history: str, state: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """The writer that keeps ``state`` current; start it with a trigger of your own and read it with ``current``."""
    return feed.writeStream.foreachBatch(replay_batch(history, state, buckets)).option("checkpointLocation", checkpoint)


def daily_counts(feed: DataFrame, cut_off: str = "7 days") -> DataFrame:
    """Changes per day of happening as a watermarked streaming aggregate; what comes after the cut-off is left out."""
    timed = feed.withColumn("moment", F.col("at").try_cast("timestamp")).where("moment is not null and at_precision = 'time'")
    return timed.withWatermark("moment", cut_off).groupBy(F.window("moment", "1 day").alias("day")).agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "n")
