from recordweave.operators.changefeed import apply_changes
from recordweave.streaming import feed as streaming
from recordweave.streaming.feed import buckets_for, current, daily_counts, fold, keep_current, latest_points, merge_points, read_feed, replay_batch
from replay_by_hand import COLUMNS, random_feed


def test_stream_equals_batch(spark, tmp_path):
    rows = random_feed(8)
    half = len(rows) // 2
    for i, part in enumerate((rows[:half], rows[half:], rows[:5])):  # the last file is delivered again
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = read_feed(spark, f"{tmp_path}/in", COLUMNS, 1)
        query = keep_current(feed, f"{tmp_path}/history", f"{tmp_path}/state", f"{tmp_path}/ckpt", 3).trigger(availableNow=True).start()
        query.awaitTermination(120)
    pick = lambda df: {(r.entity_id, tuple(sorted(r.doc.items())), r.last_event_id, r.retracted) for r in df.collect()}
    want = pick(apply_changes(spark.createDataFrame(rows, COLUMNS)))
    assert pick(current(spark, f"{tmp_path}/state")) == want
    fold(spark, f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/state").select("generation").distinct().count() == 1 and pick(current(spark, f"{tmp_path}/state")) == want == pick(apply_changes(spark.createDataFrame(rows, COLUMNS)))


def test_daily_counts(spark, tmp_path):
    spark.createDataFrame(random_feed(9), COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = daily_counts(read_feed(spark, f"{tmp_path}/in", COLUMNS)).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    expected = spark.read.parquet(f"{tmp_path}/in").where("at_precision = 'time'").count()
    assert sum(r.n for r in spark.table("daily").collect()) == expected


def test_only_touched_records_are_written(spark, tmp_path):
    rows = random_feed(8)
    df = spark.createDataFrame(rows, COLUMNS)
    one = df.select("entity_id").first().entity_id
    run = replay_batch(f"{tmp_path}/h", f"{tmp_path}/s", 4)
    run(df, 0)
    run(df.where(df.entity_id == one), 1)
    run(df.where(df.entity_id == one), 1)  # delivered again
    state = spark.read.parquet(f"{tmp_path}/s")
    assert {r.entity_id for r in state.where("generation = 1").collect()} <= {one}
    assert spark.read.parquet(f"{tmp_path}/h").count() == len(rows) + df.where(df.entity_id == one).count()
    assert buckets_for(spark.read.parquet(f"{tmp_path}/h")) == streaming.BUCKETS


def test_points_taken_in_again(spark, tmp_path):
    points = lambda *r: spark.createDataFrame(list(r), "k string, day string, v int")
    run = merge_points(f"{tmp_path}/p", ["k", "day"])
    run(points(("a", "1", 1), ("b", "1", 2)), 0)
    run(points(("a", "1", 5)), 1)
    run(points(("a", "1", 5)), 1)
    assert {tuple(r) for r in latest_points(spark, f"{tmp_path}/p", ["k", "day"]).collect()} == {("a", "1", 5), ("b", "1", 2)}
