from datetime import timedelta

from recordweave.operators.lateness import arrival_cells, arrival_triangle, late_events
from replay_by_hand import COLUMNS, START, row

DAY = timedelta(days=1)
US = timedelta(microseconds=1)


def test_edges_of_the_day_and_of_the_cut_off(spark):
    noon, end = START + DAY / 2, START + DAY
    cases = {"before": end - US, "at_end": end, "week": end + 7 * DAY, "over": end + 7 * DAY + US, "month": end + 30 * DAY}
    rows = [row(i + 1, k, "x", "updated", {"a": 1}, noon, t) for i, (k, t) in enumerate(cases.items())]
    rows += [row(9, "at_end", "x", "updated", {"a": 1}, noon, end + 20 * DAY), row(10, "dated", "x", "updated", {"a": 1}, noon, end + DAY, precision="date"), row(11, None, "x", "updated", {}, noon, end)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS revision", "'p' AS period", "2 AS n")
    assert {(r.event_id, r.period, r.outcome) for r in late_events(df).collect()} == {
        ("at_end", "2025-01-01", "corrects"), ("week", "2025-01-01", "corrects"), ("over", "2025-01-01", "dropped"), ("month", "2025-01-01", "dropped"),
    }


def test_times_without_an_offset_fall_in_no_cell(spark):
    rows = [row(1, "a", "x", "updated", {}, START, START + 2 * DAY)]
    bare = [tuple(v.replace("+00:00", "") if isinstance(v, str) and v.startswith("20") else v for v in row(2, "b", "x", "updated", {}, START, START + 2 * DAY))]
    assert [r.id for r in arrival_cells(spark.createDataFrame(rows + bare, COLUMNS)).collect()] == ["a"]


def test_triangle_adds_up(spark):
    rows = [row(i, f"e{i}", "x", "updated", {"a": 1}, START + timedelta(hours=i), START + timedelta(hours=i * 9)) for i in range(1, 120)]
    out = arrival_triangle(arrival_cells(spark.createDataFrame(rows, COLUMNS))).collect()
    assert sum(r.arrived for r in out) == 119
    for r in out:
        assert r.corrected == sum(x.arrived for x in out if x.period == r.period and x.revision <= r.revision)
        kept = [x.arrived for x in out if x.period == r.period and x.revision <= 7]
        assert r.final_count == (sum(kept) if kept else None)


def test_empty(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert late_events(df).count() == 0
