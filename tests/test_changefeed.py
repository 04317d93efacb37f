from collections import defaultdict

import pytest

from recordweave.operators import changefeed, feed, history
from replay_by_hand import COLUMNS, START, events_of, random_feed, replayed, row, text


def by_record(rows):
    out = defaultdict(list)
    for e in events_of(rows):
        out[e["entity_id"]].append(e)
    return out


def expected(rows):
    want = {}
    for name, events in by_record(rows).items():
        doc, last, _ = replayed(events)
        if doc is not None and not any(e["kind"] == "retracted" and not e["target_event_id"] for e in events):
            want[name] = (text(doc.get("status")), text(doc.get("expected_rate")), sum(v is not None for v in doc.values()), last)
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_the_plain_one(spark, seed, monkeypatch):
    monkeypatch.setattr(feed, "BLOCK", 16)  # histories cross blocks of recording numbers
    rows = random_feed(seed)
    got = {r.entity_id: (r.status, r.expected_rate, r.n_fields, r.last_event_id) for r in changefeed.p1_found(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == expected(rows)


def test_statuses_reached_in_order(spark):
    rows = random_feed(4)
    want = {n: had for n, e in by_record(rows).items() for doc, _, had in [replayed(e)] if doc is not None}
    got = {r.entity_id: r.reached for r in history.statuses_reached(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {n: h for n, h in got.items() if n in want} == want


def test_fields_of_any_name_and_names_given_twice(spark):
    rows = [row(1, "a", "x", "created", {"": "e", "status": "new", "what": 1}, START, START), row(2, "b", "x", "updated", {"": "f", "field": "g"}, START, START), row(3, "c", "y", "created", {"k": None, "": "h"}, START, START)]
    rows += [tuple('{"s": "old", "s": "last"}' if v == '{"twice": 1}' else v for v in row(4, "d", "z", kind, {"twice": 1}, START, START)) for kind in ("created",)]
    state = {r.entity_id: (r.doc, r.last_event_id) for r in changefeed.apply_changes(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert state == {"x": ({"": "f", "status": "new", "what": "1", "field": "g"}, "b"), "y": ({"": "h"}, "c"), "z": ({"s": "last"}, "d")}


def test_empty_feed(spark):
    assert changefeed.p1_found(spark.createDataFrame([], COLUMNS)).count() == 0


def test_nulls_ties_and_clashing_columns(spark):
    rows = [
        row(1, "a", "x", "created", {"status": "applied", "k": None}, START, START),
        row(2, "b", "x", "updated", {"expected_rate": 1}, START, START),
        row(3, "c", "x", "updated", {"expected_rate": 2}, START, START),  # same time: the later recording wins
        row(4, None, "x", "updated", {"expected_rate": 9}, START, START),
        row(5, "d", None, "updated", {"expected_rate": 9}, START, START),
        row(6, "e", "x", "updated", "no json", START, START),
        row(7, "f", "x", "updated", None, START, START),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("place_us", "age", "field", "value", "voided", "r"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    got = changefeed.p1_found(df).collect()
    assert [(r.status, r.expected_rate, r.n_fields) for r in got] == [("applied", "2", 2)]


def test_whole_retraction_and_lost_creation(spark):
    rows = [
        row(1, "a", "gone", "created", {"status": "applied"}, START, START), row(2, "b", "gone", "retracted", {}, START, START),
        row(3, "c", "lost", "created", {"status": "applied"}, START, START), row(4, "d", "lost", "retracted", {"target": "c"}, START, START, "c"),
        row(5, "e", "kept", "created", {"status": "applied"}, START, START), row(6, "f", "gone", "retracted", {"target": "e"}, START, START, "e"),
    ]
    assert [r.entity_id for r in changefeed.p1_found(spark.createDataFrame(rows, COLUMNS)).collect()] == ["kept"]


def test_payload_problems(spark):
    rows = [
        row(1, "a", "x", "status_changed", {"from": "b"}, START, START), row(2, "b", "x", "updated", {}, START, START),
        row(3, "c", "x", "odd", {}, START, START), row(4, "d", "x", "retracted", {"target": "a"}, START, START), row(5, "e", "x", "corrected", {"target": "a"}, START, START),
    ]
    assert {r.event_id for r in history.payload_problems(spark.createDataFrame(rows, COLUMNS)).collect()} == {"a", "b", "c", "e"}
