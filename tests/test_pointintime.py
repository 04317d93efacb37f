from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest

from recordweave.operators import feed, pointintime
from replay_by_hand import COLUMNS, events_of, random_feed, replayed, text


def expected(rows):
    events = events_of(rows)
    records = defaultdict(list)
    for e in events:
        records[e["entity_id"]].append(e)
    want = {}
    for o in events:
        if o["kind"] == "status_changed" and o["at_precision"] == "time" and o["body"]["to"] in ("passed", "rejected"):
            doc, _, had = replayed([e for e in records[o["entity_id"]] if e["t"] < o["t"] and e["rec"] < o["t"]])
            want[o["id"]] = ("", "", "") if doc is None else (text(doc.get("status")), text(doc.get("expected_rate")), ",".join(sorted(had)))
    return want


@pytest.mark.parametrize(("seed", "long_record"), [(1, 20_000), (2, 20_000), (1, 4), (5, 6)])
def test_as_known_equals_replay_of_what_was_known(spark, monkeypatch, seed, long_record):
    monkeypatch.setattr(feed, "BLOCK", 16)
    monkeypatch.setattr(pointintime, "LONG_RECORD", long_record)  # small: records are cut into slices of time
    monkeypatch.setattr(pointintime, "GROUP_ROWS", 40)
    rows = random_feed(seed)
    got = {r.event_id: (r.status, r.expected_rate, r.reached) for r in pointintime.p5_found(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == expected(rows)
    assert len(got) > 10


def test_covering_and_reached_equal_a_plain_search():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (7, 30), (40, 200), (200, 50)):
        code, ecode = rng.integers(0, 4, m), rng.integers(0, 4, n)
        start, asked = rng.integers(0, 30, m), rng.integers(0, 35, n)
        end, rank = start + rng.integers(1, 12, m), rng.permutation(m)
        holds = (ecode[:, None] == code) & (start < asked[:, None]) & (asked[:, None] <= end)
        want = np.where(holds, rank, -1).max(axis=1)
        assert (pointintime._covering(code, start, end, rank, ecode, asked) == want).all()
        values = np.array([None if v == 5 else f"s{v}" for v in rng.integers(0, 6, m)], object)
        got = pointintime._reached(np.ones(m, bool), values, code, start, end, ecode, asked, n)
        assert list(got) == [",".join(sorted({v for v, h in zip(values, row) if h and v is not None})) for row in holds]


def test_empty(spark):
    assert pointintime.p5_found(spark.createDataFrame([], COLUMNS)).count() == 0


def test_outcome_without_anything_known(spark):
    from replay_by_hand import row

    t = datetime.fromisoformat("2025-05-01T00:00:00+00:00")
    rows = [row(1, "a", "x", "created", {"status": "applied"}, t, t), row(2, "b", "x", "status_changed", {"to": "passed"}, t, t)]
    assert pointintime.p5_found(spark.createDataFrame(rows, COLUMNS)).collect()[0].asDict() == {"event_id": "b", "status": "", "expected_rate": "", "reached": ""}
