import datetime as dt
import re

from recordweave.queries.catalogue import QUERIES


def by_hand(text):
    units = {"": 1, "만": 10_000, "억": 100_000_000}
    found = re.findall(r"([+-]?\d[\d,]*(?:\.\d+)?)\s*([만억]?)", text)
    return any(abs(float(n.replace(",", "")) * k - 404) < 1e-9 for n, u in found for k in (1, units[u]))  # as it stands and multiplied


def test_numbers_evidence_covers_texts_with_units(spark, tmp_path):
    texts = ["404 rows", "no number", "0.0404만 행", "404만", "404억", "만들다: 404 오류", "억 단위 아님, 40", "4.04e2", "0.00000404억", "1,404 and 404.0", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.found for r in QUERIES["text_numbers_evidence"](spark, str(tmp_path)).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}
    assert sorted(i for i in got if got[i]) == [0, 2, 3, 4, 5, 8, 9]


def test_every_matching_part_comes_out(spark, tmp_path):
    parts = [(i, f"{'Dark RED' if i % 3 else 'blue'} tin {i}", "B", "K", 1) for i in range(900)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([], "o_orderkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string, o_totalprice double, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([], "c_custkey long, c_name string, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_linestatus string, l_returnflag string, l_shipdate timestamp, l_quantity double, l_tax double"
    spark.createDataFrame([], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    start = dt.datetime(2024, 1, 1)
    events = [(i, f"type{i % 2}" if i % 4 else ("click" if i % 8 else "view"), start + dt.timedelta(hours=6 * i), 1.0) for i in range(8000)]
    spark.createDataFrame(events, "event_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    ids = {r.id for r in QUERIES["ent_contains_ci_matching"](spark, str(tmp_path)).collect()}
    assert ids == {i for i in range(900) if i % 3} and len(ids) > 200
    days = {(kind, at.date()) for _, kind, at, _ in events}
    assert QUERIES["series_ma_days_matching"](spark, str(tmp_path)).count() == len(days) > 1000
    assert QUERIES["series_ma_points_matching"](spark, str(tmp_path)).count() == sum(day >= dt.date(2024, 1, 20) for _, day in days) > 1000
    assert QUERIES["series_list_period_matching"](spark, str(tmp_path)).count() == sum(kind in ("click", "view") and day >= dt.date(2024, 1, 10) for kind, day in days) > 500
