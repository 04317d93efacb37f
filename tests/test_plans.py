import datetime as dt

import pytest

from recordweave.operators import imports, querylog, series, text
from recordweave.operators.asof import asof_join
from recordweave.functions import names as name_functions
from recordweave.functions.names import candidates, identify, likeness, normal_name
from recordweave.plans import reltime
from recordweave.plans.planner import Book, ask, later_statuses
from recordweave.plans.spec import FieldDef, SpecError, TypeDef, parse, problems
from pyspark.sql import functions as F

TYPES = {
    "note": TypeDef("note", {"title": FieldDef(), "kind": FieldDef(enum=("a", "b")), "day": FieldDef(format="date"), "size": FieldDef("integer"), "tags": FieldDef("array"), "owner_id": FieldDef(ref="person")}),
    "person": TypeDef("person", {"name": FieldDef()}),
    "weight": TypeDef("weight", {"person": FieldDef(ref="person"), "day": FieldDef(format="date"), "kg": FieldDef("number")}, "series", ("person",), "day"),
}


@pytest.fixture(scope="module")
def book(spark):
    d = dt.date
    b = Book(TYPES, now=dt.datetime(2026, 10, 3, 3, tzinfo=dt.timezone.utc))
    b.entities["note"] = spark.createDataFrame(
        [("1", "ABC%", "a", d(2026, 9, 1), 1, ["x"], "p", False), ("2", "abc", None, d(2026, 9, 30), 4, ["y"], "q", False), ("3", "É", "b", None, None, [], None, False), ("4", "gone", "a", d(2026, 9, 2), 9, [], "p", True), ("5", "z", "a", d(2026, 10, 1), 2, None, "p", None)],
        "id string, title string, kind string, day date, size int, tags array<string>, owner_id string, retracted boolean",
    )
    b.entities["person"] = spark.createDataFrame([("p", "Ann"), ("q", "Bob"), ("r", "Bob")], "id string, name string")
    b.series["weight"] = spark.createDataFrame([("p", d(2026, 9, 1), 60.0), ("p", d(2026, 9, 3), None), ("p", d(2026, 9, 5), 63.0), ("q", d(2026, 9, 2), 80.0)], "person string, day date, kg double")
    return b


def ids(book, *filters, **more):
    return sorted(r.id for r in ask(book, {"entity_type": "note", "filters": list(filters), **more}).rows.collect())


def test_filters(book):
    f = lambda field, op, value=None: {"field": field, "op": op, "value": value}
    assert ids(book) == ["1", "2", "3", "5"]
    assert ids(book, f("kind", "eq", "a")) == ["1", "5"]
    assert ids(book, f("kind", "ne", "a")) == ["2", "3"]  # null is not a
    assert ids(book, f("kind", "not_in", ["a"])) == ["2", "3"]
    assert ids(book, f("title", "contains", "BC")) == ["1", "2"]
    assert ids(book, f("title", "contains", "é")) == []  # only A to Z fold
    assert ids(book, f("title", "contains", "%")) == ["1"]
    assert ids(book, f("tags", "contains", "y")) == ["2"]
    assert ids(book, f("day", "gte", "@this_month_start")) == ["5"]
    assert ids(book, f("day", "missing")) == ["3"]
    assert ids(book, f("owner_id", "name_is", " ann ")) == ["1", "5"]
    with pytest.raises(SpecError):
        ids(book, f("owner_id", "name_is", "Bob"))


def test_null_order_and_limit(book):
    rows = ask(book, {"entity_type": "note", "order_by": "size", "list_fields": ["size"], "limit": 2})
    assert [r.id for r in rows.rows.collect()] == ["3", "1"]
    assert rows.total.first().total == 4


def test_conditional_count_of_nothing_is_null(book):
    spec = {"entity_type": "note", "mode": "aggregate", "filters": [{"field": "title", "op": "eq", "value": "none such"}], "measures": [{"name": "m", "agg": "count_if", "where": [{"field": "kind", "op": "eq", "value": "a"}]}]}
    assert ask(book, spec).rows.collect()[0].m is None


def test_asof_value_and_safe_division(book):
    values = [{"name": "kg", "asof": {"field": "owner_id", "series": "weight", "measure": "kg", "at": "day"}}, {"name": "per", "expr": {"op": "div", "args": ["kg", 0]}}]
    rows = {r.id: (r.kg, r.per) for r in ask(book, {"entity_type": "note", "values": values}).rows.collect()}
    assert rows == {"1": (60.0, None), "2": (80.0, None), "3": (None, None), "5": (63.0, None)}


@pytest.mark.parametrize(
    ("spec", "said"),
    [
        ({"entity_type": "none"}, "no type"),
        ({"entity_type": "note", "filters": [{"field": "x", "op": "eq", "value": 1}]}, "no field"),
        ({"entity_type": "note", "filters": [{"field": "kind", "op": "eq", "value": "z"}]}, "not one of"),
        ({"entity_type": "note", "filters": [{"field": "title", "op": "gt", "value": "z"}]}, "number or a date"),
        ({"entity_type": "note", "filters": [{"field": "day", "op": "eq", "value": "2026-13-01"}]}, "no date"),
        ({"entity_type": "note", "group_by": [{"field": "kind"}]}, "mode aggregate"),
        ({"entity_type": "note", "mode": "aggregate", "measures": [{"name": "m", "agg": "sum", "field": "title"}]}, "needs a number"),
        ({"entity_type": "note", "mode": "aggregate", "measures": [{"name": "m", "agg": "change", "field": "size"}]}, "for series"),
        ({"entity_type": "note", "elapsed": [{"start": {"field": "day"}, "unit": "hours", "op": "gt", "value": 1}]}, "hours need events"),
        ({"entity_type": "weight"}, "of kind series"),
        ({"entity_type": "weight", "source": "series", "window": [{"name": "kg", "measure": "kg", "size": 3}]}, "new short word"),
        ({"entity_type": "note", "limit": 5000}, "limit"),
        ({"entity_type": "note", "mode": "count", "values": [{"name": "v", "expr": {"op": "add", "args": ["size", 1]}}]}, "not used"),
    ],
)
def test_problems(spec, said):
    assert any(said in p for p in problems(parse(spec), TYPES))


def test_unknown_keys_are_refused():
    with pytest.raises(SpecError):
        parse({"entity_type": "note", "colour": 1})


def test_relative_dates():
    today = dt.date(2026, 10, 31)
    assert reltime.resolve("@today-1m", today) == dt.date(2026, 9, 30)
    assert reltime.resolve("@this_week_start", today) == dt.date(2026, 10, 26)
    assert reltime.resolve("@last_month_start-1w", today) == dt.date(2026, 8, 25)
    assert reltime.resolve("@last_full_week_start(2026-11)", today) == dt.date(2026, 11, 23)
    assert reltime.resolve("@last_full_week_end(2026-11)", today) == dt.date(2026, 11, 29)
    assert reltime.resolve("@month_end(2026-02)", today) == dt.date(2026, 2, 28)


def test_later_statuses_in_one_pass():
    assert later_statuses(["viewed"], {"passed": ["viewed"], "hired": ["passed"]}) == ["viewed", "passed", "hired"]
    assert later_statuses(["viewed"], {"hired": ["passed"], "passed": ["viewed"]}) == ["viewed", "passed"]


def test_asof_blocks_and_ties(spark):
    right = spark.createDataFrame([(1, 5, 50), (1, 5, 51), (1, 900, 9), (None, 1, 1), (2, None, 1), (1, 6, None)], "k int, t int, v int")
    left = spark.createDataFrame([(1, 4), (1, 5), (1, 899), (1, 900), (2, 9), (None, 9), (1, None)], "k int, t int")
    c = F.col
    got = {(r.k, r.t): r.v for r in asof_join(left, right, c("k"), c("t"), c("k"), c("t"), c("v"), "v", block=10).collect()}
    assert got == {(1, 4): None, (1, 5): 51, (1, 899): 51, (1, 900): 9, (2, 9): None, (None, 9): None, (1, None): None}
    strict = {(r.k, r.t): r.v for r in asof_join(left, right, c("k"), c("t"), c("k"), c("t"), c("v"), "v", block=10, strict=True).collect()}
    assert strict[1, 5] is None and strict[1, 900] == 51


def test_batches_merge_and_revert(spark):
    cur = spark.createDataFrame([("a", 1, 1.0, "b0"), ("a", 2, 2.0, "b0")], "k string, t int, v double, batch_id string")
    new = spark.createDataFrame([("a", 2, 5.0), ("a", 3, 3.0), ("a", 1, 1.0)], "k string, t int, v double")
    changes = series.classify(cur, new, ["k", "t"])
    after = series.merge(cur, new, ["k", "t"], "b1")
    assert {(r.t, r.v, r.batch_id) for r in after.collect()} == {(1, 1.0, "b0"), (2, 5.0, "b1"), (3, 3.0, "b1")}
    assert {tuple(r) for r in series.revert(after, changes, ["k", "t"], "b1").collect()} == {tuple(r) for r in cur.collect()}
    later = series.merge(after, spark.createDataFrame([("a", 2, 7.0)], new.schema), ["k", "t"], "b2")
    with pytest.raises(ValueError):
        series.revert(later, changes, ["k", "t"], "b1")
    twice = new.unionByName(new)
    assert series.merge(cur, twice, ["k", "t"], "b3").count() == 2  # refused as a whole


def test_combine_union_and_any(spark):
    a = spark.createDataFrame([(1, True, ["x"]), (2, False, ["y"])], "k int, f boolean, l array<string>")
    b = spark.createDataFrame([(2, True, ["x", "y"]), (3, False, [])], "k int, f boolean, l array<string>")
    assert {r.k: (r.f, r.present, r.mismatch) for r in imports.combine(a, b, "k", "f", "any").collect()} == {1: (True, 1, True), 2: (True, 2, True), 3: (False, 1, True)}
    assert {r.k: r.l for r in imports.combine(a, b, "k", "l", "union").collect()} == {1: ["x"], 2: ["y", "x"], 3: []}


def test_log_retention_keeps_all_within_limits(spark):
    log = spark.createDataFrame([(i, "p", None, False, 10) for i in range(50)], "id long, path string, error string, diverging boolean, size long")
    assert querylog.retained(log, 100, 10_000).count() == 50
    assert sorted(r.id for r in querylog.retained(log, 20, 10_000, block=7).collect()) == list(range(32, 50))


def test_chunks_of_a_mixed_note():
    note = "\ufeff---\na: 1\n---\n# Top\ntext one\ntwo\n---\n\n- item\n  more\n- next\n\n## Sub\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx\n```\n### Low\n# Next\nend"
    want = [("front", "", 1, 3), ("paragraph", "Top", 5, 7), ("item", "Top", 9, 10), ("item", "Top", 11, 11), ("row", "Top > Sub", 16, 16), ("code", "Top > Sub", 18, 20), ("paragraph", "Next", 23, 23)]
    for text_of in (note, note.replace("\n", "\r\n"), note.replace("\n", "\r")):
        found = text.chunks(text_of)
        assert [(c.kind, c.path, c.first, c.last) for c in found] == want
        assert found[4].header == "| a | b |" and found[2].text == "- item\n  more"
    assert text.chunks("") == [] and text.chunks("```\nopen")[0].kind == "code"


def test_numbers(spark):
    df = spark.createDataFrame([("-1,200.5 and 3만 or 1.2억, −7 and ５０",)], "q string")
    assert sorted(df.select(text.numbers(F.col("q"))).first()[0]) == [-1200.5, -7.0, 1.2, 3.0, 50.0, 30000.0, 120000000.0]
    assert df.select(text.number_in_quote(F.lit(30000.0), F.col("q"))).first()[0]


def test_evidence(spark):
    state = FieldDef(enum=("viewed", "passed"), labels={"viewed": ["열람"]})
    cases = [
        (FieldDef("number"), "12000", "cost 1.2만 won", None), (FieldDef("number"), "13", "cost 12", "number not in the quote"), (FieldDef("boolean"), "true", "yes", None), (FieldDef("boolean"), "true", " ", "empty quote"),
        (FieldDef(format="date"), "2026-10-02", "10/2 (Fri)", None), (FieldDef(format="date"), "2026-10-02", "2025-10-02", "date not in the quote"), (FieldDef(format="date"), "2026-10-02", "26.10.02", None),
        (state, "viewed", "담당자 열람함", None), (state, "viewed", "passed", "neither the value nor its labels are in the quote"), (FieldDef(), "Ａcme  corp", "by ACME Corp.", None), (FieldDef(), "Beta", "by Acme", "text not in the quote"),
        (FieldDef("array"), '["a1", "7"]', "has A1 and 7", None), (FieldDef("array"), '["b"]', "has c", "items not in the quote"), (FieldDef(), None, "x", "no value or quote"),
    ]
    for d, value, quote, problem in cases:
        row = spark.createDataFrame([(value, quote)], "v string, q string")
        assert row.select(text.evidence_problem(d, F.col("v"), F.col("q"))).first()[0] == problem, (d, value, quote)


def test_identity_cascade(spark):
    names = spark.createDataFrame([("(주)가상테크(Gasang Tech)",), ("Example Labs Inc.",), ("Princeton Co., Ltd.",), ("㈜Ａｌｐｈａ",), (None,), ("Coinc (Korea)",)], "n string")
    assert [r[0] for r in names.select(normal_name("n")).collect()] == ["가상테크", "examplelabs", "princeton", "alpha", "", "coinckorea"]
    firms = spark.createDataFrame([("1", "Alpha Inc.", ["Beta"], "123-45-67890"), ("2", "Gamma", None, None), ("3", "gamma ltd", [], ""), (None, "x", None, None)], "id string, name string, aliases array<string>, business_number string")
    asked = spark.createDataFrame([(1, "ALPHA"), (2, "beta corp"), (3, "Gamma"), (4, "delta"), (5, "Gamma １２３４５６７８９０"), (6, None), (1, "ALPHA")], "query_id int, query string")
    got = {r.query_id: (r.status, r.ids) for r in identify(asked, firms).collect()}
    assert got == {1: ("match", "1"), 2: ("match", "1"), 3: ("ambiguous", "2,3"), 4: ("none", ""), 5: ("match", "1"), 6: ("none", "")}


def test_candidates_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(name_functions, "QUERY_BLOCK", 2)
    firms = spark.createDataFrame([("1", "Alphabet", ["Abece"]), ("2", "Alphabat Inc.", None), ("3", "Gamma", []), ("4", None, None)], "id string, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, "alphbet"), (2, "Gamma Ray"), (3, "zzz"), (4, None), (5, "abec")], "query_id int, query string")
    got = {(r.query_id, r.id): round(r.score, 3) for r in candidates(asked, firms).collect()}
    keys = {"1": ["alphabet", "abece"], "2": ["alphabat"], "3": ["gamma"]}
    want = {(q, i): round(max(likeness(k, n) for k in ks), 3) for q, n in ((1, "alphbet"), (2, "gammaray"), (3, "zzz"), (5, "abec")) for i, ks in keys.items()}
    assert got == {k: v for k, v in want.items() if v >= 0.7} and len(got) == 4
