import datetime as dt
import json

import pytest

from recordweave.operators.recording import numbered, reviewed
from recordweave.plans.dictionary import Registry, breaking, checked, read_type
from recordweave.plans.question import PlanCache, Scripted, Words, interpreted, read_question, slots
from recordweave.plans.spec import parse
from replay_by_hand import COLUMNS, START, row

NOTE = {"name": "note", "version": 1, "fields": {"title": {"type": "string"}, "kind": {"enum": ["a", "b"]}, "day": {"format": "date"}, "when": {"format": "date-time"}, "n": {"type": "integer"}}, "required": ["title"]}
TODAY = dt.date(2026, 10, 3)


def changed(**fields):
    return NOTE | {"version": 2, "fields": NOTE["fields"] | fields}


def test_versions_only_add():
    r = Registry()
    assert r.register(read_type(NOTE)) and not r.register(read_type(NOTE))
    assert "its type changes" in breaking(read_type(NOTE), read_type(changed(n={"type": "number"})))[0]
    for bad in (changed(n={"type": "string"}), changed(kind={"enum": ["a"]}), NOTE | {"version": 3}, NOTE | {"version": 2, "fields": {}}):
        with pytest.raises(ValueError):
            r.register(read_type(bad))
    assert r.register(read_type(changed(extra={"type": "boolean"}))) and r.latest("note").version == 2
    for bad in ({"x": {"type": "map"}}, {"x": {"type": "array", "indexed": True}}, {"x": {"enum": ["a", "a"]}}, {"x": {"type": "integer", "format": "date"}}):
        with pytest.raises(ValueError):
            read_type({"name": "t", "fields": bad})
    with pytest.raises(ValueError):
        read_type({"name": "s", "kind": "series", "series_key": ["k"], "time_field": "d", "fields": {"k": {}, "d": {"format": "date"}}})


def test_documents_are_checked(spark):
    docs = [{"title": "x", "n": 1, "stray": 1, "kind": "z"}, {"n": "1"}, {"title": "x", "day": "2026-02-30"}, {"title": "x", "when": "2026-01-01T00:00:00"}, {"title": None}, "no"]
    df = spark.createDataFrame([(i, json.dumps(d) if isinstance(d, dict) else d) for i, d in enumerate(docs)] + [(6, None)], "i int, doc string")
    got = {r.i: r.violations for r in checked(df, read_type(NOTE)).collect()}
    assert got == {0: [], 1: ["title: missing", "n: not of type integer"], 2: ["day: no calendar day"], 3: ["when: no instant with an offset"], 4: ["title: missing"], 5: ["no object"], 6: ["no object"]}
    assert checked(df.where("i = 0"), read_type(NOTE), strict=True).first().violations == ["kind: not one of its values", "stray: unknown field"]


def test_changes_are_reviewed(spark):
    past = [row(1, "a", "x", "created", {"status": "s"}, START, START), row(2, "g", "gone", "created", {}, START, START), row(3, "h", "gone", "retracted", {}, START, START)]
    new = [
        row(None, "b", "x", "updated", {"k": 1}, START, START), row(None, "c", "y", "created", {}, START, START), row(None, "d", "y", "updated", {"k": 1}, START, START), row(None, "e", "z", "updated", {"k": 1}, START, START),
        row(None, "f", "x", "created", {}, START, START), row(None, "i", "gone", "updated", {"k": 1}, START, START), row(None, "j", "x", "retracted", {"target": "g"}, START, START, "g"), row(None, "k", "x", "updated", {}, START, START), row(None, "a", "x", "created", {}, START, START),
    ]
    batch = spark.createDataFrame(new, COLUMNS).selectExpr("* except(evidence)", "'seen' AS evidence")
    got = {r.id: r.problem for r in reviewed(spark.createDataFrame(past, COLUMNS), batch).collect()}
    assert got == {"b": "", "c": "", "d": "", "e": "no such record", "f": "record exists", "i": "record is retracted", "j": "no such target in the record", "k": "sets nothing", "a": "repeated"}


def test_numbers_follow_the_order(spark):
    rows = numbered(spark.range(1000).selectExpr("(id * 37) % 1000 AS t"), "t", 50).collect()
    assert {r.t: r.seq for r in rows} == {t: t + 50 for t in range(1000)}


TYPES = {"note": read_type(NOTE | {"fields": NOTE["fields"] | {"owner_id": {"ref": "person"}, "kind": {"enum": ["a", "b"], "labels": {"a": ["urgent"], "b": ["urgent maybe"]}}}})}
WORDS = Words(keywords={"note": ["notes", "note"]}, default_dates={"note": "day"})


def test_simple_questions():
    spec = read_question("How many urgent notes on 9/30?", TYPES, WORDS, TODAY)
    assert (spec.mode, [(f.field, f.value) for f in spec.filters]) == ("count", [("kind", "a"), ("day", "2026-09-30")])
    assert [(f.field, f.value) for f in read_question("list urgent maybe notes", TYPES, WORDS, TODAY).filters] == [("kind", "b")]  # the longest label
    assert read_question("how many strange notes", TYPES, WORDS, TODAY) is None
    assert read_question("how many notes from ann lee", TYPES, WORDS, TODAY, lambda t, p: (t, p) == ("person", "ann lee")).filters[0].op == "name_is"
    assert read_question("notes", TYPES, WORDS, TODAY) is None and read_question("", TYPES, WORDS, TODAY) is None


def test_slots_and_cache():
    pattern, values = slots("More than 3 notes since 12/24?", TODAY)
    assert (pattern, values) == ("more than <n> notes since <date>", ["3", "2025-12-24"])
    data = {"entity_type": "note", "filters": [{"field": "n", "op": "gt", "value": 3}, {"field": "day", "op": "gte", "value": "2025-12-24"}]}
    cache = PlanCache()
    key = cache.key(pattern, TYPES, "r")
    assert not cache.put(key, data, values, 0) and not cache.put(key, {"entity_type": "note"}, values, 5)
    assert cache.put(key, data, values, 5)
    again = cache.get(key, ["7", "2026-01-02"], TYPES)
    assert [f.value for f in again.filters] == [7, "2026-01-02"]


def test_interpreter_gets_its_errors_once():
    good = {"entity_type": "note", "mode": "count"}
    adapter = Scripted([{"entity_type": "nothing"}, good])
    path, spec = interpreted("strange question", TYPES, WORDS, TODAY, adapter, PlanCache())
    assert path == "interpreter" and spec == parse(good) and "no type" in adapter.asked[1][1][0]
    assert interpreted("strange question", TYPES, WORDS, TODAY, Scripted([{}, {}]), PlanCache())[0] == "failed"
    assert interpreted("strange", TYPES, WORDS, TODAY, Scripted([None]), PlanCache())[0] == "unsupported"
