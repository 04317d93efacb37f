import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from recordweave.engine import Engine
from recordweave.operators import ingest
from recordweave.plans.question import Scripted, Words
from recordweave.sources.store import Commit, CommitConflict, Store

NOW = dt.datetime(2026, 10, 3, 3, tzinfo=dt.timezone.utc)
COMPANY = {"name": "company", "version": 1, "fields": {"name": {"type": "string"}, "aliases": {"type": "array"}, "business_number": {"type": "string", "identifier": True}}, "required": ["name"]}
APPLICATION = {
    "name": "application", "version": 1, "default_date_field": "applied_at", "keywords": ["applications"], "required": ["company_id"],
    "fields": {"company_id": {"type": "string", "ref": "company"}, "status": {"type": "string", "enum": ["applied", "viewed", "passed", "rejected"], "labels": {"viewed": ["read"]}, "implies": {"passed": ["viewed"]}}, "applied_at": {"type": "string", "format": "date"}, "note": {"type": "string"}, "pay": {"type": "number"}},
}
PRICE = {"name": "price", "version": 1, "kind": "series", "series_key": ["code"], "time_field": "day", "fields": {"code": {"type": "string"}, "day": {"type": "string", "format": "date"}, "close": {"type": "number"}}}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('book')}", now=NOW, words=Words(keywords={"application": ["applications", "application"]}, default_dates={"application": "applied_at"}))
    for d in (COMPANY, APPLICATION, PRICE):
        assert e.register(d) and not e.register(d)
    e.record({"entity_type": "company", "payload": {"name": "Alpha Inc.", "aliases": ["Beta"], "business_number": "123-45-67890"}, "entity_id": "co_1"}, "ann")
    e.record({"entity_type": "company", "payload": {"name": "Gamma"}, "entity_id": "co_2"}, "ann")
    return e


def test_records_are_written_and_read(engine):
    said = engine.record({"entity_type": "application", "entity_id": "app_1", "payload": {"company_id": "ALPHA", "status": "applied", "applied_at": "2026-10-02", "pay": 12, "odd": [1, "x"]}, "at": "2026-10-02T09:00:00+09:00"}, "ann")
    assert (said.status, said.id) == ("recorded", "app_1") and said.questions == ["odd is not registered"]
    found = engine.get_entity("app_1")
    assert found["doc"] == {"company_id": "co_1", "status": "applied", "applied_at": "2026-10-02", "pay": 12, "odd": [1, "x"]} and found["reached"] == ["applied"]
    assert engine.record({"entity_type": "application", "kind": "status_changed", "match": {"company_id": "Beta"}, "payload": {"from": "applied", "to": "viewed"}, "at": "2026-10-02T12:00:00+09:00"}, "ann").status == "recorded"
    assert engine.get_entity("app_1")["doc"]["status"] == "viewed" and [r.kind for r in engine.history("app_1").collect()] == ["created", "status_changed"]
    contradiction = engine.record({"entity_type": "application", "kind": "status_changed", "entity_id": "app_1", "payload": {"from": "applied", "to": "passed"}}, "ann")
    assert contradiction.status == "clarify" and engine.get_entity("app_1")["doc"]["status"] == "viewed"
    event = engine.history("app_1").first().id
    assert engine.get_event(event)["seq"] == engine.history("app_1").first().seq and engine.get_event("no") is None
    assert [r.id for r in engine.find("application", {"status": "viewed", "note": None}).collect()] == ["app_1"] and engine.count("application") == 1
    with pytest.raises(KeyError):
        engine.find("application", {"nothing": 1})
    assert [r.entity_id for r in engine.ids_with_events().collect()] == ["co_1", "co_2", "app_1"]


def test_what_is_refused_or_asked_back(engine):
    ask = lambda **r: engine.record({"entity_type": "application", **r}, "ann")
    assert ask(payload={"company_id": "Alpa"}).options == ["co_1"] and ask(payload={"company_id": "Zzz"}).status == "clarify"
    assert ask(kind="updated", payload={"note": "x"}).status == "rejected" and ask(kind="updated", match={"odd": 1}, payload={"note": "x"}).status == "rejected"
    assert ask(payload={"status": "applied"}).errors[0].endswith("company_id: missing")
    assert engine.record({"entity_type": "company", "payload": {"name": "alpha"}}, "ann").options == ["co_1"]
    assert engine.record({"entity_type": "aplication", "payload": {}}, "ann").options == ["application"]
    assert "no evidence" in ask(kind="retracted", entity_id="app_1", payload={}).errors[0]
    before = engine.events.count()
    batch = [dict(id=f"e{i}", entity_id=e, entity_type="company", kind=k, payload=p, at="2026-10-01T00:00:00Z", recorded_at="2026-10-01T00:00:00Z", recorded_by="b") for i, (e, k, p) in enumerate([("co_8", "created", {"name": "Eight"}), ("co_8", "updated", {"aliases": ["Acht"]}), ("co_9", "updated", {"name": "x"}), ("co_7", "created", {"name": 7})])]
    said = engine.write(batch)
    assert sorted(x.split(":")[0] for x in said.errors) == ["e2", "e3"] and engine.events.count() == before + 2
    assert engine.get_entity("co_8")["doc"] == {"name": "Eight", "aliases": ["Acht"]} and engine.get_entity("co_7") is None
    assert engine.write(batch).status == "rejected" and engine.events.count() == before + 2  # repeated changes change nothing
    old = {r.id: r.doc for r in engine.entities.collect()}
    engine.rebuild()
    assert {r.id: json.loads(r.doc) for r in engine.entities.collect()} == {i: json.loads(d) for i, d in old.items()}


def test_questions(engine):
    said = engine.query("how many applications on 10/2?", by="ann")
    assert said.status == "answered" and said.seen.total == 1 and said.text.startswith("Answer: 1\nEvidence: app_1")
    assert engine.query("co_1").id == "co_1" and engine.query("what is the meaning").status == "unsupported"
    by_name = {"entity_type": "application", "mode": "list", "filters": [{"field": "company_id", "op": "name_is", "value": "1234567890"}, {"field": "note", "op": "contains", "value": "x"}]}
    answered = engine.query(spec=by_name)
    assert answered.seen.total == 0 and any("free text of note" in n for n in answered.seen.notes) and any("was read as co_1" in n for n in answered.seen.notes)
    listed = engine.query(spec={"entity_type": "application", "mode": "list", "filters": [{"field": "company_id", "op": "eq", "value": "Alpha"}]})
    assert [r["id"] for r in listed.seen.rows] == ["app_1"] and "company_id=co_1 (Alpha Inc.)" in listed.text
    assert engine.query(spec={"entity_type": "application", "mode": "count", "filters": [{"field": "company_id", "op": "name_is", "value": "Alpa Inc"}]}).options == ["co_1"]
    grouped = engine.query(spec={"entity_type": "application", "mode": "aggregate", "group_by": [{"field": "applied_at", "bucket": "month"}], "measures": [{"name": "read", "agg": "count", "where": [{"field": "status", "op": "eq", "value": "viewed"}]}], "defaults_used": ["all time"]})
    assert grouped.seen.groups == [{"group": {"applied_at_month": "2026-10"}, "measures": {"read": 1}, "n": 1, "ids": ["app_1"]}]
    for note in ("Read with a default: all time.", "Fewer than 5", "applied_at_month 2026-10 is still in progress", "within the last 3 days"):
        assert any(note in n for n in grouped.seen.notes), note
    assert "read=1/1 (100%)" in grouped.text
    log = engine.query(spec={"source": "events", "entity_type": "application", "mode": "list", "filters": [{"field": "kind", "op": "eq", "value": "status_changed"}]})
    assert "status_changed viewed at 2026-10-02T12:00:00+09:00 by ann" in log.text and any("history of these records begins" in n for n in log.seen.notes)
    assert engine.add_value_group("application", "status", "Seen", ["viewed", "passed"]).status == "recorded" and engine.add_value_group("application", "status", "x", ["viewed"]).status == "rejected"
    assert engine.query(spec={"entity_type": "application", "mode": "count", "filters": [{"field": "status", "op": "eq", "value": "seen"}]}).seen.total == 1
    views = {v: engine.query_log(v, 50).count() for v in ("recent", "errors", "empty", "warnings")}
    assert views["recent"] >= 8 and views["empty"] >= 1 and views["warnings"] >= 3
    assert engine.purge_query_log("2020-01-01T00:00:00Z") == 0 and engine.purge_query_log() == views["recent"] and engine.query_log().count() == 0


def test_interpreted_questions_are_cached(engine):
    engine.adapter = Scripted([{"entity_type": "application", "mode": "count", "filters": [{"field": "pay", "op": "gte", "value": 5}]}])
    try:
        assert engine.query("who pays 5 or more").seen.total == 1 and engine.query("who pays 7 or more").seen.total == 1
        assert len(engine.adapter.asked) == 1
    finally:
        engine.adapter = lambda *_: None


def test_dictionary_and_proposals(engine):
    engine.record({"entity_type": "application", "entity_id": "app_2", "payload": {"company_id": "co_2", "Note_": "moved", "status": "ghosted"}}, "ann")
    found = {(p.action, p.field, p.into, p.values): p for p in engine.propose_schema()}
    merge, values = found["merge_fields", "Note_", "note", ()], found["register_values", "status", "", ("ghosted",)]
    assert engine.apply_schema_proposal(merge.id, " ").status == "rejected" and engine.apply_schema_proposal("prop_x", "ann").status == "rejected"
    assert engine.apply_schema_proposal(merge.id, "ann").status == "recorded" and engine.get_entity("app_2")["doc"] == {"company_id": "co_2", "note": "moved", "status": "ghosted"}
    assert engine.apply_schema_proposal(values.id, "ann").status == "recorded" and "ghosted" in engine.types["application"].fields["status"].enum
    told = engine.list_schemas()
    assert "refers to company" in told and "'seen' means any of viewed, passed" in told and "a series by code and day" in told
    again = Engine(engine.spark, engine.store.root, now=NOW)
    assert again.types == engine.types and again.get_schema("application", 1) == engine.get_schema("application", 1)
    assert engine.sql("SELECT count(*) AS n FROM application WHERE status = :s", s="ghosted").first().n == 1
    with pytest.raises(ValueError):
        engine.sql("DROP TABLE events")
    assert "Scan" in engine.explain({"entity_type": "application", "mode": "count"})
    assert ("events", "append") in [c[:2] for c in engine.catalogue()]


def test_series_batches(engine, spark):
    rows = lambda *r: spark.createDataFrame(list(r), "code string, day string, close double")
    first = engine.record_series("price", rows(("a", "2026-10-01", 1.0), ("a", "2026-10-02", 2.0)), "ann")
    second = engine.record_series("price", rows(("a", "2026-10-02", 3.0), ("a", "2026-10-01", 1.0), ("b", "2026-10-02", 9.0)), "ann")
    assert second.message == "1 new, 1 changed, 1 unchanged" and engine.get_point("price", {"code": "a"}, "2026-10-02")["close"] == 3.0
    assert engine.record_series("price", rows(("a", None, 1.0)), "ann").status == "rejected" and engine.record_series("price", rows(("a", "x", 1.0)), "ann").status == "rejected"
    assert engine.revert_series_batch(first.id).status == "rejected" and engine.revert_series_batch(second.id).status == "recorded"
    assert engine.get_point("price", {"code": "a"}, "2026-10-02")["close"] == 2.0 and engine.get_point("price", {"code": "b"}, "2026-10-02") is None
    assert engine.get_batch(second.id)["reverted_at"] and engine.revert_series_batch(second.id).status == "rejected" and engine.revert_series_batch(first.id).status == "recorded"
    assert engine.query(spec={"source": "series", "entity_type": "price", "mode": "list"}).seen.total == 0


def test_text_is_taken_in_and_back(engine, spark):
    for i, pay in ((1, 12), (2, None)):
        if engine.get_entity(f"app_{i}") is None:
            engine.record({"entity_type": "application", "entity_id": f"app_{i}", "payload": {"company_id": f"co_{i}", "pay": pay}}, "ann")
    notes = spark.createDataFrame([("n.md", "# Jobs\n- Applied to Alpha Inc. for 30만\n- Applied to Delta for 20\n- met Gamma, pay 9"), ("m.md", "- Alpha again, pay 31")], "name string, text string")

    def facts(chunks):
        said = [("Alpha Inc.", "company_id", "Alpha", "Alpha Inc."), ("Alpha Inc.", "pay", "300000", "for 30만"), ("Delta", "company_id", "Delta", "to Delta"), ("Gamma", "company_id", "Gamma", "Gamma"), ("Gamma", "pay", "8", "pay 9"), ("Gamma", "note", "met", "not there")]
        table = spark.createDataFrame(said, "mark string, field string, value string, quote string")
        return chunks.join(table, F.col("chunk").contains(F.col("mark"))).select("span_id", F.lit("application").alias("type"), "field", "value", "quote")

    preview = engine.ingest_preview(notes, facts, {"application": ["company_id"]})
    problems = {(r.field, r.value): r.problem for r in preview["facts"].collect()}
    assert problems == {("company_id", "co_1"): None, ("pay", "300000"): None, ("company_id", "Delta"): "no certain company", ("company_id", "co_2"): None, ("pay", "8"): "number not in the quote", ("note", "met"): "the quote is not in the chunk"}
    assert {r.record: r.outcome for r in preview["records"].collect()} == {"company_id=co_1": "differs", "company_id=co_2": "recorded"}
    fresh = engine.ingest_preview(notes, facts, {"application": ["company_id", "pay"]})
    assert engine.ingest_apply(fresh, "ann", False).status == "rejected"
    before = engine.count("application")
    said = engine.ingest_apply(fresh, "ann", True)
    assert said.status == "recorded" and engine.count("application") == before + 2 and engine.count("application", {"pay": 300000.0}) == 1
    assert engine.ingest_apply(fresh, "ann", True).status != "recorded" or engine.count("application") == before + 2
    assert engine.ingest_revert(said.id, "ann").status == "recorded" and engine.count("application") == before


def test_drafts_views_and_folders(engine, spark, tmp_path):
    if engine.get_entity("app_1") is None:
        engine.record({"entity_type": "application", "entity_id": "app_1", "payload": {"company_id": "co_1"}}, "ann")
    engine.record({"entity_type": "application", "entity_id": "app_5", "payload": {"company_id": "co_1", "mood": "good"}}, "ann")
    asked = {"entity_type": "application", "mode": "count", "filters": [{"field": "mood", "op": "eq", "value": "good"}]}
    assert engine.query(spec=asked).status == "rejected"
    said = engine.query(spec=asked, drafts=True)
    assert said.seen.total == 1 and any("no mood (not registered yet)" in n for n in said.seen.notes)
    engine.write_views(f"file://{tmp_path}/views")
    engine.write_views(f"file://{tmp_path}/views")
    views = Store(spark, f"file://{tmp_path}/views")
    assert {r.type: r.live for r in views.table("_summary").collect()}["company"] == engine.count("company")
    assert {r.company for r in views.table("application").where("id = 'app_5'").collect()} == {"Alpha Inc."}
    assert views.table("_history").count() == engine.events.count() and views.table("_fields").where("type = 'price'").count() == 3 and views.table("_meta").count() == 2
    (tmp_path / "types").mkdir()
    (tmp_path / "types" / "b.json").write_text(json.dumps({"name": "person", "version": 3, "fields": {"name": {"type": "string"}}}))
    assert engine.register_folder(str(tmp_path / "types")) == ["person"] and engine.register_folder(str(tmp_path / "types")) == []
    (tmp_path / "notes" / "deep").mkdir(parents=True)
    for name, body in (("a.md", "# A\ntext"), ("deep/b.txt", "more"), ("c.md", "skipped"), ("d.csv", "x")):
        (tmp_path / "notes" / name).write_text(body)
    none = lambda chunks: chunks.select("span_id", F.lit("person").alias("type"), F.lit("name").alias("field"), F.lit("x").alias("value"), F.col("chunk").alias("quote")).limit(0)
    preview = engine.ingest_preview(f"file://{tmp_path}/notes", none, {"person": ["name"]}, ("c.md",))
    assert {(r.name, r.chunk) for r in preview["chunks"].collect()} == {("a.md", "text"), ("deep/b.txt", "more")} and preview["records"].count() == 0


def test_chunks_are_classified_and_types_settled(spark):
    chunks = spark.createDataFrame([(f"s{i}", c) for i, c in enumerate(["bought a share"] * 3 + ["ran five km", "ran ten km", "ran a km", "cooked rice", "nothing", "bought and ran"])], "span_id string, chunk string")
    got = {r.span_id: r.type for r in ingest.classified(chunks, ingest.by_words({"trade": ["bought"], "run": ["ran"], "meal": ["cooked"]}), 2).collect()}
    assert got == {"s0": "trade", "s1": "trade", "s2": "trade", "s3": "run", "s4": "run", "s5": "run", "s6": "meal", "s7": "ambiguous", "s8": "ambiguous"}
    names = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(["trades", "trade", "run_log", "run_logs", "runlog", "meal", "ambiguous"])], "span_id string, type string")
    assert {r.span_id: r.type for r in ingest.settled_types(names, ["trade"]).collect()} == {"s0": "trade", "s1": "trade", "s2": "runlog", "s3": "runlog", "s4": "runlog", "s5": "ambiguous", "s6": "ambiguous"}

    def broken(texts):
        raise RuntimeError("no answer")

    assert {r.type for r in ingest.classified(chunks, broken).collect()} == {"ambiguous"}
    assert ingest.cost(31, 0.5, cap=2.0) == {"calls": 3, "estimate": 3.0, "allowed": False}
    facts = spark.createDataFrame([("s", "run", "km", "5", "q"), ("s", "run", "day", "2026-01-02", "q")], "span_id string, type string, field string, value string, quote string")
    drafted = ingest.drafted_types(facts, {})["run"].fields
    assert drafted["km"].type == "integer" and drafted["day"].format == "date"
    merged = spark.createDataFrame([("log", {"t": str(i)}) for i in range(4)] + [("ok", {"t": "same"})] * 4 + [("few", {"t": "a"})], "type string, fields map<string,string>")
    assert ingest.demoted_series(merged, ["log", "ok"], "t") == ["log"]
    assert {r.type for r in ingest.with_enough_records(merged, []).collect()} == {"log", "ok"}


def test_commits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    start = store.state()
    one = store.commit(Commit(appended={"log": rows(("a", 1))}, put={"t": (["k"], rows(("a", 1), ("b", 2)))}), start)
    with pytest.raises(CommitConflict):
        store.commit(Commit(appended={"log": rows(("z", 1))}), start)
    two = store.commit(Commit(put={"t": (["k"], rows(("a", 5)))}, deleted={"t": (["k"], rows(("b", None)))}), one)
    assert {tuple(r) for r in store.table("t").collect()} == {("a", 5)} and {tuple(r) for r in store.table("t", one).collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(Exception):  # noqa: B017 - whatever the write raises
        store.commit(Commit(appended={"log": rows(("y", 1)), "bad": spark.sql("SELECT raise_error('no') AS x")}), two)
    assert store.state().number == two.number and store.table("log").count() == 1
    store.compact("t")
    assert len(store.state().folders["t"]) == 1 and {tuple(r) for r in store.table("t").collect()} == {("a", 5)}
    assert store.clean() >= 2 and store.catalogue() == [("log", "append", 1), ("t", "keyed", 1)]
