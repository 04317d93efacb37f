import json

from recordweave.operators import references, skew
from replay_by_hand import COLUMNS, START, row

ENTITIES = "id string, type string, schema_version int, doc string, retracted boolean, created_at string, updated_at string, last_event_seq long, event_ids array<string>, reached array<string>"
COMPANIES = "id string, name string, retracted boolean, created_at string"
SCHEMAS = "name string, version int, definition string, json_schema string, created_at string"


def entity(id, type, doc, retracted=False, at="2025-03-01T00:00:00+09:00", seq=1):
    return (id, type, 1, json.dumps(doc) if isinstance(doc, dict) else doc, retracted, at, at, seq, [], [])


def tables(spark, entities, companies=(), events=()):
    fields = {"company_id": {"ref": "company"}, "posting_id": {"ref": "posting"}}
    schemas = [("application", 1, json.dumps({"fields": fields}), "", ""), ("posting", 1, json.dumps({"fields": {"company_id": {"ref": "company"}, "posting_id": {}}}), "", "")]
    return spark.createDataFrame(entities, ENTITIES).selectExpr("*", "'x' AS reason", "1 AS refs", "2 AS salt"), spark.createDataFrame(list(companies), COMPANIES), spark.createDataFrame(schemas, SCHEMAS), spark.createDataFrame(list(events), COLUMNS)


def found(*args):
    return {(r.source_id, r.field, r.target_id, r.reason, r.period) for r in references.p6_found(*args).collect()}


def test_reasons(spark):
    entities = [
        entity("a1", "application", {"company_id": "c1", "posting_id": "p1"}),
        entity("a2", "application", {"company_id": "nowhere", "posting_id": ""}),
        entity("a3", "application", {"company_id": "c2", "posting_id": None}, at="2025-02-28T23:00:00-05:00"),
        entity("a4", "application", {"company_id": "nowhere"}, retracted=True),
        entity("a5", "application", {"company_id": "nowhere"}, seq=1), entity("a5", "application", {"company_id": "c1"}, seq=2),
        entity("a6", "application", "broken"), entity("a7", "application", None),
        entity("p1", "posting", {"company_id": "c3", "posting_id": "777"}),
    ]
    companies = [("c1", "n", False, "2020-01-01T00:00:00Z"), ("c2", "n", True, "2020-01-01T00:00:00Z"), ("c3", "n", None, "2026-01-01T00:00:00Z")]
    assert found(*tables(spark, entities, companies)) == {
        ("a2", "company_id", "nowhere", "missing", "2025-02"), ("a3", "company_id", "c2", "retracted", "2025-03"), ("p1", "company_id", "c3", "later", "2025-02"),
    }


def test_targets_of_events(spark):
    events = [
        row(1, "a", "x", "retracted", {"target": "b"}, START, START, "b"), row(2, "b", "x", "created", {}, START, START), row(3, "c", "x", "retracted", {"target": "a"}, START, START, "a"),
        row(4, "d", "x", "retracted", {"target": "?"}, START, START, "?"), row(5, "d", "x", "retracted", {"target": "?"}, START, START, "?"), row(6, "b", "x", "created", {}, START, START),
    ]
    assert found(*tables(spark, [], (), events)) == {("a", "target_event_id", "b", "later", "2025-01"), ("d", "target_event_id", "?", "missing", "2025-01")}


def test_hot_key_is_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    n = 12_000
    entities = spark.range(n).selectExpr("concat('a', id) AS id", "'application' AS type", "1 AS schema_version", "'{\"company_id\": \"hot\"}' AS doc", "false AS retracted", "'2025-03-01T00:00:00Z' AS created_at", "'' AS updated_at", "1L AS last_event_seq", "array('') AS event_ids", "array('') AS reached")
    _, companies, schemas, events = tables(spark, [])
    assert references.p6_found(entities, companies, schemas, events).where("reason = 'missing'").count() == n


def test_empty(spark):
    assert found(*tables(spark, [])) == set()
