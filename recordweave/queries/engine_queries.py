"""Registered queries that go through the engine's own door: its store, questions, series, views and sources.

Each builds a book in the shared folder from the given tables and asks it; the SQL asks the tables.
"""

from __future__ import annotations

import datetime as dt
import json
import pathlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.engine import Engine
from recordweave.operators import ingest
from recordweave.plans.question import Scripted, Words
from recordweave.queries.catalogue import _APP, _BATCH, _DAILY, _batches, register
from recordweave.queries.records import _CURRENT, _normal_sql
from recordweave.runtime import shared_folder
from recordweave.sources.store import Commit
from recordweave.sources.tables import read_schema_files, read_text_folder, table

_TYPES = [
    {"name": "company", "fields": {"name": {"type": "string"}, "aliases": {"type": "array"}, "business_number": {"type": "string", "identifier": True}}},
    {"name": "application", "keywords": ["applications"], "default_date_field": "applied_at", "fields": {
        "company_id": {"type": "string", "ref": "company"}, "status": {"type": "string", "enum": ["applied", "viewed", "passed", "rejected", "withdrawn"], "labels": {"rejected": ["turned down"]}}, "applied_at": {"type": "string", "format": "date"}, "reason": {"type": "string"}}},
    {"name": "holding", "fields": {"security_id": {"type": "string"}, "account": {"type": "string"}, "status": {"type": "string"}, "units": {"type": "number"}}},
    {"name": "daily", "kind": "series", "series_key": ["event_type"], "time_field": "day", "fields": {"event_type": {"type": "string"}, "day": {"type": "string", "format": "date"}, "n": {"type": "integer"}}},
]
NOW = dt.datetime(2026, 6, 3, tzinfo=dt.timezone.utc)


def engine(spark: SparkSession, d: str, companies: bool = False, adapter: object = None) -> Engine:
    """A book with the given projection and feed (first recordings), and with companies if asked for."""
    e = Engine(spark, f"{shared_folder(spark)}/recordweave/book-{uuid.uuid4().hex}", now=NOW, words=Words(keywords={"application": ["applications"]}, default_dates={"application": "applied_at"}), adapter=adapter)
    for t in _TYPES:
        e.register(t | {"version": 1})
    row = F.max_by(F.struct("type", "doc", "retracted", "created_at", "updated_at", F.col("last_event_seq").cast("long").alias("last_event_seq"), "reached"), "last_event_seq").alias("r")
    records = table(spark, d, "entities").groupBy("id").agg(row).select("id", "r.*")
    if companies:
        firms = table(spark, d, "companies")
        doc = F.to_json(F.struct("name", "aliases", "business_number")).alias("doc")
        records = records.unionByName(firms.select("id", F.lit("company").alias("type"), doc, F.lit(False).alias("retracted"), "created_at", F.col("created_at").alias("updated_at"), F.lit(0).cast("long").alias("last_event_seq"), F.array().cast("array<string>").alias("reached")))
    names = ["id", "entity_id", "entity_type", "kind", "payload", "at", "recorded_at", "recorded_by", "evidence", "target_event_id", "at_precision", "seq", "schema_version"]
    events = table(spark, d, "record_events").groupBy("id").agg(F.min_by(F.struct(*names[1:]), "seq").alias("r")).select("id", "r.*")
    e.store.commit(Commit(appended={"events": events}, put={"entities": (["id"], records)}), e.store.state())
    return e


@register("engine_find", f"SELECT id FROM {_CURRENT} WHERE type = 'holding' AND NOT retracted AND doc->>'account' = 'paper' AND doc->>'status' IS NULL OR type = 'holding' AND NOT retracted AND doc->>'account' = 'paper' AND doc->>'status' = 'held'")
def engine_find(spark: SparkSession, d: str) -> DataFrame:
    """Paper holdings without a status, and those held."""
    e = engine(spark, d)
    return e.find("holding", {"account": "paper", "status": None}).select("id").unionByName(e.find("holding", {"account": "paper", "status": "held"}).select("id"))


@register("engine_lookups", f"""
WITH c AS (SELECT min(id) AS id FROM {_CURRENT} WHERE type = 'application'), f AS (SELECT id, entity_id, kind, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn, seq FROM record_events)
SELECT 'entity' AS what, c.id AS id, (SELECT type FROM {_CURRENT} WHERE id = c.id) AS said FROM c
UNION ALL SELECT 'history', f.id, f.kind FROM f, c WHERE f.rn = 1 AND f.entity_id = c.id
UNION ALL SELECT 'schema', 'holding', '1' UNION ALL SELECT 'count', '', (SELECT CAST(count(*) AS VARCHAR) FROM {_CURRENT} WHERE type = 'application' AND NOT retracted)""")  # fmt: skip
def engine_lookups(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    first = e.entities.where("type = 'application'").agg(F.min("id")).first()[0]
    rows = [("entity", first, e.get_entity(first)["type"]), ("schema", "holding", str(e.get_schema("holding").version)), ("count", "", str(e.count("application")))]
    events = e.history(first).select(F.lit("history").alias("what"), "id", F.col("kind").alias("said"))
    return spark.createDataFrame(rows, "what string, id string, said string").unionByName(events)


@register("engine_sql", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM record_events ORDER BY id, seq) WHERE recorded_by IS NOT NULL AND entity_type = 'trade' GROUP BY 1")
def engine_sql(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).sql("SELECT kind, count(*) AS n FROM events WHERE recorded_by IS NOT NULL AND entity_type = :kind GROUP BY kind", kind="trade")


@register("engine_events_of", "SELECT entity_id, min(seq) AS first_seq FROM (SELECT DISTINCT ON (id) * FROM record_events ORDER BY id, seq) GROUP BY 1")
def engine_events_of(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).ids_with_events()


@register("engine_series", f"SELECT event_type, CAST(day AS VARCHAR) AS day, n FROM (SELECT * FROM {_DAILY} WHERE day(day) <= 20) UNION ALL SELECT 'batch', CAST((SELECT count(*) FROM {_BATCH.replace('SELECT', '(SELECT', 1)}) b WHERE day(b.day) > 20) AS VARCHAR), 0")
def engine_series(spark: SparkSession, d: str) -> DataFrame:
    """A series after a second batch was loaded and reverted, and how many points were new in that batch."""
    e = engine(spark, d)
    current, batch = (df.select("event_type", F.col("day").cast("string").alias("day"), "n") for df in _batches(spark, d))
    e.record_series("daily", current, "ann")
    second = e.record_series("daily", batch, "ann")
    e.revert_series_batch(second.id)
    new = spark.createDataFrame([("batch", str(e.get_batch(second.id)["inserted"]), 0)], "event_type string, day string, n long")
    return e._points(e.types["daily"]).select("event_type", F.col("day").cast("string").alias("day"), "n").unionByName(new)


@register("question_fast_path", f"SELECT 'turned down applications' AS question, count(*) AS total FROM {_APP} WHERE NOT retracted AND status = 'rejected' UNION ALL SELECT 'applications on a day', count(*) FROM {_APP} WHERE NOT retracted AND applied_at = DATE '2026-03-02'")
def question_fast_path(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    rows = [("turned down applications", e.query("How many applications were turned down?").seen.total), ("applications on a day", e.query("how many applications on 2026-03-02").seen.total)]
    return spark.createDataFrame(rows, "question string, total long")


@register("question_cached", f"SELECT x.since, (SELECT count(*) FROM {_APP} WHERE NOT retracted AND applied_at >= CAST(x.since AS DATE)) AS total, CAST(1 AS BIGINT) AS asked FROM (VALUES ('2026-01-05'), ('2026-04-06')) x(since)")
def question_cached(spark: SparkSession, d: str) -> DataFrame:
    """Two questions of one pattern, of which the interpreter is asked the first."""
    plan = Scripted([{"entity_type": "application", "mode": "count", "filters": [{"field": "applied_at", "op": "gte", "value": "2026-01-05"}]}])
    e = engine(spark, d, adapter=plan)
    totals = [e.query(f"who has written since {at}").seen.total for at in ("2026-01-05", "2026-04-06")]
    return spark.createDataFrame([(at, n, len(plan.asked)) for at, n in zip(("2026-01-05", "2026-04-06"), totals)], "since string, total long, asked long")


@register("answer_notes", f"""
WITH m AS (SELECT count(*) FILTER (reason IS NULL) AS lost, count(*) FILTER (reason IS NOT NULL AND contains(lower(reason), 'zzz')) AS n FROM (SELECT a.*, e.doc->>'reason' AS reason FROM {_APP} a JOIN {_CURRENT} e USING (id) WHERE NOT a.retracted))
SELECT 'Read with a default: all time.' AS note UNION ALL SELECT lost || ' live record(s) have no reason and cannot match.' FROM m WHERE lost > 0 UNION ALL SELECT 'Nothing matches. What was expected may not be recorded yet.' FROM m WHERE n = 0
UNION ALL SELECT 'This rests on words in the free text of reason; records worded otherwise are missed. A field of its own would not miss them.'""")  # fmt: skip
def answer_notes(spark: SparkSession, d: str) -> DataFrame:
    said = engine(spark, d).query(spec={"entity_type": "application", "mode": "count", "filters": [{"field": "reason", "op": "contains", "value": "zzz"}], "defaults_used": ["all time"]})
    return spark.createDataFrame([(n,) for n in said.seen.notes], "note string")


@register("answer_text", f"WITH g AS (SELECT status, count(*) AS n FROM {_APP} WHERE NOT retracted GROUP BY 1) SELECT 'Answer: ' || (SELECT count(*) FROM g) || ' group(s), ' || (SELECT sum(n) FROM g) || ' record(s)' AS line UNION ALL SELECT '- status=' || coalesce(status, 'None') || ': n=' || n FROM g")
def answer_text(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a grouped answer, up to their evidence."""
    said = engine(spark, d).query(spec={"entity_type": "application", "mode": "aggregate", "group_by": [{"field": "status"}]})
    lines = [x.split("  [evidence")[0] for x in said.text.split("\n") if not x.startswith("Note:")]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@register("log_of_questions", "SELECT 'recent' AS view, CAST(3 AS BIGINT) AS n UNION ALL SELECT 'errors', 1 UNION ALL SELECT 'left after purge', 0")
def log_of_questions(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    for question, spec in (("how many applications were turned down?", None), ("nothing that is known", None), ("", {"entity_type": "application", "mode": "count", "filters": [{"field": "no_such", "op": "eq", "value": 1}]})):
        e.query(question, spec)
    counts = {v: e.query_log(v, 50).count() for v in ("recent", "errors")}
    e.purge_query_log()
    return spark.createDataFrame([*counts.items(), ("left after purge", e.query_log().count())], "view string, n long")


@register("readable_views", f"SELECT type, count(*) FILTER (NOT retracted) AS live, count(*) FILTER (retracted) AS retracted FROM {_CURRENT} WHERE type IN ('application', 'holding') GROUP BY 1 UNION ALL SELECT 'rows of application', (SELECT count(*) FROM {_APP} WHERE NOT retracted), 0")
def readable_views(spark: SparkSession, d: str) -> DataFrame:
    """The summary of the written views (types with records), and the rows of one view."""
    from recordweave.sources.store import Store

    folder = f"{shared_folder(spark)}/recordweave/views-{uuid.uuid4().hex}"
    engine(spark, d).write_views(folder)
    views = Store(spark, folder)
    rows = views.table("application").agg(F.count("*").alias("live")).select(F.lit("rows of application").alias("type"), "live", F.lit(0).cast("long").alias("retracted"))
    return views.table("_summary").select("type", "live", "retracted").unionByName(rows)


@register("src_schema_files", "SELECT name, CAST(max(version) AS BIGINT) AS version FROM schemas GROUP BY 1")
def src_schema_files(spark: SparkSession, d: str) -> DataFrame:
    """The last definition of every type, written to a folder of JSON files and read from it (a dictionary)."""
    rows = table(spark, d, "schemas").groupBy("name").agg(F.max("version").alias("version"), F.max_by("definition", "version").alias("definition")).collect()
    with tempfile.TemporaryDirectory() as folder:
        for r in rows:
            (pathlib.Path(folder) / f"{r.name}.json").write_text(json.dumps({"name": r.name, "version": r.version} | json.loads(r.definition)), encoding="utf-8")
        return spark.createDataFrame([(x["name"], int(x["version"])) for x in read_schema_files(folder)], "name string, version long")


@register("src_text_folder", "SELECT 'items/' || item_id || '.md' AS name, prompt AS text FROM eval_items WHERE prompt IS NOT NULL AND trim(prompt) <> ''")
def src_text_folder(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of the evaluation items as a folder of notes, beside files that are none."""
    folder = f"{shared_folder(spark)}/recordweave/notes-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = table(spark, d, "eval_items").where("prompt is not null and trim(prompt) <> ''").select("item_id", "prompt").collect()  # 300, fixed
    for name, body in [*((f"items/{r.item_id}.md", r.prompt) for r in rows), ("skipped.txt", "x"), ("table.csv", "x")]:
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
        out.write(bytearray(body.encode("utf-8")))
        out.close()
    return read_text_folder(spark, folder, ("skipped.txt",))


@register("ingest_references", f"""
WITH q AS (SELECT DISTINCT query FROM resolutions WHERE query IS NOT NULL), k AS (SELECT DISTINCT id, {_normal_sql('name')} AS key FROM companies),
 h AS (SELECT query, count(DISTINCT id) AS n, min(id) AS id FROM q JOIN k ON k.key = {_normal_sql('query')} AND k.key <> '' GROUP BY 1)
SELECT q.query AS said, coalesce(CASE WHEN n = 1 THEN id END, q.query) AS value, CASE WHEN n = 1 THEN '' ELSE 'no certain company' END AS problem FROM q LEFT JOIN h USING (query)""")  # fmt: skip
def ingest_references(spark: SparkSession, d: str) -> DataFrame:
    """Typed company names as values of a reference: only what names one company certainly becomes its id."""
    from recordweave.plans.spec import FieldDef, TypeDef

    said = table(spark, d, "resolutions").where("query is not null").select("query").distinct()
    facts = said.select(F.col("query").alias("span_id"), F.lit("application").alias("type"), F.lit("company_id").alias("field"), F.col("query").alias("value"), F.col("query").alias("quote"), F.lit(None).cast("string").alias("problem"))
    types = {"application": TypeDef("application", {"company_id": FieldDef(ref="company")})}
    out = ingest.with_references(facts, types, {"company": table(spark, d, "companies").select("id", "name")}, {"company": "name"})
    return out.select(F.col("span_id").alias("said"), "value", F.coalesce("problem", F.lit("")).alias("problem"))


@register("ingest_against_the_book", """
WITH s AS (SELECT o_custkey AS k, min(o_orderstatus) AS status FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS record, CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 3 = 0 THEN 'differs' WHEN c_custkey % 2 = 0 THEN 'adds' ELSE 'recorded' END AS outcome FROM customer""")  # fmt: skip
def ingest_against_the_book(spark: SparkSession, d: str) -> DataFrame:
    """Customers as they were read, against a book that lacks every fifth, has others in another segment or without one."""
    c = table(spark, d, "customer")
    said = c.select(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("record"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("fields"))
    segment = F.when(F.col("c_custkey") % 3 == 0, F.lit("elsewhere")).when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment"))
    book = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit("customer").alias("type"), F.to_json(F.struct(F.col("c_name").alias("name"), segment.alias("segment"))).alias("doc"))
    return ingest.against_the_book(said, book, {"customer": ["name"]}).select("record", "outcome")
