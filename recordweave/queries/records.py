"""Registered queries of the operators on records, drafts, writes and logs, each with its SQL.

Rules that the given tables never break are shown on feeds with planted faults: the same rows are changed, by number, in
Spark and in SQL.
"""

from __future__ import annotations

import unicodedata
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.functions.names import LEGAL_WORDS, business_number, candidates, identifier_tokens, normal_name
from recordweave.operators import history, imports, ingest, profile, querylog, recording, text
from recordweave.operators.references import current_rows
from recordweave.plans import diagnostics as diag
from recordweave.plans.planner import ask
from recordweave.plans.spec import FieldDef, TypeDef
from recordweave.queries.catalogue import _APP, _LOG, NOW, ORACLE_SQL, book, record_book, register
from recordweave.queries.replay_sql import FIRST_RECORDINGS, replay_sql
from recordweave.sources.tables import table

_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_event_seq DESC) AS rn FROM entities) WHERE rn = 1)"
#: Payloads planted in every 53rd change, in turn.
FAULTS = ["[1]", "{}", '{"to":"x","odd":1}', '{"target":"x"}', '{"target":"x","payload":[1]}', "no json", '{"target":"x","payload":{"a":1}}']
_FAULTY_SQL = "(SELECT * REPLACE (CASE WHEN seq % 53 = 0 THEN list_extract([" + ", ".join(f"'{f}'" for f in FAULTS) + "], CAST(seq % 7 AS INT) + 1) ELSE payload END AS payload, CASE WHEN seq % 101 = 0 THEN 'renamed' ELSE kind END AS kind) FROM record_events)"


def faulty(spark: SparkSession, d: str) -> DataFrame:
    """The feed with FAULTS planted by seq."""
    chosen = F.element_at(F.array(*map(F.lit, FAULTS)), (F.col("seq") % 7).cast("int") + 1)
    return table(spark, d, "record_events").withColumn("payload", F.when(F.col("seq") % 53 == 0, chosen).otherwise(F.col("payload"))).withColumn("kind", F.when(F.col("seq") % 101 == 0, "renamed").otherwise(F.col("kind")))


def contradicting(spark: SparkSession, d: str) -> DataFrame:
    """The feed with another former status in every 7th status change."""
    to = F.get_json_object("payload", "$.to")
    wrong = F.concat(F.lit('{"to":"'), to, F.lit('","from":"nowhere"}'))
    e = table(spark, d, "record_events")
    return e.withColumn("payload", F.when((F.col("kind") == "status_changed") & (F.col("seq") % 7 == 0), wrong).otherwise(F.col("payload")))


_CONTRADICTING = FIRST_RECORDINGS.replace("FROM record_events", "FROM (SELECT * REPLACE (CASE WHEN kind = 'status_changed' AND seq % 7 = 0 THEN '{\"to\":\"' || (payload->>'to') || '\",\"from\":\"nowhere\"}' ELSE payload END AS payload) FROM record_events)")
_BAD = "list_filter(json_keys(payload), lambda x: x NOT IN ({}))"


@register("payload_checks", f"""
SELECT DISTINCT event_id, problem FROM (SELECT id AS event_id, CASE
  WHEN kind NOT IN ('created', 'updated', 'status_changed', 'migrated', 'corrected', 'retracted') THEN 'unknown kind'
  WHEN NOT json_valid(payload) THEN 'no object' WHEN json_type(payload) <> 'OBJECT' THEN 'no object'
  WHEN kind IN ('updated', 'migrated') AND len(json_keys(payload)) = 0 THEN 'sets nothing'
  WHEN kind = 'status_changed' AND NOT (list_contains(json_keys(payload), 'to') AND len({_BAD.format("'to', 'from'")}) = 0) THEN 'not {{to, from?}}'
  WHEN kind = 'corrected' AND NOT (len(json_keys(payload)) = 2 AND len({_BAD.format("'target', 'payload'")}) = 0 AND json_type(json_extract(payload, '$.payload')) = 'OBJECT') THEN 'not {{target, payload}}'
  WHEN kind = 'retracted' AND len({_BAD.format("'target'")}) > 0 THEN 'not {{}} or {{target}}' END AS problem FROM {_FAULTY_SQL}) WHERE problem IS NOT NULL""")  # fmt: skip
def payload_checks(spark: SparkSession, d: str) -> DataFrame:
    return history.payload_problems(faulty(spark, d))


@register("fold_status_conflicts", replay_sql(_CONTRADICTING) + """
, sets AS (SELECT entity_id, id, kind, ord, CASE WHEN kind = 'status_changed' THEN payload->>'to' ELSE payload->>'status' END AS st, payload->>'from' AS expected, list_contains(json_keys(payload), 'from') AS asks
           FROM data WHERE kind IN ('created', 'status_changed') OR list_contains(json_keys(payload), 'status')),
 l AS (SELECT *, lag(st) OVER (PARTITION BY entity_id ORDER BY ord) AS actual FROM sets)
SELECT id AS event_id, coalesce(expected, '') AS expected, coalesce(actual, '') AS actual FROM l WHERE kind = 'status_changed' AND asks AND expected IS DISTINCT FROM actual""")  # fmt: skip
def fold_status_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return history.status_conflicts(contradicting(spark, d))


@register("fold_conflicts", replay_sql(_CONTRADICTING.replace("FROM record_events)", "FROM record_events WHERE NOT (kind = 'created' AND seq % 5 = 0))")) + """
SELECT entity_id, 'no creation' AS problem FROM data GROUP BY 1 HAVING NOT bool_or(kind = 'created')
UNION ALL SELECT entity_id, 'created already' FROM (SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ord) AS k FROM data WHERE kind = 'created') WHERE k > 1""")  # fmt: skip
def fold_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = contradicting(spark, d).where("not (kind = 'created' and seq % 5 = 0)")
    return history.conflicts(rows).where("problem in ('no creation', 'created already')").select("entity_id", "problem")


@register("record_history", "SELECT entity_id, min(seq) AS first_seq FROM record_events GROUP BY 1")
def record_history(spark: SparkSession, d: str) -> DataFrame:
    return history.first_changes(table(spark, d, "record_events"))


@register("latest_schemas", "SELECT name, CAST(max(version) AS BIGINT) AS version, arg_max(definition, version) AS definition, count(*) AS versions FROM (SELECT name, version, arg_min(definition, created_at) AS definition FROM schemas GROUP BY 1, 2) GROUP BY 1")
def latest_schemas(spark: SparkSession, d: str) -> DataFrame:
    return profile.latest_definitions(table(spark, d, "schemas"))


@register("view_summary", f"SELECT type, count(*) FILTER (NOT retracted) AS live, count(*) FILTER (retracted) AS retracted, max(updated_at) AS updated FROM {_CURRENT} GROUP BY 1")
def view_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").groupBy("id").agg(F.max_by(F.struct("type", "retracted", "updated_at"), "last_event_seq").alias("r")).select("r.*")
    return profile.view_summary(rows)


@register("observed_values_all", "SELECT 'p_brand' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY 2 HAVING (SELECT count(DISTINCT p_brand) FROM part) <= 40 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2 HAVING (SELECT count(DISTINCT p_type) FROM part) <= 40")
def observed_values_all(spark: SparkSession, d: str) -> DataFrame:
    return profile.all_observed_values(table(spark, d, "part").select("p_brand", "p_type", "p_name"), 40)


def _dictionary(spark: SparkSession, d: str) -> dict[str, TypeDef]:
    """The last version of every type of the schemas table, as far as its fields and enums go."""
    import json

    found = {}
    for r in profile.latest_definitions(table(spark, d, "schemas")).collect():  # the dictionary
        fields = {f: x for f, x in (json.loads(r.definition).get("fields") or {}).items() if isinstance(x, dict)}
        found[r.name] = TypeDef(r.name, {f: FieldDef(x.get("type", "string"), enum=tuple(x.get("enum") or ())) for f, x in fields.items()})
    return found


_LIVE_FIELDS = f"""
latest AS (SELECT name, arg_max(definition, version) AS definition FROM (SELECT name, version, arg_min(definition, created_at) AS definition FROM schemas GROUP BY 1, 2) GROUP BY 1),
 live AS (SELECT id, type, doc, unnest(json_keys(doc)) AS field FROM {_CURRENT} WHERE NOT retracted),
 vals AS (SELECT l.type AS entity_type, l.field, json_extract(l.doc, '$."' || l.field || '"') AS v, l.doc->>('$."' || l.field || '"') AS t, s.definition FROM live l JOIN latest s ON s.name = l.type)"""


@register("draft_fields", f"""
WITH {_LIVE_FIELDS},
 d AS (SELECT entity_type, field, v, t, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE lower(json_type(v)) END AS k
       FROM vals WHERE json_type(v) <> 'NULL' AND json_extract(definition, '$.fields."' || field || '"') IS NULL)
SELECT entity_type, field, string_agg(DISTINCT k, ',' ORDER BY k) AS types, count(*) AS n FROM d GROUP BY 1, 2""")  # fmt: skip
def draft_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").groupBy("id").agg(F.max_by(F.struct("type", "doc", "retracted"), "last_event_seq").alias("r")).select("r.*")
    return profile.draft_fields(rows, table(spark, d, "record_events"), _dictionary(spark, d)).select("entity_type", "field", "types", "n")


@register("stray_values", f"""
WITH {_LIVE_FIELDS}
SELECT entity_type, field, t AS value, count(*) AS n FROM vals
WHERE t IS NOT NULL AND json_type(v) <> 'NULL' AND json_array_length(definition, '$.fields."' || field || '".enum') > 1 AND NOT list_contains(CAST(json_extract(definition, '$.fields."' || field || '".enum') AS VARCHAR[])[2:], t) GROUP BY ALL""")  # fmt: skip
def stray_values(spark: SparkSession, d: str) -> DataFrame:
    """Against a dictionary in which every enum has lost its first value."""
    rows = table(spark, d, "entities").groupBy("id").agg(F.max_by(F.struct("type", "doc", "retracted"), "last_event_seq").alias("r")).select("r.*")
    known = {n: replace(t, fields={f: replace(x, enum=x.enum[1:]) for f, x in t.fields.items()}) for n, t in _dictionary(spark, d).items()}
    return profile.stray_values(rows, known)


@register("unknown_field_samples", """
WITH c AS (SELECT entity_type, field, CAST(sample AS VARCHAR) AS v, count(*) AS n FROM schema_observations WHERE sample IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity_type, field ORDER BY n DESC, v) AS k FROM c)
SELECT entity_type, field, string_agg(v, '|' ORDER BY k) AS samples FROM r WHERE k <= 5 GROUP BY 1, 2""")  # fmt: skip
def unknown_field_samples(spark: SparkSession, d: str) -> DataFrame:
    return profile.unknown_fields(table(spark, d, "schema_observations")).select("entity_type", "field", F.array_join("samples", "|").alias("samples"))


@register("infer_fields", r"""
WITH k AS (SELECT entity_type, field, count(*) AS n, list_sort(list(DISTINCT sample)) AS vs,
   CASE WHEN bool_and(sample IN ('true', 'false')) THEN 'boolean' WHEN bool_and(regexp_full_match(sample, '-?\d{1,18}')) THEN 'integer' WHEN bool_and(regexp_full_match(sample, '-?\d+(\.\d+)?([eE][+-]?\d+)?')) THEN 'number'
        WHEN bool_and(json_valid(sample) AND starts_with(ltrim(sample), '[')) THEN 'array' WHEN bool_and(regexp_full_match(sample, '\d{4}-\d{2}-\d{2}') AND TRY_CAST(sample AS DATE) IS NOT NULL) THEN 'date'
        WHEN bool_and(regexp_full_match(sample, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})')) THEN 'date-time' ELSE 'string' END AS type FROM schema_observations WHERE sample IS NOT NULL GROUP BY 1, 2)
SELECT entity_type, field, type, CASE WHEN type = 'string' AND n >= 3 AND len(vs) <= 5 THEN array_to_string(vs, '|') ELSE '' END AS enum_candidates FROM k""")  # fmt: skip
def infer_fields(spark: SparkSession, d: str) -> DataFrame:
    return profile.inferred_fields(table(spark, d, "schema_observations"), ["entity_type", "field"], "sample").withColumn("enum_candidates", F.array_join("enum_candidates", "|"))


@register("kind_judged", "SELECT 'daily' AS name, 'series' AS kind, 'event_type' AS keys UNION ALL SELECT 'customer', 'entity', ''")
def kind_judged(spark: SparkSession, d: str) -> DataFrame:
    """The daily series and the customers (with a day of their own): a series by event_type, and records."""
    daily = book(spark, d).series["daily"].withColumn("day", F.col("day").cast("string"))
    people = table(spark, d, "customer").select("c_name", "c_mktsegment", "c_acctbal", F.lit("2001-01-01").alias("day"))
    rows = [(n, j["kind"], ",".join(j["signals"].get("key") or [])) for n, j in (("daily", profile.judged_kind(daily)), ("customer", profile.judged_kind(people)))]
    return spark.createDataFrame(rows, "name string, kind string, keys string")


# names and identifiers


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _normal_sql(x: str) -> str:
    """The normal form of a name in an engine without look-around: legal forms between other characters, replaced twice."""
    forms = sorted({unicodedata.normalize("NFKC", w) for w in LEGAL_WORDS}, key=len, reverse=True)
    escape = lambda w: "".join(f"\\{c}" if c in ".()" else c for c in w)
    latin = "|".join(escape(w) for w in forms if w.isascii() and w[0].isalpha())
    other = "|".join(escape(w) for w in forms if not (w.isascii() and w[0].isalpha()))
    s = f"lower(trim(translate(replace(replace({x}, '㈜', '(주)'), '　', ' '), '{_WIDE}', '{_NARROW}')))"
    for _ in range(2):
        s = f"regexp_replace({s}, '(^|[^a-z0-9])(?:{latin})($|[^a-z0-9])', '\\1 \\2', 'g')"
    s = f"regexp_replace({s}, '{other}', ' ', 'g')"
    outer = f"regexp_replace({s}, '\\([^()]*\\)', '', 'g')"
    kept = f"CASE WHEN regexp_matches({outer}, '[^\\x00-\\x7F]') AND regexp_matches({outer}, '[\\pL\\pN]') THEN regexp_replace({s}, '\\([\\x00-\\x27\\x2A-\\x7F]*\\)', '', 'g') ELSE {s} END"
    return f"coalesce(regexp_replace({kept}, '[^\\pL\\pN]+', '', 'g'), '')"


@register("name_keys", f"SELECT id, {_normal_sql('name')} AS key, coalesce(CASE WHEN length(regexp_replace(business_number, '[^0-9]', '', 'g')) = 10 THEN regexp_replace(business_number, '[^0-9]', '', 'g') END, '') AS number FROM companies")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "companies").select("id", normal_name("name").alias("key"), F.coalesce(business_number("business_number"), F.lit("")).alias("number"))


_TOKENS = f"list_distinct(list_filter(list_transform(regexp_extract_all(lower(translate(query, '{_WIDE}', '{_NARROW}')), '[a-z0-9][a-z0-9-]*'), lambda t: replace(t, '-', '')), lambda t: length(t) >= 4))"
ORACLE_SQL["identity_cascade"] = f"""
WITH q AS (SELECT DISTINCT query_id, query FROM resolutions),
 k AS (SELECT DISTINCT id, 1 AS rank, regexp_replace(lower(business_number), '[^0-9a-z]', '', 'g') AS key FROM companies UNION SELECT id, 2, {_normal_sql('name')} FROM companies
       UNION SELECT id, 3, {_normal_sql('a')} FROM (SELECT id, unnest(aliases) AS a FROM companies)),
 w AS (SELECT query_id, 1 AS rank, unnest({_TOKENS}) AS key FROM q UNION ALL SELECT query_id, 2, {_normal_sql('query')} FROM q UNION ALL SELECT query_id, 3, {_normal_sql('query')} FROM q),
 h AS (SELECT query_id, rank, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(DISTINCT id) AS n FROM w JOIN k USING (rank, key) WHERE key <> '' GROUP BY 1, 2),
 b AS (SELECT query_id, arg_min(ids, rank) AS ids, arg_min(n, rank) AS n, min(rank) AS rank FROM h GROUP BY 1)
SELECT i.query_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'match' ELSE 'ambiguous' END AS status, coalesce(CASE rank WHEN 1 THEN 'identifier:business_number' WHEN 2 THEN 'normalized_name' WHEN 3 THEN 'alias' END, '') AS rule, coalesce(ids, '') AS ids
FROM (SELECT DISTINCT query_id FROM q) i LEFT JOIN b USING (query_id)"""


@register("identifier_tokens", f"SELECT query_id, array_to_string(list_sort({_TOKENS}), ',') AS tokens FROM (SELECT DISTINCT query_id, query FROM resolutions)")
def identifier_tokens_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resolutions").select("query_id", "query").distinct().select("query_id", F.array_join(F.array_sort(identifier_tokens("query")), ",").alias("tokens"))


@register("name_candidates")
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five likest companies of the queries whose id is divisible by 100, against all companies."""
    asked = table(spark, d, "resolutions").where("query_id % 100 = 0").select("query_id", "query").distinct()
    return candidates(asked, table(spark, d, "companies").select("id", "name", "aliases"))


@register("stable_ids", "SELECT o_orderkey AS k, 'ord_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS id FROM orders")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), recording.stable_id("ord", F.col("o_orderkey")).alias("id"))


@register("ref_name_is", f"SELECT count(*) AS n FROM {_APP} WHERE NOT retracted AND company_id = (SELECT min(id) FROM companies WHERE business_number IS NOT NULL)")
def ref_name_is(spark: SparkSession, d: str) -> DataFrame:
    """Applications at the company that a business number names."""
    b = record_book(spark, d)
    firms = table(spark, d, "companies")
    b.types = b.types | {"company": TypeDef("company", {"name": FieldDef(), "business_number": FieldDef(identifier=True)})}
    b.entities["company"], b.names["company"] = firms, "name"
    number = firms.where("business_number is not null").agg(F.min_by("business_number", "id")).first()[0]
    return ask(b, {"entity_type": "application", "mode": "count", "filters": [{"field": "company_id", "op": "name_is", "value": f"No. {number}"}]}).rows


@register("ref_id_rewrite", "SELECT count(*) AS n FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer)")
def ref_id_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer who is named where an id belongs."""
    b = book(spark, d)
    name = b.entities["customer"].agg(F.min_by("name", "id")).first()[0]
    b.entities["customer"] = b.entities["customer"].withColumn("id", F.col("id").cast("string"))
    b.entities["order"] = b.entities["order"].withColumn("customer_id", F.col("customer_id").cast("string"))
    return ask(b, {"entity_type": "order", "mode": "count", "filters": [{"field": "customer_id", "op": "eq", "value": name}]}).rows


@register("value_groups", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P')")
def value_groups(spark: SparkSession, d: str) -> DataFrame:
    b = book(spark, d)
    fields = b.types["order"].fields
    b.types = b.types | {"order": TypeDef("order", fields | {"status": FieldDef(enum=fields["status"].enum, groups={"not finished": ["P", "O"]})})}
    return ask(b, {"entity_type": "order", "mode": "count", "filters": [{"field": "status", "op": "eq", "value": "Not finished"}]}).rows


@register("evt_entity_ids", f"SELECT DISTINCT entity_id FROM {_LOG} WHERE kind = 'status_changed' AND \"to\" = 'passed'")
def evt_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    spec = {"source": "events", "entity_type": "application", "mode": "count", "filters": [{"field": "kind", "op": "eq", "value": "status_changed"}, {"field": "to", "op": "eq", "value": "passed"}]}
    return ask(record_book(spark, d), spec).entity_ids


# diagnostics


@register("diag_partial_coverage", "SELECT 'price' AS field, count(*) AS records FROM part WHERE p_partkey % 3 = 0 AND p_size <= 25")
def diag_partial_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Parts that only one of two sources has; parts above size 25 count as retracted."""
    parts = table(spark, d, "part")
    coverage = parts.select(F.col("p_partkey").alias("entity_id"), F.lit("price").alias("field"), F.lit(2).alias("sources"), F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(2).alias("present"))
    return diag.partial_coverage(coverage, parts.where("p_size <= 25").select(F.col("p_partkey").alias("id")))


@register("diag_history_start", f"SELECT min(created_at) AS first, max(created_at) AS last FROM {_CURRENT} WHERE type = 'application' AND id IN (SELECT entity_id FROM {_LOG} WHERE kind = 'status_changed')")
def diag_history_start(spark: SparkSession, d: str) -> DataFrame:
    b = record_book(spark, d)
    answer = ask(b, {"source": "events", "entity_type": "application", "mode": "count", "filters": [{"field": "kind", "op": "eq", "value": "status_changed"}]})
    return diag.history_start(b, answer, "application")


@register("diag_immature", "SELECT count(*) AS records FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) >= DATE '2001-05-24'")
def diag_immature(spark: SparkSession, d: str) -> DataFrame:
    answer = ask(book(spark, d), {"entity_type": "order", "mode": "count", "filters": [{"field": "status", "op": "eq", "value": "O"}]})
    return diag.immature(answer, "ordered_on", NOW.date(), 70)


# imports and logs


@register("import_outcomes", """
SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'created' WHEN o_orderkey % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS action,
 CASE WHEN o_orderkey % 11 = 0 THEN '{"prio":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' WHEN o_orderkey % 7 = 0 THEN '{"gone":null,"prio":"' || o_orderpriority || '"}' END AS payload FROM orders""")  # fmt: skip
def import_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string").alias("k")
    source = o.select(key, F.to_json(F.struct(F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("status"))).alias("doc"))
    old = F.when(F.col("o_orderkey") % 7 == 0, F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.lit("x").alias("gone")))).otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"))))
    return imports.outcomes(source, o.where("o_orderkey % 11 <> 0").select(key, old.alias("doc")), "k")


@register("import_vanished_owned", f"""
SELECT id AS k FROM {_CURRENT} WHERE type = 'trade' AND doc->>'account' = 'real' AND id NOT LIKE '%3'
 AND id IN (SELECT entity_id FROM record_events WHERE kind = 'created' AND recorded_by = (SELECT min(recorded_by) FROM record_events))""")  # fmt: skip
def import_vanished_owned(spark: SparkSession, d: str) -> DataFrame:
    """Real trades that one recorder created and that a source holding only ids that end in 3 no longer has."""
    e = table(spark, d, "record_events")
    state = current_rows(table(spark, d, "entities")).where("type = 'trade'").select("id", F.col("id").alias("k"), "doc")
    recorder = e.agg(F.min("recorded_by")).first()[0]
    return imports.vanished(state.where("id like '%3'").select("k"), state, "k", F.get_json_object("doc", "$.account") == "real", (e, recorder))


_QL = "(SELECT event_id AS id, event_type AS question_norm, CAST(event_id % 3 AS VARCHAR) AS sql, value AS ms, CAST(event_id % 100 AS BIGINT) AS tokens, event_id % 4 = 0 AS ok FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("question_norm"), (F.col("event_id") % 3).cast("string").alias("sql"), F.col("value").alias("ms"), (F.col("event_id") % 100).alias("tokens"), (F.col("event_id") % 4 == 0).alias("ok"))


@register("log_readings", f"SELECT question_norm, count(DISTINCT sql) AS plans, count(*) AS asked FROM {_QL} GROUP BY 1")
def log_readings(spark: SparkSession, d: str) -> DataFrame:
    return querylog.readings(_log(spark, d))


@register("log_variants", f"SELECT question_norm, sql, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM {_QL} GROUP BY 1, 2")
def log_variants(spark: SparkSession, d: str) -> DataFrame:
    return querylog.variants(_log(spark, d))


@register("trace_totals", f"SELECT question_norm, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_QL} GROUP BY 1")
def trace_totals(spark: SparkSession, d: str) -> DataFrame:
    return querylog.trace_totals(_log(spark, d).select("question_norm", "tokens"), ["question_norm"])


@register("bench_summaries", f"SELECT question_norm, count(*) AS runs, CAST(CAST(round(avg(ms), 4) AS DECIMAL(18,4)) AS VARCHAR) AS mean, CAST(CAST(round(quantile_cont(ms, 0.95), 4) AS DECIMAL(18,4)) AS VARCHAR) AS p95, CAST(CAST(round(avg(ok::INT), 4) AS DECIMAL(18,4)) AS VARCHAR) AS share FROM {_QL} GROUP BY 1")
def bench_summaries(spark: SparkSession, d: str) -> DataFrame:
    fine = lambda c: F.round(F.col(c), 4).cast("decimal(18,4)").cast("string").alias(c)
    return querylog.summaries(_log(spark, d), ["question_norm"], "ms", "ok").select("question_norm", "runs", fine("mean"), fine("p95"), fine("share"))


# writes


@register("write_review", """
WITH past AS (SELECT * FROM record_events WHERE seq % 10 <> 0),
 batch AS (SELECT * REPLACE (CASE WHEN seq % 40 = 0 THEN '' ELSE recorded_by END AS recorded_by) FROM record_events WHERE seq % 10 = 0),
 both_ AS (SELECT id, entity_id, kind, target_event_id FROM past UNION ALL SELECT id, entity_id, kind, target_event_id FROM batch),
 born AS (SELECT entity_id, count(DISTINCT id) AS births FROM both_ WHERE kind = 'created' GROUP BY 1),
 gone AS (SELECT DISTINCT entity_id FROM past WHERE kind = 'retracted' AND target_event_id IS NULL)
SELECT b.id, CASE WHEN trim(recorded_by) = '' THEN 'no recorder' WHEN b.id IN (SELECT id FROM past) THEN 'repeated' WHEN kind IN ('corrected', 'retracted') AND coalesce(trim(evidence), '') = '' THEN 'no evidence'
  WHEN b.entity_id IN (SELECT entity_id FROM gone) THEN 'record is retracted' WHEN coalesce(births, 0) = 0 THEN 'no such record' WHEN kind = 'created' AND births > 1 THEN 'record exists'
  WHEN kind IN ('corrected', 'retracted') AND target_event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM both_ o WHERE o.entity_id = b.entity_id AND o.id = b.target_event_id) THEN 'no such target in the record' ELSE 'other' END AS problem
FROM (SELECT DISTINCT ON (id) * FROM batch ORDER BY id, seq) b LEFT JOIN born USING (entity_id)""")  # fmt: skip
def write_review(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth change as a batch against the others; every fourth of these without a recorder. What later rules say, and
    accepted changes, are given as one outcome."""
    e = table(spark, d, "record_events")
    batch = e.where("seq % 10 = 0").withColumn("recorded_by", F.when(F.col("seq") % 40 == 0, "").otherwise(F.col("recorded_by")))
    batch = batch.groupBy("id").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")
    out = recording.reviewed(e.where("seq % 10 <> 0"), batch)
    told = ["repeated", "no evidence", "record is retracted", "no such record", "record exists", "no such target in the record"]
    return out.select("id", F.when(F.col("problem").startswith("no id"), "no recorder").when(F.col("problem").isin(*told), F.col("problem")).otherwise("other").alias("problem"))


# text


@register("evidence_checks", """
SELECT k, CASE WHEN k % 2 = 0 AND NOT (list_contains(list_transform(regexp_extract_all(q, '-?\\d[\\d,]*(?:\\.\\d+)?'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)), CAST(k AS DOUBLE))) THEN 'number not in the quote' END AS problem
FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'about ' || CAST(o_orderkey + 1 AS VARCHAR) ELSE 'order ' || CAST(o_orderkey AS VARCHAR) || ' of 7' END AS q FROM orders) WHERE k % 2 = 0 OR TRUE""")  # fmt: skip
def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit("about "), (k + 1).cast("string"))).otherwise(F.concat(F.lit("order "), k.cast("string"), F.lit(" of 7"))).alias("q"))
    problem = text.evidence_problem(FieldDef("number"), F.col("k").cast("string"), F.col("q"))
    return rows.select("k", F.when(F.col("k") % 2 == 0, problem).alias("problem"))


@register("chunks_classified", "SELECT doc_id, CASE WHEN contains(lower(text), 'javascript') THEN 'notice' ELSE 'ambiguous' END AS type FROM documents WHERE text IS NOT NULL AND (lang = 'de' OR lang IS NULL)")
def chunks_classified(spark: SparkSession, d: str) -> DataFrame:
    """Documents in German or of no known language, called notices if they speak of scripts."""
    rows = table(spark, d, "documents").where("text is not null and (lang = 'de' or lang is null)").select("doc_id", F.col("text").alias("chunk"))
    return ingest.classified(rows, ingest.by_words({"notice": ["javascript"]})).select("doc_id", "type")

