"""The pN_ queries of the general problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.operators import changefeed, drift, lateness, pointintime, references
from recordweave.queries.replay_sql import FIRST_RECORDINGS, replay_sql
from recordweave.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.p1_found(table(spark, d, "record_events"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.p2_found(table(spark, d, "entities"), table(spark, d, "schemas"))


def p2_trades(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of trades, failed casts joined to one text."""
    found = drift.consistent_table(table(spark, d, "entities"), table(spark, d, "schemas"), "trade")
    return found.withColumn("failed_casts", F.array_join("failed_casts", ",")).withColumn("executed_at", F.col("executed_at").cast("string")).drop("other")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The consistent tables of every type, with the fields that no version declares."""
    return drift.consistent_values(table(spark, d, "entities"), table(spark, d, "schemas"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The path statistics of every file, without their sketches."""
    return drift.path_statistics(drift.current_records(table(spark, d, "entities"))).select("type", "version", "path", "json_type", "n")


def p2_failed(spark: SparkSession, d: str) -> DataFrame:
    return drift.failed_casts(table(spark, d, "entities"), table(spark, d, "schemas")).drop("file")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lateness.late_events(table(spark, d, "record_events"))


def p4_triangle(spark: SparkSession, d: str) -> DataFrame:
    return lateness.arrival_triangle(lateness.arrival_cells(table(spark, d, "record_events"))).fillna(0, ["final_count"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pointintime.p5_found(table(spark, d, "record_events"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.p6_found(*(table(spark, d, n) for n in ("entities", "companies", "schemas", "record_events")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_trades": p2_trades,
    "p2_values": p2_values,
    "p2_files": p2_files,
    "p2_failed": p2_failed,
    "p4_found": p4_found,
    "p4_triangle": p4_triangle,
    "p5_found": p5_found,
    "p6_found": p6_found,
}

_FIRST = FIRST_RECORDINGS

_CELLS = f"""
  SELECT id, strftime(at_t AT TIME ZONE 'UTC', '%Y-%m-%d') AS period,
         CAST(CASE WHEN epoch_us(rec_t) < e THEN 0 ELSE greatest(1, (epoch_us(rec_t) - e + 86399999999) // 86400000000) END AS BIGINT) AS revision
  FROM (SELECT *, (epoch_us(at_t) // 86400000000 + 1) * 86400000000 AS e FROM ({_FIRST})) WHERE at_precision = 'time'
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": replay_sql(_FIRST) + """
, docs AS (SELECT entity_id, coalesce(max(v) FILTER (field = 'status'), '') AS status, coalesce(max(v) FILTER (field = 'expected_rate'), '') AS expected_rate,
            CAST(count(v) AS BIGINT) AS n_fields FROM vals GROUP BY 1)
SELECT entity_id, status, expected_rate, n_fields, last_event_id FROM docs JOIN tail USING (entity_id)
WHERE entity_id NOT IN (SELECT entity_id FROM gone)
""",
    # the replay once per outcome, over the changes that had happened and were recorded before it
    "p5_found": replay_sql(f"""
  SELECT e.id, o.id AS entity_id, e.kind, e.payload, e.at_us, e.seq, e.at_precision, e.target_event_id FROM ({_FIRST}) e JOIN ({_FIRST}) o USING (entity_id)
  WHERE o.kind = 'status_changed' AND o.at_precision = 'time' AND o.payload->>'to' IN ('passed', 'rejected') AND e.at_t < o.at_t AND e.rec_t < o.at_t""") + f"""
, docs AS (SELECT entity_id, max(v) FILTER (field = 'status') AS status, max(v) FILTER (field = 'expected_rate') AS expected_rate FROM vals GROUP BY 1),
 had AS (SELECT entity_id, string_agg(DISTINCT v, ',' ORDER BY v) AS reached FROM said WHERE field = 'status' AND v IS NOT NULL GROUP BY 1)
SELECT o.id AS event_id, CASE WHEN t.known THEN coalesce(d.status, '') ELSE '' END AS status, CASE WHEN t.known THEN coalesce(d.expected_rate, '') ELSE '' END AS expected_rate, CASE WHEN t.known THEN coalesce(h.reached, '') ELSE '' END AS reached
FROM ({_FIRST}) o LEFT JOIN tail t ON t.entity_id = o.id LEFT JOIN docs d ON d.entity_id = o.id LEFT JOIN had h ON h.entity_id = o.id
WHERE o.kind = 'status_changed' AND o.at_precision = 'time' AND o.payload->>'to' IN ('passed', 'rejected')
""",
    "p2_trades": """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_event_seq DESC) AS rn FROM entities) WHERE rn = 1 AND type = 'trade')
SELECT id, CAST(schema_version AS BIGINT) AS version, doc->>'source_key' AS source_key, doc->>'security_id' AS security_id, doc->>'account' AS account, doc->>'side' AS side,
       coalesce(doc->>'executed_at', doc->>'traded_at') AS executed_at, CAST(doc->>'units' AS DOUBLE) AS units, CAST(doc->>'price' AS DOUBLE) AS price,
       CAST(doc->>'amount' AS BIGINT) AS amount, CAST(doc->>'pnl' AS DOUBLE) AS pnl, doc->>'note' AS note, CAST(doc->>'fee' AS DOUBLE) AS fee,
       coalesce(doc->>'venue', doc->>'market') AS venue, '' AS failed_casts
FROM cur
""",
    "p2_files": """
WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_event_seq DESC) AS rn FROM entities) WHERE rn = 1),
 f AS (SELECT type, CAST(schema_version AS BIGINT) AS version, doc, unnest(json_keys(doc)) AS path FROM cur),
 t AS (SELECT type, version, path, json_type(json_extract(doc, '$."' || path || '"')) AS k FROM f)
SELECT type, version, path, CASE k WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' ELSE lower(k) END AS json_type, count(*) AS n
FROM t WHERE k <> 'NULL' GROUP BY ALL
UNION ALL SELECT type, CAST(schema_version AS BIGINT), '', '', count(*) FROM cur GROUP BY ALL
""",
    "p4_found": f"""
SELECT id AS event_id, period, CASE WHEN revision > 7 THEN 'dropped' ELSE 'corrects' END AS outcome FROM ({_CELLS}) WHERE revision > 0
""",
    "p4_triangle": f"""
WITH n AS (SELECT period, revision, count(*) AS arrived FROM ({_CELLS}) GROUP BY 1, 2),
 c AS (SELECT *, CAST(sum(arrived) OVER (PARTITION BY period ORDER BY revision) AS BIGINT) AS corrected FROM n)
SELECT period, revision, arrived, corrected, revision > 7 AS closed,
       coalesce(max(CASE WHEN revision <= 7 THEN corrected END) OVER (PARTITION BY period), 0) AS final_count FROM c
""",
    "p6_found": f"""
WITH f AS ({_FIRST}),
 cur AS (SELECT *, CAST(created_at AS TIMESTAMPTZ) AS c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_event_seq DESC) AS rn FROM entities) WHERE rn = 1),
 refs AS (SELECT 'entities' AS source_table, id AS source_id, field, json_extract_string(doc, '$.' || field) AS target_id, c,
            CASE WHEN field = 'company_id' THEN 'companies' ELSE 'entities' END AS tt
          FROM cur, (SELECT unnest(['company_id', 'posting_id', 'security_id']) AS field)
          WHERE NOT retracted AND (field <> 'posting_id' OR type = 'application') AND (field <> 'company_id' OR type IN ('application', 'posting'))),
 keys AS (SELECT 'entities' AS tt, id, retracted, c FROM cur UNION ALL SELECT 'companies', id, retracted, CAST(created_at AS TIMESTAMPTZ) FROM companies)
SELECT source_table, source_id, field, target_id,
       CASE WHEN k.id IS NULL THEN 'missing' WHEN k.retracted THEN 'retracted' ELSE 'later' END AS reason, strftime(r.c AT TIME ZONE 'UTC', '%Y-%m') AS period
FROM refs r LEFT JOIN keys k ON k.tt = r.tt AND k.id = r.target_id
WHERE trim(target_id) <> '' AND (k.id IS NULL OR k.retracted OR k.c > r.c)
UNION
SELECT 'record_events', a.id, 'target_event_id', a.target_event_id, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'later' END, strftime(a.at_t AT TIME ZONE 'UTC', '%Y-%m')
FROM f a LEFT JOIN f b ON b.id = a.target_event_id
WHERE trim(a.target_event_id) <> '' AND (b.id IS NULL OR b.seq > a.seq)
""",
}
