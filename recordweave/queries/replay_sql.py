"""The replay of a change feed as SQL, for an engine that is none of ours."""

FIRST_RECORDINGS = """
  SELECT *, CAST("at" AS TIMESTAMPTZ) AS at_t, CAST(recorded_at AS TIMESTAMPTZ) AS rec_t, epoch_us(CAST("at" AS TIMESTAMPTZ)) AS at_us
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM record_events) WHERE rn = 1
"""


def replay_sql(first: str) -> str:
    """CTEs over first recordings: f, void, gone (retracted as a whole), cor, placed, data (applied changes by ord), said
    (one row per field that a change sets, v null where it removes it), vals (the last of them) and tail."""
    return f"""
WITH f AS ({first}),
 void AS (SELECT DISTINCT entity_id, target_event_id AS id FROM f WHERE kind = 'retracted' AND target_event_id IS NOT NULL),
 gone AS (SELECT DISTINCT entity_id FROM f WHERE kind = 'retracted' AND target_event_id IS NULL),
 cor AS (SELECT entity_id, target_event_id AS id, arg_max(json_extract(payload, '$.payload'), seq) AS payload FROM f
         WHERE kind = 'corrected' AND NOT EXISTS (SELECT 1 FROM void v WHERE v.entity_id = f.entity_id AND v.id = f.id) GROUP BY 1, 2),
 placed AS (SELECT *, CASE WHEN at_precision = 'unknown' THEN max(CASE WHEN at_precision <> 'unknown' THEN at_us END)
              OVER (PARTITION BY entity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) ELSE at_us END AS place FROM f),
 data AS (SELECT p.entity_id, p.id, p.kind, p.at_us, coalesce(c.payload, CAST(p.payload AS JSON)) AS payload,
            row_number() OVER (PARTITION BY p.entity_id ORDER BY p.kind <> 'created', coalesce(place, -1), seq) AS ord
          FROM placed p LEFT JOIN cor c ON c.entity_id = p.entity_id AND c.id = p.id
          WHERE p.kind NOT IN ('corrected', 'retracted') AND NOT EXISTS (SELECT 1 FROM void v WHERE v.entity_id = p.entity_id AND v.id = p.id)),
 pieces AS (SELECT entity_id, id, kind, ord, unnest(json_keys(body)) AS field, body FROM (
            SELECT entity_id, id, kind, ord, CASE WHEN kind = 'status_changed' THEN json_object('status', json_extract(payload, '$.to')) ELSE payload END AS body FROM data)),
 said AS (SELECT entity_id, id, kind, ord, field, json_extract_string(body, '$."' || field || '"') AS v FROM pieces),
 vals AS (SELECT entity_id, field, arg_max(struct_pack(v := v), ord).v AS v FROM said GROUP BY 1, 2),
 tail AS (SELECT entity_id, arg_max(id, ord) AS last_event_id, bool_or(kind = 'created') AS known FROM data GROUP BY 1)
"""
