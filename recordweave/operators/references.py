"""References to records that do not exist.

Every row that refers adds +1 to its key's reference count, every row that exists +1 and every retraction -1 to
its key's existence count. Keys with references and no existence are orphans; keys first seen after their
earliest reference are late for some referrers. Counts combine map-side, so a key that a third of all rows refer
to costs one partial row per task; the detailed report joins only rows whose key is in question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.functions.times import instant_us, utc_month_text
from recordweave.operators.skew import hot_keys, salted_join
from recordweave.runtime import materialise


def key_counts(references: DataFrame, existence: DataFrame) -> DataFrame:
    """Signed counts per (target_table, target_id).

    references: target_table, target_id, moment (long; when the reference was made), delta (+1 made, -1 withdrawn).
    existence: target_table, target_id, moment (when the record came to be), delta (+1 exists, -1 retracted).
    Result: target_table, target_id, refs, exists, seen (rows of the key), since, first_ref (earliest moments).
    """
    n = F.lit(None).cast("long")
    deltas = references.select("target_table", "target_id", F.col("delta").alias("r"), F.lit(0).alias("e"), F.lit(0).alias("s"), n.alias("since"), F.col("moment").alias("asked")).unionByName(
        existence.select("target_table", "target_id", F.lit(0).alias("r"), F.col("delta").alias("e"), F.when(F.col("delta") > 0, 1).otherwise(0).alias("s"), F.col("moment").alias("since"), n.alias("asked"))
    )
    return deltas.groupBy("target_table", "target_id").agg(
        F.sum("r").alias("refs"), F.sum("e").alias("exists"), F.sum("s").alias("seen"), F.min("since").alias("since"), F.min("asked").alias("first_ref")
    )


def orphans(references: DataFrame, existence: DataFrame) -> DataFrame:
    """The rows of ``references`` that lead nowhere, with ``reason``: missing, retracted or later (first that holds)."""
    counts = materialise(key_counts(references, existence), "key-counts")  # read for the hot keys and for the join
    dead = (F.col("refs") > 0) & (F.col("exists") <= 0)
    late = F.col("since") > F.col("first_ref")
    key = ["target_table", "target_id"]
    asked = counts.where(dead | late).select(*key, "refs", "exists", "seen", "since")
    joined = salted_join(references, asked, key, hot_keys(asked, key, "refs"))
    reason = F.when(F.col("seen") == 0, "missing").when(F.col("exists") <= 0, "retracted").when(F.col("since") > F.col("moment"), "later")
    return joined.withColumn("reason", reason).where("reason is not null").drop("refs", "exists", "seen", "since")


def reference_fields(schemas: DataFrame) -> list[tuple[str, str, str]]:
    """(type, field, referred type) of every field with a ``ref`` in any registered version (a dictionary: small)."""
    import json

    found = set()
    for row in schemas.select("name", "definition").distinct().collect():
        for field, spec in (json.loads(row.definition or "{}").get("fields") or {}).items():
            if isinstance(spec, dict) and spec.get("ref"):
                found.add((row.name, field, spec["ref"]))
    return sorted(found)


def current_rows(entities: DataFrame) -> DataFrame:
    """The row of highest last_event_seq per id; a null flag means not retracted."""
    row = F.min_by(F.struct("type", "doc", "retracted", "created_at"), F.struct(-F.coalesce("last_event_seq", F.lit(-1)), "created_at"))
    return entities.where("id is not null").groupBy("id").agg(row.alias("r")).select("id", "r.type", "r.doc", F.coalesce("r.retracted", F.lit(False)).alias("retracted"), instant_us(F.col("r.created_at")).alias("created_us"))


def p6_found(entities: DataFrame, companies: DataFrame, schemas: DataFrame, events: DataFrame) -> DataFrame:
    """source_table, source_id, field, target_id, reason, period of each reference that leads nowhere.

    Empty and null references are none; docs that are no JSON objects hold none; a referring row without a
    readable created_at has period "" and is late for nothing.
    """
    rows = current_rows(entities)
    fields = reference_fields(schemas)
    per_type: dict[str, list[tuple[str, str]]] = {}
    for kind, field, ref in fields:
        per_type.setdefault(kind, []).append((field, "companies" if ref == "company" else "entities"))
    cases = F.lit(None).cast("array<struct<field:string,target_table:string,target_id:string>>")
    for kind, pairs in per_type.items():
        made = [F.struct(F.lit(f).alias("field"), F.lit(t).alias("target_table"), F.get_json_object("doc", f"$['{f}']").alias("target_id")) for f, t in pairs]
        cases = F.when(F.col("type") == kind, F.array(*made)).otherwise(cases)
    held = rows.where(~F.col("retracted")).select("id", "created_us", F.explode(cases).alias("x"))
    made = held.select(
        F.lit("entities").alias("source_table"), F.col("id").alias("source_id"), "x.field", "x.target_table", "x.target_id",
        F.col("created_us").alias("moment"), F.coalesce(utc_month_text(F.col("created_us")), F.lit("")).alias("period"),
    )
    told = events.where("id is not null and seq is not null").groupBy("id").agg(F.min_by(F.struct("seq", "target_event_id", "at"), "seq").alias("r"))
    told = told.select("id", "r.*").withColumn("seq", F.col("seq").cast("long"))
    aimed = told.select(
        F.lit("record_events").alias("source_table"), F.col("id").alias("source_id"), F.lit("target_event_id").alias("field"), F.lit("record_events").alias("target_table"),
        F.col("target_event_id").alias("target_id"), F.col("seq").alias("moment"), F.coalesce(utc_month_text(instant_us(F.col("at"))), F.lit("")).alias("period"),
    )
    references = made.unionByName(aimed).where("target_id is not null and trim(target_id) <> ''").withColumn("delta", F.lit(1))

    one, gone = F.lit(1), F.array(F.lit(1), F.lit(-1))
    alive = lambda df, name: df.select(F.lit(name).alias("target_table"), F.col("id").alias("target_id"), F.col("created_us").alias("moment"), F.explode(F.when(F.col("retracted"), gone).otherwise(F.array(one))).alias("delta"))
    firms = companies.where("id is not null").select("id", F.coalesce("retracted", F.lit(False)).alias("retracted"), instant_us(F.col("created_at")).alias("created_us"))
    existence = alive(rows, "entities").unionByName(alive(firms, "companies"))
    targets = told.select(F.lit("record_events").alias("target_table"), F.col("id").alias("target_id"), F.col("seq").alias("moment"), one.alias("delta"))
    return orphans(references, existence.unionByName(targets)).select("source_table", "source_id", "field", "target_id", "reason", "period").distinct()
