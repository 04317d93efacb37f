"""Writing to the change feed: which changes of a batch are accepted, the numbers they get, and the records they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.functions.times import instant_us
from recordweave.operators.changefeed import replay_rows, resolved, with_age
from recordweave.operators.feed import DATA_KINDS, META_KINDS, readable
from recordweave.operators.history import conflicts_of, payload_problems, reached_of, times_of
from recordweave.plans.dictionary import violations
from recordweave.plans.spec import TypeDef
from recordweave.runtime import materialise

RECORD_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"


def reviewed(history: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` with ``problem`` ("" if accepted). Checks shape, time, evidence of corrections and retractions, that the
    record exists (or not yet) and is of the type, is not retracted, and that targets are events of the same record which
    may be aimed at: no created event is retracted alone, no retraction is retracted, nothing is retracted twice, and only
    data events are corrected. A change whose id is recorded already is ``repeated``. The history is only joined on keys
    the batch names."""
    shape = payload_problems(batch).withColumnRenamed("event_id", "id")
    named = batch.select("entity_id").distinct()
    past = history.join(named, "entity_id", "left_semi")
    slim = ["id", "entity_id", "entity_type", "kind", "target_event_id"]
    both = past.select(*slim).unionByName(batch.select(*slim))
    born = both.where("kind = 'created'").groupBy("entity_id").agg(F.count_distinct("id").alias("births"), F.min("entity_type").alias("born_as"))
    gone = past.where("kind = 'retracted' and target_event_id is null").select("entity_id", F.lit(True).alias("gone")).distinct()
    old = past.select("id", F.lit(True).alias("old")).distinct()
    targets = both.groupBy("entity_id", F.col("id").alias("target_event_id")).agg(F.first("kind").alias("target_kind"))
    voided = past.where("kind = 'retracted' and target_event_id is not null").select("entity_id", "target_event_id", F.lit(True).alias("voided")).distinct()
    out = batch.join(shape, "id", "left").join(born, "entity_id", "left").join(gone, "entity_id", "left").join(old, "id", "left")
    out = out.join(targets, ["entity_id", "target_event_id"], "left").join(voided, ["entity_id", "target_event_id"], "left")
    meta, aimed = F.col("kind").isin(*META_KINDS), F.col("target_event_id").isNotNull()
    problem = (
        F.when(F.col("id").isNull() | F.col("entity_id").isNull() | F.coalesce(F.trim("recorded_by"), F.lit("")).eqNullSafe(""), "no id, record or recorder")
        .when(F.col("old"), "repeated").when(~F.col("entity_id").rlike(RECORD_ID), "no valid record id").when(F.col("problem").isNotNull(), F.col("problem"))
        .when(instant_us(F.col("at")).isNull() | instant_us(F.col("recorded_at")).isNull(), "no instant with an offset")
        .when(~F.coalesce("at_precision", F.lit("time")).isin("time", "date", "unknown"), "no such precision")
        .when(meta & F.coalesce(F.trim("evidence"), F.lit("")).eqNullSafe(""), "no evidence").when(F.coalesce("gone", F.lit(False)), "record is retracted")
        .when(F.coalesce("births", F.lit(0)) == 0, "no such record").when((F.col("kind") == "created") & (F.col("births") > 1), "record exists")
        .when(F.col("entity_type").isNotNull() & (F.col("entity_type") != F.col("born_as")), "record is of another type")
        .when(meta & aimed & F.col("target_kind").isNull(), "no such target in the record").when(meta & F.col("voided"), "target is retracted already")
        .when((F.col("kind") == "corrected") & ~F.col("target_kind").isin(*DATA_KINDS), "only data events are corrected")
        .when((F.col("kind") == "retracted") & aimed & (F.col("target_kind") == "created"), "retract the whole record instead of its creation")
        .when((F.col("kind") == "retracted") & aimed & (F.col("target_kind") == "retracted"), "a retraction cannot be retracted").otherwise("")
    )
    return out.withColumn("problem", problem).select(*batch.columns, "problem")


def replayed(history: DataFrame, accepted: DataFrame, types: dict[str, TypeDef]) -> tuple[DataFrame, DataFrame]:
    """``(records, refused)``: the records that accepted changes (numbered) touch, as they stand after them, and the changes
    whose record would contradict itself or violate its type, with ``problem``.

    Only the histories of touched records are replayed. A refused change takes its record's other changes of the batch with
    it, as they were replayed together.
    """
    touched = accepted.select("entity_id").distinct()
    past = history.join(touched, "entity_id", "left_semi")
    whole = materialise(past.select(*accepted.columns).unionByName(accepted), "touched")
    rows = readable(whole)
    applied = materialise(with_age(replay_rows(rows), F.lit(0), 1), "replayed")
    state = resolved(applied, rows, 1)
    contradicted = conflicts_of(applied).groupBy("entity_id").agg(F.min("problem").alias("conflict"))
    wrong = F.lit(None).cast("array<string>")
    variants = F.from_json(F.to_json("typed"), "map<string,variant>")
    for name, t in types.items():
        wrong = F.when(F.col("entity_type") == name, violations(t, variants)).otherwise(wrong)
    documents = state.join(typed_documents(whole, state), "entity_id")
    judged = documents.withColumn("wrong", wrong).join(contradicted, "entity_id", "left")
    problem = F.coalesce("conflict", F.when(F.size("wrong") > 0, F.array_join("wrong", "; ")), F.when(~F.col("entity_type").isin(*types) if types else F.lit(False), "no such type"))
    judged = judged.withColumn("problem", problem)
    refused = accepted.join(judged.where("problem is not null").select("entity_id", "problem"), "entity_id")
    times, reached = times_of(applied), reached_of(applied)
    last = whole.groupBy("entity_id").agg(F.max(F.col("seq").cast("long")).alias("last_event_seq"))
    records = judged.where("problem is null").join(times, "entity_id", "left").join(reached, "entity_id", "left").join(last, "entity_id", "left")
    return records.select(
        F.col("entity_id").alias("id"), F.col("entity_type").alias("type"), F.to_json("typed").alias("doc"), "retracted",
        F.timestamp_micros("created_us").cast("string").alias("created_at"), F.timestamp_micros("updated_us").cast("string").alias("updated_at"),
        "last_event_seq", F.coalesce("reached", F.array().cast("array<string>")).alias("reached"),
    ), refused


def typed_documents(events: DataFrame, state: DataFrame) -> DataFrame:
    """entity_id, typed (field -> variant): the documents with their JSON types, which the replay as text has lost. The
    variant of a field is the one that some payload of the record gives for the replayed text."""
    bodies = F.when(F.col("kind") == "corrected", F.get_json_object("payload", "$.payload")).otherwise(F.col("payload"))
    said = F.explode(F.from_json(bodies, "map<string,variant>")).alias("field", "value")
    given = events.select("entity_id", "kind", said).where("value is not null").select("entity_id", F.when((F.col("kind") == "status_changed") & (F.col("field") == "to"), "status").otherwise(F.col("field")).alias("field"), "value")
    text = F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))
    choices = given.select("entity_id", "field", text.alias("text"), F.to_json("value").alias("json")).groupBy("entity_id", "field", "text").agg(F.min("json").alias("json"))
    fields = state.select("entity_id", F.explode("doc").alias("field", "text"))
    found = fields.join(choices, ["entity_id", "field", "text"], "left").select("entity_id", "field", F.coalesce(F.try_parse_json("json"), F.try_parse_json(F.to_json(F.col("text").cast("variant")))).alias("value"))
    docs = found.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("typed"))
    none = F.create_map().cast("map<string,variant>")
    return state.select("entity_id").join(docs, "entity_id", "left").select("entity_id", F.coalesce("typed", none).alias("typed"))


def numbered(rows: DataFrame, order: str, start: int) -> DataFrame:
    """``rows`` with ``seq`` = start, start + 1, ... in the order of a column, without ordering everything in one task:
    rows are ranged over partitions, partitions are counted, and each numbers its own from its offset."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(tasks, F.col(order)).withColumn("_p", F.spark_partition_id()), "ranged")  # read twice, parted once
    counts = sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect())  # one row per partition
    offsets, at = [], start
    for p, n in counts:
        offsets.append((p, at))
        at += n
    heads = F.broadcast(rows.sparkSession.createDataFrame(offsets or [(-1, start)], "_p int, _at long"))
    return ranged.join(heads, "_p").withColumn("seq", F.col("_at") + F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1).drop("_p", "_at")


def stable_id(prefix: str, key: Column | str) -> Column:
    """An id that the same key always gets: the prefix and twelve digits of the key's hash. Null keys have none."""
    text = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text.cast("string"), 256), 1, 12))
