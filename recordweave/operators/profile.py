"""What unregistered data looks like: fields and their types, observed values, entity or series."""

from __future__ import annotations

import difflib
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.functions.times import ZONED
from recordweave.operators.drift import json_type
from recordweave.operators.feed import JSON_MAP
from recordweave.plans.spec import TypeDef

# How many values a field may have to be listed, points a series key has, samples, likeness of names, names of statuses.
MAX_OBSERVED = 12
MIN_POINTS = 5
SAMPLES = 5
NEAR = 0.75
STATUS_NAME = re.compile(r"(^|_)(status|state|stage|phase)($|_)|상태")


def field_types(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, field, json_type, n) over JSON objects given as text; texts that are no objects have no fields."""
    fields = rows.select(group, F.explode(F.from_json(text, "map<string,variant>")).alias("field", "value")).where("value is not null")
    return fields.select(group, "field", json_type(F.col("value")).alias("json_type")).groupBy(group, "field", "json_type").agg(F.count("*").alias("n"))


def unknown_fields(observations: DataFrame) -> DataFrame:
    """Per type and field: how often seen, first and last, by how many recorders, and up to SAMPLES of the values seen."""
    out = observations.groupBy("entity_type", "field").agg(F.count("*").alias("n"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.countDistinct("recorded_by").alias("recorders"))
    shown = samples(observations, ["entity_type", "field"], "sample")
    return out.join(shown, ["entity_type", "field"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def samples(rows: DataFrame, keys: list[str], value: str, most: int = SAMPLES) -> DataFrame:
    """keys, samples: the ``most`` commonest values of each group (of equally common ones the least), as text."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("string").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "_v"))).where(F.col("_k") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias("samples"))


def observed_values(rows: DataFrame, field: str, most: int = MAX_OBSERVED) -> DataFrame:
    """The values of a text field by frequency, if there are at most ``most`` of them; else no row."""
    return all_observed_values(rows.select(field), most).select("value", "n").orderBy(F.desc("n"), "value")


def all_observed_values(rows: DataFrame, most: int = MAX_OBSERVED) -> DataFrame:
    """field, value, n for every column of ``rows`` (text) that has at most ``most`` values; all columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in rows.columns])).alias("x")
    counts = rows.select(pairs).select("x.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("field").agg(F.count("*").alias("d")).where(F.col("d") <= most)
    return counts.join(F.broadcast(few), "field").select("field", "value", "n")  # one row per column


def draft_fields(records: DataFrame, events: DataFrame, known: dict[str, TypeDef]) -> DataFrame:
    """The dictionary of drafts: entity_type, field, types (joined by ","), n, samples, first_seen of every field in live
    documents that the type does not declare. records: type, doc, retracted; events: entity_type, payload, recorded_at.
    A type that is not known declares nothing. first_seen is the earliest recording that sets the field, or null."""
    declared = F.lit(False)
    for name, t in known.items():
        declared = declared | ((F.col("entity_type") == name) & F.col("field").isin(*t.fields))
    live = records.where(~F.coalesce("retracted", F.lit(False))).select(F.col("type").alias("entity_type"), F.explode(F.from_json("doc", "map<string,variant>")).alias("field", "value"))
    rows = live.where(F.col("value").isNotNull() & ~declared).withColumn("kind", json_type(F.col("value"))).withColumn("text", F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")))
    keys = ["entity_type", "field"]
    out = rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("types"), F.count("*").alias("n"))
    told = events.select("entity_type", F.explode(F.from_json("payload", "map<string,variant>")).alias("field", "value"), "recorded_at").where(F.col("value").isNotNull() & ~declared)
    first = told.groupBy(*keys).agg(F.min("recorded_at").alias("first_seen"))
    return out.join(samples(rows, keys, "text"), keys, "left").join(first, keys, "left")


def stray_values(records: DataFrame, known: dict[str, TypeDef]) -> DataFrame:
    """entity_type, field, value, n of values of live documents that their field's enum does not list."""
    pairs = [(t.name, f, list(d.enum)) for t in known.values() for f, d in t.fields.items() if d.enum]
    spark = records.sparkSession
    enums = F.broadcast(spark.createDataFrame(pairs or [("", "", [""])], "entity_type string, field string, enum array<string>"))  # the dictionary
    live = records.where(~F.coalesce("retracted", F.lit(False))).select(F.col("type").alias("entity_type"), F.explode(F.from_json("doc", JSON_MAP)).alias("field", "value"))
    return live.where("value is not null").join(enums, ["entity_type", "field"]).where("not array_contains(enum, value)").groupBy("entity_type", "field", "value").agg(F.count("*").alias("n"))


def similar_names(name: str, others: list[str], labels: dict[str, list[str]] | None = None) -> list[str]:
    """The names of a dictionary that look like ``name``: equal but for case and separators, one within the other, NEAR alike,
    or with a label that is equal."""
    plain = lambda t: re.sub(r"[\W_]+", "", t.lower())
    mine = plain(name)

    def near(other: str) -> bool:
        theirs = plain(other)
        return mine in theirs or theirs in mine or difflib.SequenceMatcher(None, mine, theirs).ratio() >= NEAR or any(plain(x) == mine for x in (labels or {}).get(other, ()))

    return [o for o in others if o != name and near(o)]


def inferred_type(values: Column) -> Column:
    """The narrowest type all of a group's texts have (an aggregate): boolean, integer, number, array, date, date-time, string."""
    every = lambda p: F.bool_and(values.rlike(p))
    return (
        F.when(every("^(true|false)$"), "boolean").when(every(r"^-?\d{1,18}$"), "integer").when(every(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(F.bool_and(F.get_json_object(values, "$[*]").isNotNull() & values.rlike(r"^\s*\[")), "array")
        .when(F.bool_and(values.rlike(r"^\d{4}-\d{2}-\d{2}$") & values.try_cast("date").isNotNull()), "date")
        .when(F.bool_and(values.rlike(ZONED) & values.try_cast("timestamp").isNotNull()), "date-time").otherwise("string")
    )


def inferred_fields(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, type, enum_candidates: the type of each group of texts, and for text with at least three values but at most five
    different ones these (sorted), else an empty list."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(inferred_type(F.col(value)).alias("type"), F.count("*").alias("_n"))
    few = all_of = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).distinct()
    few = all_of.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_v"))).where("_k <= 6").groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_few"))
    enum = F.when((F.col("type") == "string") & (F.col("_n") >= 3) & (F.size("_few") <= 5), F.col("_few")).otherwise(F.array().cast("array<string>"))
    return out.join(few, keys).select(*keys, "type", enum.alias("enum_candidates"))


def series_signals(rows: DataFrame, time: str, candidates: list[str], most: int = 3) -> DataFrame:
    """For each set of up to ``most`` candidate keys: does (key, time) name a row, and how many rows a key has at the
    median. A series has such a set with at least MIN_POINTS. One aggregation per set; the sets are few."""
    found = None
    for n in range(0, most + 1):
        for keys in combinations(candidates, n):
            cell = rows.groupBy(*keys, time).agg(F.count("*").alias("c"))
            per_key = cell.groupBy(*keys).agg(F.sum("c").alias("rows"), F.max("c").alias("most"))
            one = per_key.agg(F.max("most").alias("m"), F.median("rows").alias("median_rows")).select(F.lit(",".join(keys)).alias("keys"), (F.col("m") == 1).alias("is_key"), F.col("median_rows").cast("double"))
            found = one if found is None else found.unionByName(one)
    return found.withColumn("is_series", F.col("is_key") & (F.col("median_rows") >= MIN_POINTS))


def judged_kind(rows: DataFrame) -> dict[str, object]:
    """Whether rows (typed columns) are records of their own or points of a series, by eight signs: ``kind`` is "entity",
    "series" or None (then the ``question`` is for people), with the ``signals`` it rests on.

    A column that is a date, a timestamp or text of either in every row is the time. The key is the smallest set of up to
    three text columns (row identifiers left out) that names a row together with the time. For a series speak several times
    per key, at least half of the values being numbers, and MIN_POINTS rows per key at the median; for records a text that
    differs in every row, a reference, a category that changes within a key. A row identifier or a changing column named
    like a status decides alone. All columns are judged in a fixed number of aggregations.
    """
    spark_types = dict(rows.dtypes)
    text = [c for c, t in spark_types.items() if t == "string"]
    numeric = [c for c, t in spark_types.items() if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    is_time = lambda c: (F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col(c).try_cast("date").isNotNull()) | (F.col(c).rlike(ZONED) & F.col(c).try_cast("timestamp").isNotNull())
    whole = [F.bool_and(F.coalesce(is_time(c), F.lit(False))).alias(f"t_{c}") for c in text] + [F.bool_and(F.col(c).isNotNull()).alias(f"t_{c}") for c, t in spark_types.items() if t in ("date", "timestamp")]
    counts = rows.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in text], *[F.count(c).alias(f"c_{c}") for c in text], *whole).first().asDict()
    n = counts["n"]
    times = [c for c in rows.columns if counts.get(f"t_{c}")]
    if not n or not times:
        return {"kind": "entity", "signals": {"time": None}, "question": None}
    time = times[0]
    strings = [c for c in text if c != time and not counts[f"t_{c}"]]
    row_ids = [c for c in strings if n >= 3 and counts[f"d_{c}"] == n]
    options = [c for c in strings if c not in row_ids]
    key: list[str] = []
    per_key = float(n)
    signals = series_signals(rows, time, options).collect() if options else []  # one row per set of keys
    chosen = next((r for r in sorted(signals, key=lambda r: r["keys"].count(",") if r["keys"] else -1) if r["is_key"] and r["keys"]), None)
    if chosen:
        key, per_key = chosen["keys"].split(","), chosen["median_rows"]
    values = [c for c in rows.columns if c not in key and c != time and c not in row_ids]
    numbers = [c for c in numeric if c in values]
    categories = [c for c in values if c in strings and counts[f"d_{c}"] <= max(5, n // 5)]
    changing: list[str] = []
    if categories:
        inside = rows.groupBy(*key).agg(*[F.count_distinct(c).alias(c) for c in categories]) if key else rows.agg(*[F.count_distinct(c).alias(c) for c in categories])
        most = inside.agg(*[F.max(c).alias(c) for c in categories]).first()
        changing = [c for c in categories if most[c] > 1]
    status = [c for c in changing if STATUS_NAME.search(c)]
    refs = [c for c in values if c in strings and c.endswith(("_id", "_ids"))]
    share = len(numbers) / len(values) if values else 0.0
    for_series = [per_key >= 2, share >= 0.5 and bool(numbers), per_key >= MIN_POINTS]
    for_records = [bool(row_ids), bool(refs), bool(changing)]
    told = {"time": time, "key": key, "rows": n, "median_rows_per_key": per_key, "numeric_share": round(share, 2), "row_identifiers": row_ids, "references": refs, "changing_categories": changing, "status_fields": status}
    kind = None
    if row_ids or status or (any(for_records) and not all(for_series)) or not any(for_series):
        kind = "entity"
    elif all(for_series) and not any(for_records):
        kind = "series"
    question = None if kind else f"Are these values that pile up over {time}, or records that are kept one by one?"
    return {"kind": kind, "signals": told, "question": question, "measures": numbers if kind == "series" else []}


def latest_definitions(schemas: DataFrame) -> DataFrame:
    """name, version, definition of the last version of every type, and how many versions it has; of a version registered
    again the first registration counts."""
    first = schemas.groupBy("name", F.col("version").cast("long").alias("version")).agg(F.min_by("definition", "created_at").alias("definition"))
    return first.groupBy("name").agg(F.max("version").alias("version"), F.max_by("definition", "version").alias("definition"), F.count("*").alias("versions"))


def view_summary(records: DataFrame) -> DataFrame:
    """Per type: live and retracted records, and the last update. records: type, retracted, updated_at."""
    gone = F.coalesce("retracted", F.lit(False))
    return records.groupBy("type").agg(F.sum((~gone).cast("long")).alias("live"), F.sum(gone.cast("long")).alias("retracted"), F.max("updated_at").alias("updated"))
