"""Records out of mixed text: chunks are classified, their statements are held against their quotes, statements on one
record are merged, and what is certain becomes changes of the feed.

Statements (``facts``) are rows span_id, type, field, value (text), quote. Who makes them is an adapter: any function from
chunks to facts. Everything after it is relational and keeps what it cannot use, with the reason.
"""

from __future__ import annotations

import difflib
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.functions.names import identify
from recordweave.operators.profile import inferred_type
from recordweave.operators.recording import stable_id
from recordweave.operators.text import evidence_problem, same_words
from recordweave.plans.spec import FieldDef, TypeDef
from recordweave.runtime import ship

#: Chunks in one call of a classifier.
BATCH = 15
#: Chunks that name a new type before it is one, and records a series or new type has at least.
SUPPORT = 3
LOOK_ALIKE = 0.8

Classifier = Callable[[list[str]], list[str | None]]


def classified(chunks: DataFrame, classifier: Classifier, batch: int = BATCH) -> DataFrame:
    """``chunks`` (span_id, chunk) with ``type``: what the classifier calls each, "ambiguous" where it fails twice or gives
    no answer. Chunks of one text are asked about once. The classifier runs on the workers, ``batch`` texts a call."""
    ship(chunks.sparkSession)

    def ask(texts: list[str]) -> list[str | None]:
        for _ in range(2):
            try:
                said = list(classifier(texts))
                if len(said) == len(texts):
                    return said
            except Exception:  # noqa: BLE001 - an adapter may fail in any way; what it cannot tell is ambiguous
                continue
        return [None] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["chunk"])
            said = [x for i in range(0, len(texts), batch) for x in ask(texts[i : i + batch])]
            yield pd.DataFrame({"chunk": texts, "type": [x or "ambiguous" for x in said]})

    texts = chunks.where("chunk is not null").select("chunk").distinct().mapInPandas(run, "chunk string, type string")
    return chunks.join(texts, "chunk", "left").withColumn("type", F.coalesce("type", F.lit("ambiguous"))).select(*chunks.columns, "type")


def by_words(words: dict[str, list[str]]) -> Classifier:
    """A classifier without a model: the type most of whose words stand in a text; none if none or several tie."""

    def classify(texts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for t in texts:
            scores = sorted(((sum(w.lower() in t.lower() for w in ws), k) for k, ws in words.items()), reverse=True)
            out.append(scores[0][1] if scores and scores[0][0] and (len(scores) == 1 or scores[1][0] < scores[0][0]) else None)
        return out

    return classify


def settled_types(classified_chunks: DataFrame, known: list[str]) -> DataFrame:
    """The chunks with types settled: a new name that looks like a known type or like a shorter new name is that one, and new
    types that fewer than SUPPORT chunks name are ambiguous. Only the distinct names come to the driver."""
    spark = classified_chunks.sparkSession
    names = [r.type for r in classified_chunks.where("type <> 'ambiguous'").select("type").distinct().collect()]
    plain = lambda n: re.sub(r"[\W_]+", "", n.lower()).removesuffix("s")
    alike = lambda a, b: plain(a) == plain(b) or difflib.SequenceMatcher(None, plain(a), plain(b)).ratio() >= LOOK_ALIKE
    heads = list(known)
    merged: dict[str, str] = {}
    for n in sorted(names, key=lambda n: (len(n), n)):
        merged[n] = n if n in known else next((h for h in heads if alike(n, h)), n)
        if merged[n] == n and n not in heads:
            heads.append(n)
    table = F.broadcast(spark.createDataFrame(list(merged.items()) or [("", "")], "type string, _to string"))
    moved = classified_chunks.join(table, "type", "left").withColumn("type", F.coalesce("_to", "type")).drop("_to")
    support = moved.groupBy("type").agg(F.countDistinct("span_id").alias("_n"))
    few = F.broadcast(support.where((F.col("_n") < SUPPORT) & ~F.col("type").isin(*known, "ambiguous")).select("type", F.lit(True).alias("_few")))
    return moved.join(few, "type", "left").withColumn("type", F.when(F.col("_few"), "ambiguous").otherwise(F.col("type"))).select(*classified_chunks.columns)


def drafted_types(facts: DataFrame, known: dict[str, TypeDef]) -> dict[str, TypeDef]:
    """Types for the names that facts use and the dictionary does not have, with fields typed by what was said."""
    new = facts.where(~F.col("type").isin(*known)) if known else facts
    kinds = new.groupBy("type", "field").agg(inferred_type(F.col("value")).alias("kind")).collect()  # one row per new field
    found: dict[str, dict[str, FieldDef]] = {}
    for r in sorted(kinds, key=lambda r: (r.type, r.field)):
        day = r.kind in ("date", "date-time")
        found.setdefault(r.type, {})[r.field] = FieldDef("string" if day else r.kind, format=r.kind if day else None)
    return {n: TypeDef(n, fields) for n, fields in found.items()}


def held_against_quotes(facts: DataFrame, chunks: DataFrame, types: dict[str, TypeDef]) -> DataFrame:
    """``facts`` with ``problem``: null where the quote stands in the chunk and the value comes from the quote, and where the
    value fits the field's type."""
    joined = facts.join(chunks.select("span_id", "chunk"), "span_id", "left").withColumn("_said", same_words("quote")).withColumn("_chunk", same_words("chunk"))
    problem = F.lit("no such field")
    for t in types.values():
        for name, d in t.fields.items():
            fits = F.col("value").try_cast("double").isNotNull() if d.is_number else F.lit(True)
            why = F.when(~fits, "not a number").otherwise(evidence_problem(d, F.col("value"), F.col("quote")))
            problem = F.when((F.col("type") == t.name) & (F.col("field") == name), why).otherwise(problem)
    inside = F.col("_chunk").contains(F.col("_said")) & (F.col("_said") != "")
    return joined.withColumn("problem", F.when(~F.coalesce(inside, F.lit(False)), "the quote is not in the chunk").otherwise(problem)).drop("_said", "_chunk", "chunk")


def with_references(facts: DataFrame, types: dict[str, TypeDef], records: dict[str, DataFrame], names: dict[str, str]) -> DataFrame:
    """``facts`` in which values of reference fields are ids: a value that is an id stays, one that certainly names one record
    becomes its id, any other is a problem."""
    out = facts
    for target in sorted({d.ref for t in types.values() for d in t.fields.values() if d.ref and d.ref in records}):
        fields = [(t.name, f) for t in types.values() for f, d in t.fields.items() if d.ref == target]
        mine = F.lit(False)
        for t, f in fields:
            mine = mine | ((F.col("type") == t) & (F.col("field") == f))
        known = records[target].withColumn("id", F.col("id").cast("string"))
        asked = out.where(mine & F.col("problem").isNull()).select(F.col("value").alias("query_id"), F.col("value").alias("query")).distinct()
        marks = [f for f, d in types[target].fields.items() if d.identifier] if target in types else []
        hits = identify(asked, known, marks[0] if marks else None, names.get(target, "name")).where("status = 'match'").select(F.col("query_id").alias("value"), F.col("ids").alias("_id"))
        ids = known.select(F.col("id").alias("value"), F.lit(True).alias("_is")).distinct()
        joined = out.join(hits, "value", "left").join(ids, "value", "left")
        problem = F.when(F.col("problem").isNull() & mine & F.col("_id").isNull() & F.col("_is").isNull(), f"no certain {target}").otherwise(F.col("problem"))
        value = F.when(mine & F.col("_is").isNull() & F.col("_id").isNotNull(), F.col("_id")).otherwise(F.col("value"))
        out = joined.withColumn("problem", problem).withColumn("value", value).select(*facts.columns)
    return out


def merged_records(facts: DataFrame, identity: dict[str, list[str]]) -> DataFrame:
    """type, record (the identity as text, else the span), fields (map), spans, conflicts: facts without a problem gathered per
    record. Facts of a span are one record; spans whose ``identity`` fields agree are one; a field said in two ways is a
    conflict and is left out."""
    good = facts.where("problem is null")
    keys = good.where(F.lit(False))
    for t, fields in identity.items():
        keys = keys.unionByName(good.where((F.col("type") == t) & F.col("field").isin(*fields)))
    per_span = keys.groupBy("type", "span_id").agg(F.array_sort(F.collect_set(F.struct("field", same_words("value").alias("v")))).alias("k"))
    full = F.lit(False)
    for t, fields in identity.items():
        full = full | ((F.col("type") == t) & (F.size(F.array_distinct(F.transform("k", lambda x: x["field"]))) == len(fields)) & (F.size("k") == len(fields)))
    named = per_span.where(full).select("type", "span_id", F.concat_ws("|", F.transform("k", lambda x: F.concat_ws("=", x["field"], x["v"]))).alias("record"))
    rows = good.join(named, ["type", "span_id"], "left").withColumn("record", F.coalesce("record", "span_id"))
    values = rows.groupBy("type", "record", "field").agg(F.min_by("value", same_words("value")).alias("value"), F.count_distinct(same_words("value")).alias("ways"))
    spans = rows.groupBy("type", "record").agg(F.array_sort(F.collect_set("span_id")).alias("spans"))
    fields = F.map_from_entries(F.collect_list(F.when(F.col("ways") == 1, F.struct("field", "value")))).alias("fields")
    conflicts = F.array_sort(F.collect_list(F.when(F.col("ways") > 1, F.col("field")))).alias("conflicts")
    return values.groupBy("type", "record").agg(fields, conflicts).join(spans, ["type", "record"])


def against_the_book(merged: DataFrame, current: DataFrame, identity: dict[str, list[str]]) -> DataFrame:
    """``merged`` with ``entity_id`` and ``outcome`` against the live records (id, type, doc): ``new``; ``recorded`` (every field
    as said); ``adds`` (fields it does not have); ``differs`` (a field it has otherwise); ``ambiguous`` (several records fit)."""
    said = F.lit(None).cast("string")
    held = F.lit(None).cast("string")
    for t, fields in identity.items():
        said = F.when(F.col("type") == t, F.concat_ws("|", *[F.coalesce(same_words(F.col("fields")[f]), F.lit("\0")) for f in fields])).otherwise(said)
        held = F.when(F.col("type") == t, F.concat_ws("|", *[F.coalesce(same_words(F.col("_d")[f]), F.lit("\0")) for f in fields])).otherwise(held)
    mine = merged.withColumn("_key", F.when(said.contains("\0"), None).otherwise(said))
    theirs = current.select("id", "type", F.from_json("doc", "map<string,string>").alias("_d")).withColumn("_key", held).where("_key is not null and not contains(_key, '\\0')")
    known = theirs.groupBy("type", "_key").agg(F.min("id").alias("entity_id"), F.count("*").alias("_n"), F.min_by("_d", "id").alias("_d"))
    joined = mine.join(known, ["type", "_key"], "left")
    other = F.exists(F.map_entries("fields"), lambda e: F.col("_d")[e["key"]].isNotNull() & ~(F.col("_d")[e["key"]] == e["value"]))
    more = F.exists(F.map_entries("fields"), lambda e: F.col("_d")[e["key"]].isNull())
    outcome = F.when(F.col("_n").isNull(), "new").when(F.col("_n") > 1, "ambiguous").when(other, "differs").when(more, "adds").otherwise("recorded")
    return joined.withColumn("outcome", outcome).drop("_key", "_n", "_d")


def demoted_series(merged: DataFrame, series: list[str], text_field: str) -> list[str]:
    """The series types whose points are records after all: over half of the values of ``text_field`` differ. One row per type."""
    rows = merged.where(F.col("type").isin(*series)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct(F.col("fields")[text_field]).alias("d"))
    return sorted(r.type for r in rows.collect() if 2 * r.d > r.n)


def with_enough_records(merged: DataFrame, known: list[str], least: int = SUPPORT) -> DataFrame:
    """``merged`` without new types of fewer than ``least`` records."""
    sizes = merged.groupBy("type").agg(F.count("*").alias("_n"))
    kept = F.broadcast(sizes.where((F.col("_n") >= least) | F.col("type").isin(*known)).select("type"))
    return merged.join(kept, "type", "left_semi")


def changes_of(merged: DataFrame, types: dict[str, TypeDef], at: str, by: str, run: str) -> DataFrame:
    """The changes that record what is new or added (columns as the feed's, without seq). Ids depend on the run and the record,
    so applying a run twice changes nothing; the evidence names the spans."""
    as_json = [(t.name, name) for t in types.values() for name, d in t.fields.items() if d.is_number or d.type in ("boolean", "array")]

    def written(k: Column, v: Column) -> Column:
        bare = F.lit(False)
        for t, name in as_json:
            bare = bare | ((F.col("type") == t) & (k == name))
        return F.when(bare, v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))

    typed = F.transform_values("fields", written)
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(typed)), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ","), F.lit("}"))
    new = F.col("outcome") == "new"
    key = F.concat_ws("|", F.lit(run), "type", "record")
    return merged.where(F.col("outcome").isin("new", "adds")).select(
        stable_id("evt", key).alias("id"), F.when(new, F.concat("type", F.lit("_"), F.substring(F.sha2(key, 256), 1, 12))).otherwise(F.col("entity_id")).alias("entity_id"), F.col("type").alias("entity_type"),
        F.when(new, "created").otherwise("updated").alias("kind"), body.alias("payload"), F.lit(at).alias("at"), F.lit(at).alias("recorded_at"), F.lit(by).alias("recorded_by"),
        F.concat(F.lit(f"{run}: "), F.array_join("spans", ", ")).alias("evidence"), F.lit(None).cast("string").alias("target_event_id"), F.lit("time").alias("at_precision"),
    )


def reversal_of(events: DataFrame, run: str, at: str, by: str) -> DataFrame:
    """The changes that take a run back: records it created are retracted as a whole, changes it made to others are voided.
    What was recorded on them since stays in the feed."""
    mine = events.where(F.col("evidence").startswith(f"{run}: ")).select("id", "entity_id", "entity_type", "kind").distinct()
    whole = F.col("kind") == "created"
    target = F.when(~whole, F.col("id"))
    return mine.select(
        stable_id("evt", F.concat_ws("|", F.lit("revert"), "id")).alias("id"), "entity_id", "entity_type", F.lit("retracted").alias("kind"),
        F.when(whole, F.lit("{}")).otherwise(F.concat(F.lit('{"target":"'), "id", F.lit('"}'))).alias("payload"), F.lit(at).alias("at"), F.lit(at).alias("recorded_at"), F.lit(by).alias("recorded_by"),
        F.lit(f"revert of {run}").alias("evidence"), target.alias("target_event_id"), F.lit("time").alias("at_precision"),
    )


def cost(chunks: int, price: float, batch: int = BATCH, headroom: float = 2.0, cap: float | None = None) -> dict[str, Any]:
    """Calls and money that classifying so many chunks takes, with headroom; ``allowed`` says whether that is within a cap."""
    calls = math.ceil(chunks / batch)
    estimate = calls * price * headroom
    return {"calls": calls, "estimate": estimate, "allowed": cap is None or estimate <= cap}


def run_id(source: str, at: str) -> str:
    return "ingest_" + hashlib.sha256(f"{source}\n{at}".encode()).hexdigest()[:12]
