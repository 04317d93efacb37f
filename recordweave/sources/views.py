"""Flat, readable tables of records, for people and for other tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.operators.profile import view_summary
from recordweave.plans.planner import Book
from recordweave.plans.spec import FieldDef
from recordweave.sources.store import Commit, Store


def shown(name: str, d: FieldDef) -> Column:
    """A field as text: the first label of an enum value, yes or no, a list joined by commas."""
    c = F.col(name)
    if d.labels:
        pairs = [F.lit(x) for value, words in d.labels.items() if words for x in (value, words[0])]
        return F.coalesce(F.create_map(*pairs)[c], c) if pairs else c
    if d.type == "boolean":
        return F.when(c, "yes").when(~c, "no")
    if d.type == "array":
        return F.array_join(c, ", ")
    return c.cast("string")


def flat_view(book: Book, kind: str) -> DataFrame:
    """Live records of a type, one text column per field. A reference ``x_id`` becomes ``x``, the name of its target (its
    id where the target has none); ``label`` is the record's own name, else that of its first reference that has one."""
    t = book.types[kind]
    rows = book.entities[kind]
    if "retracted" in rows.columns:
        rows = rows.where(~F.coalesce("retracted", F.lit(False)))
    label = [F.col(book.names[kind])] if book.names.get(kind) in t.fields else []
    columns = [F.col("id").cast("string").alias("id")]
    for name, d in t.fields.items():
        if d.ref and d.ref in book.entities:
            target = book.entities[d.ref].select(F.col("id").alias(name), F.col(book.names.get(d.ref, "name")).alias(f"_{name}"))
            rows = rows.join(target, name, "left")
            columns.append(F.coalesce(F.col(f"_{name}"), F.col(name).cast("string")).alias(name.removesuffix("_id")))
            label.append(F.col(f"_{name}"))
        else:
            columns.append(shown(name, d).alias(name))
    return rows.select(*columns, (F.coalesce(*label) if label else F.lit(None).cast("string")).alias("label"))


def write_views(book: Book, folder: str, events: DataFrame | None = None, stamp: str = "") -> Store:
    """The readable tables of a book under ``folder``: one flat table per entity type, ``_summary`` (per type live and retracted
    records and the last update), ``_fields`` (the dictionary), ``_history`` (the changes) and ``_meta`` (when they were
    written). One commit replaces all of them, so a reader sees the old tables or the new ones; read them with the store."""
    spark = next(iter(book.entities.values())).sparkSession
    tables = {kind: flat_view(book, kind) for kind in book.entities}
    parts = [df.select(F.lit(kind).alias("type"), *(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in ("retracted", "updated_at"))) for kind, df in book.entities.items()]
    summary = reduce(DataFrame.unionByName, [p.select("type", F.col("retracted").cast("boolean").alias("retracted"), F.col("updated_at").cast("string").alias("updated_at")) for p in parts])
    tables["_summary"] = view_summary(summary)
    fields = [(t.name, n, d.type, d.format, d.ref, ", ".join(d.enum), d.description) for t in book.types.values() for n, d in t.fields.items()]
    tables["_fields"] = spark.createDataFrame(fields or [("", "", "", None, None, "", "")], "type string, field string, kind string, format string, refers_to string, allowed string, description string")
    if events is not None:
        tables["_history"] = events
    tables["_meta"] = spark.createDataFrame([("written_at", stamp), ("types", str(len(book.entities)))], "key string, value string")
    store = Store(spark, folder)
    store.commit(Commit(replaced=tables), store.state())
    return store
