"""Schemas that drift between files.

Documents are loaded as path -> (value, raw type) rows; statistics per (file, record type, version, path, raw type) are
aggregated map-side; changes between versions are read off the dictionary and the statistics of all files together, and
what a file shows apart from the others of its version off its own; and documents of every version are projected onto one
typed table per record type, with failed casts reported per record and per file.

Two fields are the same thing under another name when they agree in type, format and reference and their descriptions
or values do. Value evidence is two fixed-size sketches per (type, version, field): of the values and of their shapes.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.runtime import materialise

SHARE = 0.1
#: Levels of objects in fields that are read, and what parts the names in a path.
MAX_DEPTH = 3
NESTED = "."
#: Likeness from which two fields are one thing.
SAME = 0.5

STATS = "type string, version long, path string, json_type string, n long"
_NUMERIC = ("integer", "number")
_SPARK_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
_STOP = set("a an and as at be by each for from had has have in is it its mostly now of on only or own so some than that the them there to up was when where which who why with".split())


def json_type(value: Column) -> Column:
    """string, integer, number, boolean, array, object or null of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def with_file(rows: DataFrame) -> DataFrame:
    """``rows`` with ``file``, the name of the file a row was read from; "" where they come from no file."""
    try:
        return rows.withColumn("file", F.col("_metadata.file_name"))
    except AnalysisException:
        return rows.withColumn("file", F.lit(""))


def _paths(value: Column, path: Column, depth: int) -> Column:
    """Entries (path, depth, value) of a map of fields and of the objects in it, down to MAX_DEPTH."""
    here = F.transform(F.map_entries(value), lambda e: F.struct(F.concat(path, e["key"]).alias("path"), F.lit(depth).alias("depth"), e["value"].alias("value")))
    if depth == MAX_DEPTH:
        return here
    inner = lambda e: F.when(F.schema_of_variant(e["value"]).startswith("OBJECT"), _paths(F.try_variant_get(e["value"], "$", "map<string,variant>"), F.concat(e["path"], F.lit(NESTED)), depth + 1))
    none = F.array().cast("array<struct<path:string,depth:int,value:variant>>")
    return F.concat(here, F.flatten(F.transform(here, lambda e: F.coalesce(inner(e), none))))


def path_values(records: DataFrame) -> DataFrame:
    """(id, file, type, version, path, depth, value variant, json_type) of each field that is not null. Fields of an object
    in a field follow it, with the path of the outer field, NESTED and their own name, MAX_DEPTH levels down.

    records: id, type, version, doc (JSON text), and optionally file. A doc that is no JSON object has no paths.
    """
    records = records if "file" in records.columns else records.withColumn("file", F.lit(""))
    found = F.explode(_paths(F.from_json("doc", "map<string,variant>"), F.lit(""), 0)).alias("p")
    return (
        records.select("id", "file", "type", "version", found).select("id", "file", "type", "version", "p.*")
        .where("value is not null").withColumn("json_type", json_type(F.col("value"))).where("json_type <> 'null'")
    )


def current_records(entities: DataFrame) -> DataFrame:
    """id, type, version, doc, file of the row of highest last_event_seq per id, retracted ones included."""
    row = F.max_by(F.struct("type", F.col("schema_version").cast("long").alias("version"), "doc", "file"), F.coalesce("last_event_seq", F.lit(-1)))
    return with_file(entities).where("id is not null").groupBy("id").agg(row.alias("r")).select("id", "r.*").where("type is not null and version is not null")


def path_statistics(records: DataFrame) -> DataFrame:
    """Per file, type, version, path and raw type: n, and sketches of the values and of their shapes (digits and letters
    folded). Rows with path "" count the records."""
    text = F.coalesce(F.expr("try_variant_get(value, '$', 'string')"), F.to_json("value"))
    shape = F.regexp_replace(F.regexp_replace(text, r"\d+", "9"), r"\p{L}+", "a")
    fields = path_values(records).withColumn("text", text).withColumn("shape", shape)
    stats = fields.groupBy("file", "type", "version", "path", "depth", "json_type").agg(F.count("*").alias("n"), F.theta_sketch_agg("text", F.lit(10)).alias("values"), F.theta_sketch_agg("shape", F.lit(8)).alias("shapes"))
    none = F.lit(None).cast("binary")
    counted = records if "file" in records.columns else records.withColumn("file", F.lit(""))
    totals = counted.groupBy("file", "type", "version").agg(F.count("*").alias("n")).select("file", "type", "version", F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit("").alias("json_type"), "n", none.alias("values"), none.alias("shapes"))
    return stats.unionByName(totals)


def of_all_files(statistics: DataFrame) -> DataFrame:
    """The statistics of top-level fields with the files of a version taken together."""
    merge = lambda c: F.expr(f"theta_union_agg(`{c}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c)
    fields = statistics.where("path <> '' and depth = 0").groupBy("type", "version", "path", "json_type").agg(F.sum("n").alias("n"), merge("values"), merge("shapes"))
    none = F.lit(None).cast("binary")
    totals = statistics.where("path = ''").groupBy("type", "version").agg(F.sum("n").alias("n")).select("type", "version", F.lit("").alias("path"), F.lit("").alias("json_type"), "n", none.alias("values"), none.alias("shapes"))
    return fields.unionByName(totals)


def file_changes(statistics: DataFrame) -> DataFrame:
    """file, record_type, version, path, change, n: how a file differs from all files of its type and version together.
    ``added``: a path that less than SHARE of the other files' records have and at least SHARE of the file's; ``removed``: the
    reverse; ``retyped``: at least SHARE of the file's values have a raw type that is rarer than that elsewhere (integer and
    number being one). n is the number of values (records, if removed) concerned. A version in one file gives no row."""
    family = F.when(F.col("json_type").isin(*_NUMERIC), "number").otherwise(F.col("json_type"))
    key = ["type", "version"]
    sizes = statistics.where("path = ''").select("file", *key, F.col("n").alias("size"))
    whole = sizes.groupBy(*key).agg(F.sum("size").alias("all_size"), F.count("*").alias("files")).where("files > 1")
    sizes = sizes.join(whole, key)
    typed = statistics.where("path <> ''").groupBy("file", *key, "path", family.alias("family")).agg(F.sum("n").alias("n"))
    present = typed.groupBy("file", *key, "path").agg(F.sum("n").alias("n"))
    everywhere = present.groupBy(*key, "path").agg(F.sum("n").alias("all_n"))
    grid = sizes.join(everywhere, key).join(present, ["file", *key, "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mine, theirs = F.col("n") / F.col("size"), (F.col("all_n") - F.col("n")) / F.greatest(F.lit(1), F.col("all_size") - F.col("size"))
    change = F.when((mine >= SHARE) & (theirs < SHARE), "added").when((mine < SHARE) & (theirs >= SHARE), "removed")
    shown = grid.withColumn("change", change).where("change is not null").select("file", F.col("type").alias("record_type"), "version", "path", "change", F.when(F.col("change") == "removed", F.col("size")).otherwise(F.col("n")).alias("n"))
    kinds = typed.groupBy(*key, "path", "family").agg(F.sum("n").alias("all_kind"))
    kept = typed.join(sizes.select("file", *key), ["file", *key]).join(kinds, [*key, "path", "family"]).join(everywhere, [*key, "path"]).join(present.withColumnRenamed("n", "mine"), ["file", *key, "path"])
    rare = (F.col("n") >= SHARE * F.col("mine")) & (F.col("all_kind") - F.col("n") < SHARE * (F.col("all_n") - F.col("mine")))
    retyped = kept.where(rare & (F.col("all_n") > F.col("mine"))).select("file", F.col("type").alias("record_type"), "version", "path", F.lit("retyped").alias("change"), "n")
    return shown.unionByName(retyped)


def _overlap(a: str, b: str) -> Column:
    """Share of the smaller set of distinct values that the other holds, by sketch."""
    both = F.theta_sketch_estimate(F.theta_intersection(a, b))
    return both / F.greatest(F.lit(1), F.least(F.theta_sketch_estimate(a), F.theta_sketch_estimate(b)))


@dataclass
class Evidence:
    """What the documents show of one record type: counts by version and field, and likeness of fields across versions."""

    records: dict[int, int] = field(default_factory=dict)
    types: dict[tuple[int, str], dict[str, int]] = field(default_factory=lambda: defaultdict(dict))
    alike: dict[tuple[int, str, int, str], tuple[float, float]] = field(default_factory=dict)

    def present(self, version: int, name: str) -> int:
        return sum(self.types.get((version, name), {}).values())

    def share(self, version: int, name: str) -> float:
        return self.present(version, name) / max(1, self.records.get(version, 0))


def dictionary(schemas: DataFrame) -> dict[str, dict[int, dict[str, dict]]]:
    """type -> version -> field -> its definition; a repeated registration changes nothing (the first counts)."""
    found: dict[str, dict[int, dict[str, dict]]] = defaultdict(dict)
    for r in sorted(schemas.select("name", "version", "definition", "created_at").collect(), key=lambda r: (r.name or "", r.version or 0, r.created_at or "")):
        if r.name is None or r.version is None:
            continue
        fields = json.loads(r.definition or "{}").get("fields") or {}
        found[r.name].setdefault(int(r.version), {k: v for k, v in fields.items() if isinstance(v, dict)})
    return found


def _stems(text: str) -> set[str]:
    words = re.findall(r"[a-z]+", text.lower())
    return {re.sub(r"(?:ing|ed|es|s|e)$", "", w) for w in words if w not in _STOP and len(w) > 1}


def _like(a: str, b: str) -> float:
    x, y = _stems(a), _stems(b)
    return len(x & y) / max(1, min(len(x), len(y))) if x and y else 0.0


def _family(kind: str | None) -> str | None:
    return "number" if kind in _NUMERIC else kind


def declared_likeness(old: dict, new: dict, old_name: str, new_name: str, shown: tuple[float, float] | None) -> float:
    """How far two declared fields are one thing: 0 if type, format, reference or enum speak against it."""
    for key in ("ref", "format", "identifier"):
        if old.get(key) != new.get(key):
            return 0.0
    if _family(old.get("type")) != _family(new.get("type")) or bool(old.get("enum")) != bool(new.get("enum")):
        return 0.0
    if old.get("enum"):
        return 1.0 if set(map(str, old["enum"])) == set(map(str, new["enum"])) else 0.5 * len(set(map(str, old["enum"])) & set(map(str, new["enum"]))) / len(old["enum"])
    words = _like(old.get("description") or "", new.get("description") or "")
    names = _like(old_name.replace("_", " "), new_name.replace("_", " "))
    values = shown[0] if shown else 0.0
    return max(words, 0.5 * words + 0.5 * values, 0.9 * values) + 0.2 * names


def shown_likeness(old_types: dict[str, int], new_types: dict[str, int], shown: tuple[float, float] | None, old_name: str, new_name: str, shares: tuple[float, float]) -> float:
    """How far an unregistered field is a declared one that went missing: same raw type, same values or shapes, like share."""
    main = lambda t: _family(max(t, key=lambda k: t[k])) if t else None
    if main(old_types) != main(new_types) or shown is None:
        return 0.0
    values, shapes = shown
    near = min(shares) / max(shares) if max(shares) else 0.0
    return 0.8 * values + (0.25 * shapes + 0.25) * (near > 0.7) * (values > 0.05) + 0.2 * _like(old_name.replace("_", " "), new_name.replace("_", " "))


def pair_up(likeness: dict[tuple[str, str], float]) -> dict[str, str]:
    """Best mutual matches (new -> old) of at least SAME, likest first."""
    taken: dict[str, str] = {}
    for (new, old), score in sorted(likeness.items(), key=lambda x: (-x[1], x[0])):
        if score >= SAME and new not in taken and old not in taken.values():
            taken[new] = old
    return taken


def changes(versions: dict[int, dict[str, dict]], shown: Evidence) -> list[tuple[int, str, str, str]]:
    """(version, field, change, former_field) between each version and the registered one before it."""
    rows: list[tuple[int, str, str, str]] = []
    order = sorted(versions)
    ever: set[str] = set(versions[order[0]]) if order else set()
    told: set[tuple[str, str]] = set()
    for before, now in zip(order, order[1:]):
        old, new = versions[before], versions[now]
        ever |= set(new)
        added, removed = [f for f in new if f not in old], [f for f in old if f not in new]
        same = pair_up({(a, r): declared_likeness(old[r], new[a], r, a, shown.alike.get((before, r, now, a))) for a in added for r in removed})
        rows += [(now, a, "renamed", r) for a, r in same.items()]
        rows += [(now, a, "added", "") for a in added if a not in same] + [(now, r, "removed", "") for r in removed if r not in same.values()]
        rows += [(now, f, "retyped", "") for f in new if f in old and new[f].get("type") != old[f].get("type")]

        if not shown.records.get(now):
            continue
        fields = sorted({f for v, f in shown.types if v == now})
        fresh = [f for f in fields if f not in ever and shown.share(now, f) >= SHARE and ("unregistered", f) not in told]
        gone = [f for f in new if not shown.present(now, f) and shown.share(before, former(same, f)) >= SHARE]
        pairs = {
            (u, g): shown_likeness(shown.types[before, former(same, g)], shown.types[now, u], shown.alike.get((before, former(same, g), now, u)), g, u, (shown.share(before, former(same, g)), shown.share(now, u)))
            for u in fresh for g in gone
        }
        moved = pair_up(pairs)
        rows += [(now, u, "renamed", g) for u, g in moved.items()]
        rows += [(now, u, "unregistered", "") for u in fresh if u not in moved]
        rows += [(now, g, "removed", "") for g in gone if g not in moved.values()]
        # told once, at the first version; first means that the version before, registered first or not, does not show it
        told |= {("unregistered", f) for f in fresh}
        for f, spec in new.items():
            kinds = shown.types.get((now, f), {})
            other = sum(n for k, n in kinds.items() if _family(k) != _family(spec.get("type")))
            if kinds and other >= SHARE * sum(kinds.values()):
                if ("retyped", f) not in told:
                    rows.append((now, f, "retyped", ""))
                told.add(("retyped", f))
            else:
                told.discard(("retyped", f))
    return sorted(set(rows))


def former(same: dict[str, str], name: str) -> str:
    return same.get(name, name)


def evidence(statistics: DataFrame, versions: dict[str, dict[int, dict[str, dict]]]) -> dict[str, Evidence]:
    """Statistics on the driver: rows per type, version, field and raw type. Chance fields below a tenth are of no
    consequence to any change, so only fields that are declared or common come; that bounds the rows by the dictionary."""
    declared = [(t, f) for t, vs in versions.items() for f in {f for fs in vs.values() for f in fs}]
    spark = statistics.sparkSession
    known = F.broadcast(spark.createDataFrame(declared or [("", "")], "type string, path string").withColumn("declared", F.lit(True)))
    size = statistics.where("path = ''").select("type", "version", F.col("n").alias("size"))
    presence = statistics.where("path <> ''").groupBy("type", "version", "path").agg(F.sum("n").alias("present"))
    kept = presence.join(F.broadcast(size), ["type", "version"]).join(known, ["type", "path"], "left").where(F.col("declared") | (F.col("present") >= F.lit(SHARE) * F.col("size"))).select("type", "version", "path")
    rows = statistics.join(kept, ["type", "version", "path"], "left_semi")
    found: dict[str, Evidence] = defaultdict(Evidence)
    for r in statistics.where("path = ''").select("type", "version", "n").collect():
        found[r.type].records[r.version] = r.n
    for r in rows.select("type", "version", "path", "json_type", "n").collect():
        found[r.type].types[r.version, r.path][r.json_type] = r.n
    union = rows.groupBy("type", "version", "path").agg(F.expr("theta_union_agg(values)").alias("values"), F.expr("theta_union_agg(shapes)").alias("shapes"))
    steps = [(t, a, b) for t, vs in versions.items() for a, b in zip(sorted(vs), sorted(vs)[1:])]
    if steps:
        step = F.broadcast(spark.createDataFrame(steps, "type string, a long, b long"))
        one = union.select("type", F.col("version").alias("a"), F.col("path").alias("old"), F.col("values").alias("va"), F.col("shapes").alias("sa"))
        two = union.select("type", F.col("version").alias("b"), F.col("path").alias("new"), F.col("values").alias("vb"), F.col("shapes").alias("sb"))
        pairs = one.join(step, ["type", "a"]).join(two, ["type", "b"]).where("old <> new")
        for r in pairs.select("type", "a", "old", "b", "new", _overlap("va", "vb").alias("v"), _overlap("sa", "sb").alias("s")).collect():
            found[r.type].alike[r.a, r.old, r.b, r.new] = (r.v, r.s)
    return found


def schema_changes(entities: DataFrame, schemas: DataFrame) -> list[tuple[str, int, str, str, str]]:
    """(record_type, version, field, change, former_field), on the driver: as many rows as the dictionary has changes."""
    versions = dictionary(schemas)
    shown = evidence(of_all_files(materialise(path_statistics(current_records(entities)), "path-statistics")), versions)
    return [(t, v, f, c, o) for t, vs in sorted(versions.items()) for v, f, c, o in changes(vs, shown.get(t, Evidence()))]


def p2_found(entities: DataFrame, schemas: DataFrame) -> DataFrame:
    """record_type, version, field, change, former_field. Types without records are judged by the dictionary alone;
    docs of unregistered versions and docs that are no JSON objects show nothing."""
    return entities.sparkSession.createDataFrame(schema_changes(entities, schemas), "record_type string, version long, field string, change string, former_field string")


def consistent_table(entities: DataFrame, schemas: DataFrame, record_type: str, found: list[tuple[str, int, str, str, str]] | None = None, with_files: bool = False) -> DataFrame:
    """One typed row per record of a type: id, version, the fields of its last registered version, ``failed_casts``
    (fields whose value did not fit their type) and ``other`` (fields the dictionary does not have, as text).

    Renamed fields, declared or not, are read under every name they have had.
    """
    spec = dictionary(schemas)[record_type]
    last = spec[max(spec)]
    names: dict[str, list[str]] = {f: [f] for f in last}
    for t, _, new, change, old in reversed(found if found is not None else schema_changes(entities, schemas)):
        if t == record_type and change == "renamed":
            for f, all_names in names.items():
                if new in all_names and old not in all_names:
                    all_names.append(old)
                elif old in all_names and new not in all_names and new not in last:
                    all_names.append(new)
    records = current_records(entities).where(F.col("type") == record_type)
    doc = records.select("id", "version", "file", F.from_json("doc", "map<string,variant>").alias("m"))
    columns, failed = [], []
    for f, all_names in names.items():
        raw = F.coalesce(*[F.col("m")[n] for n in all_names])
        kind = last[f].get("type")
        target = "array<string>" if kind == "array" else "date" if last[f].get("format") == "date" else _SPARK_TYPES.get(kind, "string")
        value = F.expr(f"try_variant_get(`raw {f}`, '$', '{target}')")
        doc = doc.withColumn(f"raw {f}", raw)
        columns.append(value.alias(f))
        failed.append(F.when(F.col(f"raw {f}").isNotNull() & value.isNull() & (json_type(F.col(f"raw {f}")) != "null"), F.lit(f)))
    used = {n for ns in names.values() for n in ns}
    other = F.transform_values(F.map_filter("m", lambda k, v: ~k.isin(*used)), lambda k, v: F.to_json(v))
    return doc.select("id", "version", *columns, F.array_compact(F.array(*failed)).alias("failed_casts"), other.alias("other"), *([doc["file"]] if with_files else []))


def failed_casts(entities: DataFrame, schemas: DataFrame) -> DataFrame:
    """file, record_type, version, field, records, failed: how many of a file's records have a value for a field of the
    consistent table that does not fit its type, out of all records of that version; no row where all fit."""
    found = schema_changes(entities, schemas)
    parts = []
    for record_type in sorted(dictionary(schemas)):
        wide = consistent_table(entities, schemas, record_type, found, with_files=True).select("file", "version", "failed_casts")
        sizes = wide.groupBy("file", "version").agg(F.count("*").alias("records"))
        lost = wide.select("file", "version", F.explode("failed_casts").alias("field")).groupBy("file", "version", "field").agg(F.count("*").alias("failed"))
        parts.append(lost.join(sizes, ["file", "version"]).select("file", F.lit(record_type).alias("record_type"), "version", "field", "records", "failed"))
    schema = "file string, record_type string, version long, field string, records long, failed long"
    return reduce(DataFrame.unionByName, parts) if parts else entities.sparkSession.createDataFrame([], schema)


def consistent_values(entities: DataFrame, schemas: DataFrame) -> DataFrame:
    """The consistent tables of all types of the dictionary in one long form: record_type, id, version, field, value (text),
    failed (the value did not fit its type and is null) and declared (false: one of ``other``). Absent values have no row."""
    found = schema_changes(entities, schemas)
    parts = []
    for record_type in sorted(dictionary(schemas)):
        wide = consistent_table(entities, schemas, record_type, found)
        fields = [c for c in wide.columns if c not in ("id", "version", "failed_casts", "other")]
        text = lambda c, kind: F.to_json(F.col(f"`{c}`")) if kind.startswith("array") else F.col(f"`{c}`").cast("string")
        kinds = dict(wide.dtypes)
        own = [F.struct(F.lit(c).alias("field"), text(c, kinds[c]).alias("value"), F.array_contains("failed_casts", c).alias("failed"), F.lit(True).alias("declared")) for c in fields]
        others = F.transform(F.map_entries(F.coalesce("other", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"), F.lit(False).alias("failed"), F.lit(False).alias("declared")))
        rows = wide.select(F.lit(record_type).alias("record_type"), "id", "version", F.explode(F.concat(F.array(*own), others) if own else others).alias("f"))
        parts.append(rows.select("record_type", "id", "version", "f.*").where("failed or value is not null and (declared or value <> 'null')"))
    schema = "record_type string, id string, version long, field string, value string, failed boolean, declared boolean"
    return reduce(DataFrame.unionByName, parts) if parts else entities.sparkSession.createDataFrame([], schema)
