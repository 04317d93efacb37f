"""The dictionary of types: reading definitions, what a new version may change, and checking documents against it."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.plans.spec import FieldDef, TypeDef

FIELD_TYPES = ("string", "integer", "number", "boolean", "array")
FORMATS = (None, "date", "date-time")
_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"


def read_type(definition: dict[str, Any]) -> TypeDef:
    """A type from its JSON definition; what is wrong with it raises ValueError with every reason."""
    wrong: list[str] = []
    fields = {}
    for name, d in (definition.get("fields") or {}).items():
        if d.get("type", "string") not in FIELD_TYPES:
            wrong.append(f"{name}: no type {d.get('type')!r}")
        if d.get("format") not in FORMATS or (d.get("format") and d.get("type", "string") != "string"):
            wrong.append(f"{name}: format {d.get('format')!r} is for text")
        if d.get("indexed") and d.get("type") == "array":
            wrong.append(f"{name}: a list cannot be indexed")
        if "enum" in d and (not d["enum"] or len(set(map(str, d["enum"]))) != len(d["enum"])):
            wrong.append(f"{name}: an enum lists different values")
        stray = [v for v in {*(d.get("labels") or {}), *(d.get("implies") or {})} if v not in (d.get("enum") or [])]
        if stray:
            wrong.append(f"{name}: {sorted(stray)} are not in its enum")
        groups = d.get("value_groups") or {}
        if any(len(vs) < 2 or not set(vs) <= set(d.get("enum") or ()) for vs in groups.values()):
            wrong.append(f"{name}: a phrase stands for two or more values of its enum")
        known = {k: d[k] for k in ("format", "ref", "description", "labels", "implies", "event") if d.get(k) is not None} | ({"groups": groups} if groups else {})
        fields[name] = FieldDef(d.get("type", "string"), enum=tuple(d.get("enum") or ()), identifier=bool(d.get("identifier")), indexed=bool(d.get("indexed")), required=name in (definition.get("required") or ()) or bool(d.get("required")), **known)
    t = TypeDef(definition["name"], fields, definition.get("kind", "entity"), tuple(definition.get("series_key") or ()), definition.get("time_field"), definition.get("granularity", "day"), int(definition.get("version", 1)),
                definition.get("description") or "", tuple(definition.get("keywords") or ()), definition.get("default_date_field"), tuple(map(tuple, definition.get("relations") or ())), tuple(map(tuple, definition.get("vague_terms") or ())))
    if t.default_date and (t.default_date not in fields or not fields[t.default_date].is_date):
        wrong.append("the default date is a date field")
    if t.kind == "series":
        if t.time not in fields or not fields[t.time].is_date:
            wrong.append("a series has a time field that is a date")
        if not set(t.key) <= set(fields) or t.time in t.key or not t.measures:
            wrong.append("a series has keys and at least one numeric measure apart from them")
    if wrong:
        raise ValueError("; ".join(wrong))
    return t


def breaking(old: TypeDef, new: TypeDef) -> list[str]:
    """Why ``new`` may not follow ``old``: versions only add."""
    said = []
    for name, f in old.fields.items():
        g = new.fields.get(name)
        if g is None:
            said.append(f"{name} is gone")
            continue
        for what in ("type", "format", "ref"):
            if getattr(f, what) != getattr(g, what):
                said.append(f"{name}: its {what} changes")
        if lost := [v for v in f.enum if v not in g.enum]:
            said.append(f"{name}: {lost} are no longer allowed")
        if g.enum and not f.enum:
            said.append(f"{name}: it becomes an enum")
    said += [f"{n} is new and required" for n, g in new.fields.items() if n not in old.fields and g.required]
    said += [f"{n} becomes required" for n, g in new.fields.items() if n in old.fields and g.required and not old.fields[n].required]
    if (old.kind, old.key, old.time) != (new.kind, new.key, new.time):
        said.append("the kind, key or time of a type stays")
    return said


def written_type(t: TypeDef) -> dict[str, Any]:
    """The JSON definition of a type; ``read_type`` reads it back."""
    fields = {}
    for name, f in t.fields.items():
        d: dict[str, Any] = {"type": f.type}
        for key, value in (("format", f.format), ("ref", f.ref), ("description", f.description), ("enum", list(f.enum)), ("labels", f.labels), ("implies", f.implies), ("event", f.event), ("value_groups", f.groups), ("identifier", f.identifier), ("indexed", f.indexed), ("required", f.required)):
            if value:
                d[key] = value
        fields[name] = d
    out: dict[str, Any] = {"name": t.name, "version": t.version, "kind": t.kind, "fields": fields}
    for key, value in (("series_key", list(t.key)), ("time_field", t.time), ("description", t.description), ("keywords", list(t.keywords)), ("default_date_field", t.default_date), ("relations", list(map(list, t.relations))), ("vague_terms", list(map(list, t.vague)))):
        if value:
            out[key] = value
    return out | ({"granularity": t.granularity} if t.kind == "series" else {})


def with_field(t: TypeDef, name: str, **changes: Any) -> TypeDef:
    """The next version of a type, with a field added or changed."""
    old = t.fields.get(name)
    new = FieldDef(**changes) if old is None else replace(old, **changes)
    return replace(t, version=t.version + 1, fields=t.fields | {name: new})


def with_group(t: TypeDef, field: str, phrase: str, values: list[str]) -> TypeDef:
    """The next version of a type, in which a phrase stands for several values of a field."""
    f = t.fields.get(field)
    if f is None or len(set(values)) < 2 or not set(values) <= set(f.enum):
        raise ValueError(f"a phrase stands for two or more values of the enum of {field}")
    return with_field(t, field, groups=f.groups | {phrase.strip().lower(): sorted(set(values), key=f.enum.index)})


class Registry:
    """Types by name and version; registering a version again without change does nothing."""

    def __init__(self) -> None:
        self.versions: dict[str, dict[int, TypeDef]] = {}

    def latest(self, name: str) -> TypeDef | None:
        known = self.versions.get(name)
        return known[max(known)] if known else None

    @property
    def types(self) -> dict[str, TypeDef]:
        return {n: self.latest(n) for n in self.versions}

    def register(self, t: TypeDef, may_skip: bool = False) -> bool:
        """True if something new was registered; definitions from files may skip versions."""
        old = self.latest(t.name)
        if old is not None and t.version in self.versions[t.name]:
            if self.versions[t.name][t.version] != t:
                raise ValueError(f"{t.name} {t.version} is registered with another definition")
            return False
        expected = 1 if old is None else old.version + 1
        if t.version < expected or t.version > expected and not may_skip:
            raise ValueError(f"the next version of {t.name} is {expected}")
        if old is not None and (said := breaking(old, t)):
            raise ValueError("; ".join(said))
        self.versions.setdefault(t.name, {})[t.version] = t
        return True


def violations(t: TypeDef, doc: Column, strict: bool = False) -> Column:
    """Array of what a document (map field -> variant) violates. Lenient, as records are written: a wrong type or format
    of a registered field, a required field missing. Strict, as series are loaded: also unknown fields and enum values."""
    kinds = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",)}
    found = []
    for name, f in t.fields.items():
        v = doc[name]
        kind = F.schema_of_variant(v)
        there = v.isNotNull() & (kind != "VOID")
        typed = F.lit(False)
        for k in kinds[f.type]:
            typed = typed | kind.startswith(k)
        found.append(F.when(there & ~typed, f"{name}: not of type {f.type}"))
        text = v.try_cast("string")
        if f.format == "date":
            found.append(F.when(there & typed & ~(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()), f"{name}: no calendar day"))
        if f.format == "date-time":
            found.append(F.when(there & typed & ~(text.rlike(_INSTANT) & text.try_cast("timestamp").isNotNull()), f"{name}: no instant with an offset"))
        if f.required:
            found.append(F.when(~F.coalesce(there, F.lit(False)), f"{name}: missing"))
        if strict and f.enum:
            found.append(F.when(there & ~text.isin(*map(str, f.enum)), f"{name}: not one of its values"))
    known = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if not strict:
        return known
    unknown = F.array_except(F.map_keys(doc), F.array(*map(F.lit, t.fields)))
    return F.concat(known, F.transform(F.array_sort(unknown), lambda n: F.concat(n, F.lit(": unknown field"))))


def checked(docs: DataFrame, t: TypeDef, column: str = "doc", strict: bool = False) -> DataFrame:
    """``docs`` (JSON text in ``column``) with ``violations``; text that is no object violates as a whole."""
    parsed = F.from_json(column, "map<string,variant>")
    return docs.withColumn("violations", F.when(parsed.isNull() | F.col(column).isNull(), F.array(F.lit("no object"))).otherwise(violations(t, parsed, strict)))
