"""Organising what was stored before it was registered: proposals, and what applying one does.

A proposal changes the dictionary in one item: it registers a draft field, registers values of an enum, or merges a draft
field into one it looks like. Nothing is applied without the name of who approved it. Merging moves values by ``migrated``
changes, so the feed stays the only truth.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.operators.profile import similar_names
from recordweave.operators.recording import stable_id
from recordweave.plans.dictionary import with_field
from recordweave.plans.spec import TypeDef


@dataclass(frozen=True)
class Proposal:
    action: str  # register_field, register_values or merge_fields
    entity_type: str
    field: str
    into: str = ""
    type: str = "string"
    format: str | None = None
    values: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return "prop_" + hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, default=list).encode()).hexdigest()[:12]

    @property
    def question(self) -> str:
        return {
            "register_field": f"Register {self.field} of {self.entity_type} as {self.type}?", "register_values": f"Register {', '.join(self.values)} as values of {self.field} of {self.entity_type}?",
            "merge_fields": f"Is {self.field} of {self.entity_type} the same as {self.into}?",
        }[self.action]


def proposed(types: dict[str, TypeDef], drafts: list[dict[str, Any]], stray: list[dict[str, Any]]) -> list[Proposal]:
    """Proposals for draft fields (rows of ``profile.draft_fields`` with ``type``) and stray enum values. A draft that looks like
    a registered field is proposed for merging as well as for registration."""
    found = []
    for d in sorted(drafts, key=lambda d: (d["entity_type"], d["field"])):
        t = types.get(d["entity_type"])
        if t is None:
            continue
        labels = {n: [w for ws in f.labels.values() for w in ws] for n, f in t.fields.items()}
        found += [Proposal("merge_fields", t.name, d["field"], into=n) for n in similar_names(d["field"], list(t.fields), labels)]
        kind = d.get("type", "string")
        found.append(Proposal("register_field", t.name, d["field"], type="string" if kind in ("date", "date-time") else kind, format=kind if kind in ("date", "date-time") else None))
    by_field: dict[tuple[str, str], list[str]] = {}
    for s in stray:
        by_field.setdefault((s["entity_type"], s["field"]), []).append(s["value"])
    return found + [Proposal("register_values", t, f, values=tuple(sorted(vs))) for (t, f), vs in sorted(by_field.items()) if t in types]


def applied(p: Proposal, t: TypeDef, approved_by: str) -> TypeDef:
    """The type after a proposal; a merge changes no definition. Refused (ValueError) without approval or where it would
    change what is registered."""
    if not approved_by.strip():
        raise ValueError("a proposal is applied with the name of who approved it")
    if p.action == "register_field":
        if p.field in t.fields:
            raise ValueError(f"{p.field} is registered")
        return with_field(t, p.field, type=p.type, format=p.format)
    f = t.fields.get(p.into if p.action == "merge_fields" else p.field)
    if f is None:
        raise ValueError(f"{t.name} has no field {p.into or p.field}")
    if p.action == "merge_fields":
        return t
    new = tuple(v for v in p.values if v not in f.enum)
    return with_field(t, p.field, enum=(*f.enum, *new)) if f.enum and new else t


def moves(p: Proposal, records: DataFrame, at: str, by: str) -> DataFrame:
    """The ``migrated`` changes of a merge: every live record that has the draft field gives its value to the other field, where
    that has none, and loses the draft. Columns as the feed's, without seq."""
    value = F.get_json_object("doc", f"$['{p.field}']")
    parsed = F.from_json("doc", "map<string,variant>")
    rows = records.where((F.col("type") == p.entity_type) & ~F.coalesce("retracted", F.lit(False)) & value.isNotNull()).withColumn("_m", parsed)
    given = F.to_json(F.col("_m")[p.field])
    name = lambda f: json.dumps(f, ensure_ascii=False)
    taken = F.col("_m")[p.into].isNotNull() & ~F.is_variant_null(F.col("_m")[p.into])
    payload = F.when(taken, F.lit(f"{{{name(p.field)}:null}}")).otherwise(F.concat(F.lit(f"{{{name(p.into)}:"), given, F.lit(f",{name(p.field)}:null}}")))
    return rows.select(
        stable_id("evt", F.concat_ws("|", F.lit(p.id), "id")).alias("id"), F.col("id").alias("entity_id"), F.col("type").alias("entity_type"), F.lit("migrated").alias("kind"), payload.alias("payload"),
        F.lit(at).alias("at"), F.lit(at).alias("recorded_at"), F.lit(by).alias("recorded_by"), F.lit(p.question).alias("evidence"), F.lit(None).cast("string").alias("target_event_id"), F.lit("time").alias("at_precision"),
    )


def difference(old: dict[str, TypeDef], new: dict[str, TypeDef]) -> list[tuple[str, str, str]]:
    """(type, field, what) by which definitions from files go beyond the registered ones: new types, new fields, new values,
    other labels, phrases or descriptions. What is only in the registered ones is left alone."""
    out = []
    for name, t in sorted(new.items()):
        if name not in old:
            out.append((name, "", "new type"))
            continue
        for f, d in t.fields.items():
            was = old[name].fields.get(f)
            if was is None:
                out.append((name, f, "new field"))
                continue
            out += [(name, f, f"new value {v}") for v in d.enum if v not in was.enum]
            out += [(name, f, what) for what in ("labels", "groups", "implies", "description") if getattr(d, what) != getattr(was, what)]
    return out


def with_drafts(t: TypeDef, drafts: list[dict[str, Any]], stray: list[dict[str, Any]]) -> TypeDef:
    """A type that questions may use before its drafts are registered: draft fields of one plain type, and stray values."""
    fields = dict(t.fields)
    for d in drafts:
        if d["entity_type"] == t.name and d["types"] in ("string", "integer", "number", "boolean") and d["field"].isidentifier():
            from recordweave.plans.spec import FieldDef

            fields[d["field"]] = FieldDef(d["types"], description=f"seen in {d['n']} record(s)", draft=True)
    for s in stray:
        if s["entity_type"] == t.name and s["field"] in fields:
            f = fields[s["field"]]
            fields[s["field"]] = replace(f, enum=(*f.enum, s["value"]), draft_values=(*f.draft_values, s["value"]))
    return replace(t, fields=fields)
