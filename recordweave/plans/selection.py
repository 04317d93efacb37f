"""What an interpreter of questions is told: the types a question is about, and the dictionary in words."""

from __future__ import annotations

from recordweave.plans.spec import EVENT_TYPE, FieldDef, TypeDef


def about(question: str, types: dict[str, TypeDef]) -> list[str]:
    """The types a question is about: those whose name, keywords or labels stand in it, and their neighbours: types related
    by a declared relation, types that refer to one or are referred to, and series keyed by a type that one refers to (and
    the records that refer to what a named series is keyed by). All types if none is named."""
    text = question.lower()
    words = {n: [n, *t.keywords, *(w for f in t.fields.values() for ws in f.labels.values() for w in ws)] for n, t in types.items()}
    named = [n for n in types if any(w and w.lower() in text for w in words[n])]
    if not named:
        return list(types)
    refs = {n: {f.ref for f in t.fields.values() if f.ref in types} for n, t in types.items()}
    keyed = {n: types[n].fields[types[n].key[0]].ref for n in types if types[n].kind == "series" and len(types[n].key) == 1}
    related = {n: {o for o, _ in t.relations} for n, t in types.items()}
    wanted = set(named)
    wanted |= {o for n in named for o in types if o in related[n] or n in related[o]}
    wanted |= {o for n in named for o in types if n in refs[o]}
    wanted |= {r for n in list(wanted) for r in refs[n]}
    wanted |= {s for s, target in keyed.items() if any(target in refs[n] for n in named)}
    wanted |= {o for n in named if n in keyed for o in types if types[o].kind == "entity" and keyed[n] in refs[o]}
    return [*named, *(n for n in types if n in wanted and n not in named)]


def field_line(name: str, f: FieldDef, observed: list[str] | None = None) -> str:
    kinds = [f.type, *([f"format {f.format}"] if f.format else []), *([f"refers to {f.ref}, by id or by name"] if f.ref else [])]
    parts = [f"  {name} ({', '.join(kinds)})" + (f": {f.description}" if f.description else "")]
    if f.draft:
        parts.append("    not registered: only some records have it")
    if f.enum:
        parts.append("    values: " + ", ".join(v + (f" [{', '.join(f.labels[v])}]" if f.labels.get(v) else "") for v in f.enum if v not in f.draft_values))
    elif observed:
        parts.append("    seen: " + ", ".join(observed))
    if f.draft_values:
        parts.append("    values in use that are not registered: " + ", ".join(f.draft_values))
    parts += [f"    '{phrase}' means any of {', '.join(vs)}" for phrase, vs in f.groups.items()]
    parts += [f"    {later} went through {', '.join(earlier)}" for later, earlier in f.implies.items()]
    return "\n".join(parts)


def described(types: list[TypeDef], observed: dict[tuple[str, str], list[str]] | None = None) -> str:
    """The dictionary in words."""
    lines = []
    for t in types:
        lines.append(t.name + (f": {t.description}" if t.description else ""))
        if t.kind == "series":
            lines.append(f"  a series by {', '.join(t.key) or 'nothing'} and {t.time} ({t.granularity}); measures: {', '.join(t.measures)}")
        if t.default_date:
            lines.append(f"  a bare date means {t.default_date}")
        lines += [f"  '{word}' is read as {meaning}" for word, meaning in t.vague] + [f"  related to {other}: {how}" for other, how in t.relations]
        lines += [field_line(n, f, (observed or {}).get((t.name, n))) for n, f in t.fields.items()]
    lines.append("the log of changes (source events):")
    lines += [field_line(n, f) for n, f in EVENT_TYPE.fields.items()]
    return "\n".join(lines)
