"""Cells and outputs of notebooks written into text in one of four forms."""

from __future__ import annotations

import json
import re

TEXT, CODE, OUTPUT, PAGE = "text", "code", "output", "page"

_PERCENT = re.compile(r"^# %%(.*)$")
_OUT = re.compile(r"^(?:# )?Out\[[ \d]*\]:")
_IN = re.compile(r"^In \[[ \d]*\]:\s*$")


def joined(value: object) -> str:
    """Text of an ipynb field, which may be a string, a list of lines or absent."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(v for v in value if isinstance(v, str))
    return ""


def ipynb(text: str) -> list[tuple[str, str]] | None:
    """Segments of an ipynb document; None where the text is no notebook."""
    try:
        book = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(book, dict) or not isinstance(book.get("cells"), list):
        return None
    found = []
    for cell in book["cells"]:
        if not isinstance(cell, dict):
            continue
        found.append((CODE if cell.get("cell_type") == "code" else TEXT, joined(cell.get("source"))))
        for out in cell.get("outputs") or []:
            if isinstance(out, dict):
                shown = [joined(out.get("text")), *(joined(v) for k, v in (out.get("data") or {}).items() if k.startswith("text/"))]
                trace = [joined(out.get("ename")), joined(out.get("evalue")), "\n".join(map(joined, out.get("traceback") or []))]
                found += [(OUTPUT, s) for s in (*shown, "\n".join(t for t in trace if t)) if s]
    return found


def percent(text: str) -> list[tuple[str, str]]:
    """``# %%`` cells; outputs follow as ``# Out[n]:`` and lines that begin ``# > ``."""
    found: list[tuple[str, list[str]]] = []
    kind, lines = PAGE, []
    for line in text.split("\n"):
        if m := _PERCENT.match(line):
            found.append((kind, lines))
            kind, lines = (TEXT if "[markdown]" in m[1] or "[raw]" in m[1] else CODE), []
        elif kind in (CODE, OUTPUT) and _OUT.match(line) and line.startswith("# "):
            found.append((kind, lines))
            kind, lines = OUTPUT, []
        elif kind == OUTPUT:
            if line.startswith("# >"):
                lines.append(line[3:].removeprefix(" "))
            elif line.strip():
                found.append((kind, lines))
                kind, lines = CODE, [line]
        elif kind == TEXT:
            lines.append(line[2:] if line.startswith("# ") else "" if line == "#" else line)
        else:
            lines.append(line)
    found.append((kind, lines))
    return [(k, s) for k, ls in found if (s := "\n".join(ls).strip("\n"))]


def fenced(text: str) -> list[tuple[str, str]]:
    """Fenced code, outputs indented by four spaces after it, text elsewhere.

    Neighbouring text cells and the paragraphs of one cell are written alike, so a paragraph is a segment.
    """
    found: list[tuple[str, list[str]]] = []
    kind, lines, after_code = TEXT, [], False
    for line in text.split("\n"):
        if kind == CODE:
            if line.rstrip() == "```":
                found.append((kind, lines))
                kind, lines, after_code = TEXT, [], True
            else:
                lines.append(line)
        elif line.startswith("```"):
            found.append((kind, lines))
            kind, lines = CODE, []
        elif kind == OUTPUT:
            if line.startswith("    ") or not line.strip():
                lines.append(line[4:])
            else:
                found.append((kind, lines))
                kind, lines, after_code = TEXT, [line], False
        elif after_code and line.startswith("    ") and not any(s.strip() for s in lines):
            kind, lines = OUTPUT, [line[4:]]
        elif not line.strip():
            found.append((kind, lines))
            lines = []
        else:
            after_code = False
            lines.append(line)
    found.append((kind, lines))
    return [(k, s) for k, ls in found if (s := "\n".join(ls).strip("\n"))]


def rendered(text: str) -> list[tuple[str, str]]:
    """``In [n]:`` and ``Out[n]:`` blocks. A block ends at a blank line, except inside an indented body,
    a docstring or a traceback; a paragraph of text is a segment."""
    found: list[tuple[str, list[str]]] = []
    kind, lines = TEXT, []
    rows = text.split("\n")
    for i, line in enumerate(rows):
        if _IN.match(line) or _OUT.match(line):
            found.append((kind, lines))
            kind = CODE if line.startswith("In") else OUTPUT
            rest = line.split(":", 1)[1].strip()
            lines = [rest] if rest else []
        elif not line.strip():
            body = "\n".join(lines)
            following = rows[i + 1] if i + 1 < len(rows) else ""
            inside = kind == CODE and (following.startswith((" ", "\t")) or body.count('"""') % 2 == 1)
            trace = kind == OUTPUT and body.startswith("-----") and not re.search(r"^\w*(?:Error|Exception|Interrupt|Warning)\b.*:", lines[-1] if len(lines) > 2 else "")
            if inside or trace:
                lines.append(line)
            else:
                found.append((kind, lines))
                kind, lines = TEXT, []
        else:
            lines.append(line)
    found.append((kind, lines))
    return [(k, s) for k, ls in found if (s := "\n".join(ls).strip("\n"))]


def segments(text: str | None, form: str | None) -> list[tuple[str, str]]:
    """(kind, text) of every cell source and output, in order. A text without the marks of its form is one
    page; null is none. An unknown form is told from the text."""
    if not text or not text.strip():
        return []
    if form == "ipynb" or form not in ("percent", "fenced", "rendered") and text.lstrip()[:1] == "{":
        found = ipynb(text)
        return [(PAGE, text)] if found is None else found
    if form == "percent" or form not in ("fenced", "rendered") and "\n# %%" in f"\n{text}":
        found = percent(text)
    elif form == "fenced" or form != "rendered" and "```" in text:
        found = fenced(text)
    else:
        found = rendered(text)
    return found
