"""Template residue and error-page text.

Character n-gram models of filler, of notices (error pages, demands for scripts) and of natural prose are fitted: the first
two on the seed texts of ``seeds``, prose on the text cells of all documents. Residue is localised by windows in which the
log-likelihood ratio is high, and a document is excluded by how much the windows cover: notice windows a share of a whole
page, filler windows a share of a sentence of a text cell.

Words are read by 4-grams of letters, unfilled slots by 4-grams of shapes, in which a word is one sign and a number
another, so a slot is known by its marks whatever it asks for. Filler has to be likelier than prose and than a notice.
Code, outputs, quotations, code spans and formulas are no author's words gone missing; they speak for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.cells import CODE, OUTPUT, PAGE, TEXT, segments
from recordweave.llm.seeds import DELIMITERS, seed_texts
from recordweave.runtime import materialise, ship

WORD_ORDER = 4
SHAPE_ORDER = 4
BUCKETS = 1 << 16
#: (n-grams in a window, least sum of log-likelihood ratios) of filler windows over letters and over shapes.
WORD_WINDOWS = ((16, 12.0), (10, 12.0))
SHAPE_WINDOW = (4, 5.0)
#: Share of a sentence that filler windows cover, from which its cell is excluded.
FILLER_COVERAGE = 0.08
#: Notice windows, and the share of a page that they cover, from which it is excluded.
NOTICE_WINDOW = (16, 8.0)
NOTICE_COVERAGE = 0.35
#: Stands for what speaks for nothing; so many between two cells that no window reads both.
BLANK = "\0"
GAP = "\n" + BLANK * 16 + "\n"

_QUOTED = re.compile(r"```.*?```|`[^`\n]*`|\$\$.*?\$\$|\$(?!\{)[^$\n]+\$|\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»", re.S)
_SPACES = re.compile(r"[^\S\n]")
_SENTENCE = re.compile(r"[^\n\0]+?(?:[.!?](?=\s)|(?=[\n\0])|$)")


def masked(text: str) -> str:
    """The text with quotations, code spans and formulas blanked out, at the same length, and plain blanks."""
    return _SPACES.sub(" ", _QUOTED.sub(lambda m: BLANK * len(m[0]), text))


def _hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each code from the ``order``-th on; 0 where it holds a BLANK."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mixed, void = np.zeros(n, np.uint64), np.zeros(n, bool)
    for j in range(order):
        part = codes[j : j + n].astype(np.uint64)
        mixed = mixed * np.uint64(1_000_003) + part
        void |= part == 0
    found = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    return np.where(void, 0, np.maximum(found, 1))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def word_grams(text: str) -> np.ndarray:
    """The bucket of the n-gram of letters that ends at each character; a line break parts words as a blank does."""
    text = text.replace("\n", " ")
    lower = text.lower()
    return _hashed(_codes(" " * (WORD_ORDER - 1) + (lower if len(lower) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text))), WORD_ORDER)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x30000):
        if (ch := chr(c)).isalpha():
            kinds[c] = ord("a")
        elif ch.isdigit():
            kinds[c] = ord("9")
    return kinds


def shape_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the n-gram of shapes that begins at each sign, where the sign begins in the text). A run of letters,
    joined by single underscores, is one sign, a run of digits another, all else is as it is; a line end surrounds the text."""
    codes = _codes("\n" + text + "\n")
    kinds = _kinds()[codes].copy()
    letter = kinds == ord("a")
    joint = np.zeros(len(codes), bool)
    joint[1:-1] = (codes[1:-1] == ord("_")) & letter[:-2] & letter[2:]
    kinds[joint] = ord("a")
    same = np.zeros(len(codes), bool)
    same[1:] = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == ord("a")) | (kinds[1:] == ord("9")))
    at = np.flatnonzero(~same)
    return _hashed(kinds[at], SHAPE_ORDER), np.maximum(at - 1, 0)


def counted(texts: list[str]) -> np.ndarray:
    """In how many of the texts each n-gram stands: of letters in the first half, of shapes in the second."""
    total = np.zeros(2 * BUCKETS)
    for t in texts:
        words, shapes = np.unique(word_grams(t)), np.unique(shape_grams(t)[0])
        total[words[words > 0]] += 1
        total[BUCKETS + shapes[shapes > 0]] += 1
    return total


def _table(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities, a tenth of the mass spread evenly, so an n-gram no model has seen speaks for none."""
    return np.log(0.9 * counts / max(1.0, counts.sum()) + 0.1 / BUCKETS)


def covered(ratio: np.ndarray, size: int, least: float) -> np.ndarray:
    """The places that lie in a window whose ratios sum to ``least``, in proportion where there are fewer than ``size``."""
    n, w = len(ratio), min(size, len(ratio))
    if not n:
        return np.zeros(0, bool)
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    high = np.flatnonzero(total[w:] - total[:-w] >= least * w / size)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, high, 1)
    np.add.at(mark, high + w, -1)
    return np.cumsum(mark[:-1]) > 0


class ResidueModel:
    """Log-likelihood ratios against prose, and the two decisions."""

    def __init__(self, prose: np.ndarray, filler: list[str] | None = None, notices: list[str] | None = None) -> None:
        """prose: counts as ``counted`` gives them. filler, notices: other texts to fit on than the seeds."""
        seeds = seed_texts()
        filler, notices = seeds[0] if filler is None else filler, seeds[1] if notices is None else notices
        slots = [before + d.replace("X", w) + after for d in (*DELIMITERS, "<X X>", "<X X X>") for w in ("name", "name 1") for before, after in ((" ", " "), ("", ""), (" ", "."), ("# ", ""), (": ", ""))]  # in a sentence, alone, as a heading, as a value
        natural, notice = _table(prose[:BUCKETS]), _table(counted(notices)[:BUCKETS])
        self.notice = notice - natural
        self.words = _table(counted(filler)[:BUCKETS]) - np.maximum(natural, notice)
        self.shapes = _table(counted(slots)[BUCKETS:]) - _table(prose[BUCKETS:])
        for table in (self.notice, self.words, self.shapes):
            table[0] = 0.0

    def is_notice(self, page: str) -> bool:
        """Notice windows cover enough of a page."""
        page = _SPACES.sub(" ", page.strip())
        return bool(page) and float(covered(self.notice[word_grams(page)], *NOTICE_WINDOW).mean()) >= NOTICE_COVERAGE

    def filler(self, cells: str) -> np.ndarray:
        """The characters of masked text that lie in filler windows."""
        ratio = self.words[word_grams(cells)]
        mark = covered(ratio, *WORD_WINDOWS[0])
        for size, least in WORD_WINDOWS[1:]:
            mark |= covered(ratio, size, least)
        grams, begins = shape_grams(cells)
        for k in np.flatnonzero(covered(self.shapes[grams], *SHAPE_WINDOW)):
            mark[begins[k] : begins[min(k + SHAPE_ORDER, len(begins) - 1)]] = True
        return mark

    def has_filler(self, cells: str) -> bool:
        """Filler windows cover enough of a sentence of masked text cells."""
        mark = self.filler(cells)
        if not mark.any():
            return False
        total = np.concatenate([[0], np.cumsum(mark)])
        return any(total[m.end()] - total[m.start()] >= max(1, FILLER_COVERAGE * (m.end() - m.start())) for m in _SENTENCE.finditer(cells))


def parts(text: str | None, form: str | None) -> tuple[str | None, str | None]:
    """(page, cells) of a document: its whole text where it holds no code and no output, else null; its masked text cells,
    GAP around each, null where it has none."""
    found = segments(text, form)
    cells = [masked(p) for kind, p in found if kind == TEXT and p.strip()]
    page = None
    if found and not any(kind in (CODE, OUTPUT) for kind, _ in found):
        page = text if found[0][0] == PAGE else "\n".join(p for _, p in found)
    return page, (GAP + GAP.join(cells) + GAP) if cells else None


def read_parts(documents: DataFrame) -> DataFrame:
    """(doc_id, page, cells) of every document, parsed once and written; fitting and scanning read what is written."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [parts(t, f) for t, f in zip(pdf["text"], pdf["export_form"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page": [b[0] for b in both], "cells": [b[1] for b in both]})

    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "export_form")
    return materialise(rows.mapInPandas(read, "doc_id long, page string, cells string").where("page is not null or cells is not null"), "cells")


def prose_counts(read: DataFrame) -> np.ndarray:
    """In how many documents each n-gram stands in a text cell; once a document, so that no long or repetitive text
    outweighs the others."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(2 * BUCKETS, np.int64)
        for pdf in batches:
            sums += counted(list(pdf["cells"])).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"gram": at, "n": sums[at]})

    rows = read.where("cells is not null").select("cells").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * BUCKETS rows
    counts = np.zeros(2 * BUCKETS)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return counts


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents to exclude. Empty and null texts are kept (they hold no residue); null ids have no row;
    texts of any length are read whole; a repeated document gives one row."""
    ship(documents.sparkSession)
    read = read_parts(documents)
    model = documents.sparkSession.sparkContext.broadcast(ResidueModel(prose_counts(read)))  # a fixed 2 MB

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = model.value
        for pdf in batches:
            bad = [bool(p) and told.is_notice(p) or bool(c) and told.has_filler(c) for p, c in zip(pdf["page"], pdf["cells"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"][bad]})

    return read.where("doc_id is not null").mapInPandas(scan, "doc_id long").distinct()
