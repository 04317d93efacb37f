"""Evaluation texts leaking into training text.

Passages of evaluation items and segments of documents (a cell's source, or one output) are brought to one line of
lower-case words. Regions are found by q-gram lemma filtering: a stretch of at least ``span`` characters within ``edits``
edits of a passage shares at least ``span + 1 - q - q * edits`` q-grams with it, on neighbouring diagonals.

A first scan keeps the windows of a line that are dense enough in q-grams of any passage. They are cut into blocks so short
that some block of a window that meets the bound is free of edits; the rarest q-gram of every block that passages hold
throughout names the passages and diagonals to look at, so a phrase that many passages share costs each of them one entry a
block. Around every such diagonal the shared q-grams are counted in an overlapping band, and what meets the bound is
verified by banded alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.cells import segments
from recordweave.runtime import materialise, ship

WORDS = 12
Q = 8
EDITS = 1
#: Bands whose q-grams are counted at once.
BANDS = 1 << 13
#: Characters of passages held by one scan; larger item sets are searched in blocks of this size.
BLOCK_CHARS = 16_000_000
#: A longer line is read in overlapping pieces of this many bytes.
PIECE = 1 << 18
#: Index entries taken up at once.
ENTRIES = 1 << 20

_SEPARATORS = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
#: Stand beside the q-grams of passages and of a line; neither is UTF-8.
NO_GRAM, END_GRAM = np.uint64(2**64 - 1), np.uint64(2**64 - 2)


def words_line(text: str) -> str:
    """The words of a text, lower-cased, between single blanks, with a blank at either end."""
    return f" {_SEPARATORS.sub(' ', text.lower()).strip()} "


def _grams(line: bytes) -> np.ndarray:
    """The Q bytes from each position, as one integer each."""
    raw = np.frombuffer(line, np.uint8).astype(np.uint64)
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(Q):
        out |= raw[j : j + n] << np.uint64(8 * j)
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return ((grams * _MIX) >> np.uint64(64 - _BITS)).astype(np.int64)


def run_lengths(line: bytes, words: int) -> np.ndarray:
    """Bytes, both blanks included, of every run of ``words`` words."""
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return blanks[words:] - blanks[:-words] + 1 if len(blanks) > words else np.zeros(0, np.int64)


def _same_from(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements agree."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


class PassageIndex:
    """q-grams of a block of passages; built once per worker. Equal passages are held once."""

    def __init__(self, passages: tuple[tuple[int, str], ...], words: int = WORDS, edits: int = EDITS) -> None:
        self.words, self.edits = words, edits
        owners: dict[bytes, set[int]] = {}
        for item, text in passages:
            line = words_line(text).encode()
            if len(run_lengths(line, words)):
                owners.setdefault(line, set()).add(item)
        self.lines, self.items = list(owners), list(owners.values())
        lengths = np.concatenate([run_lengths(line, words) for line in self.lines]) if self.lines else np.zeros(0, np.int64)
        self.span, self.longest = (int(lengths.min()), int(lengths.max())) if len(lengths) else (0, 0)
        self.least = max(1, self.span + 1 - Q - Q * edits)
        self.window = max(1, self.span - Q + 1)
        self.block = next(b for b in range(self.window, 0, -1) if b == 1 or (self.window - b + 1) // b > edits * (1 + -(-(Q - 1) // b)))
        self.raw = [np.frombuffer(line, np.uint8) for line in self.lines]
        grams = [_grams(line) for line in self.lines]
        value = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        by = np.argsort(value, kind="stable")
        self.gram = value[by]
        self.passage = np.concatenate([np.full(len(g), p, np.int32) for p, g in enumerate(grams)])[by] if grams else np.zeros(0, np.int32)
        self.offset = np.concatenate([np.arange(len(g), dtype=np.int64) for g in grams])[by] if grams else np.zeros(0, np.int64)
        # all passages in one row, so far apart that no window around a q-gram reaches two
        gap = np.full(self.window + edits, NO_GRAM, np.uint64)
        self.row = np.concatenate([part for g in grams for part in (gap, g)] + [gap])
        self.base = np.cumsum([len(gap)] + [len(g) + len(gap) for g in grams])[: len(grams)]
        kept = self.distinct_entries()
        self.gram, self.passage, self.offset = self.gram[kept], self.passage[kept], self.offset[kept]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[_slots(self.gram)] = True

    def distinct_entries(self) -> np.ndarray:
        """Entries to keep: of a q-gram's places in one passage that any run of words sees alike, one stands for all, so a
        repetitive passage does not meet a repetitive text once for every pair of repeats."""
        kept = np.ones(len(self.gram), bool)
        if not len(kept) or self.longest > 4_096:
            return kept
        starts = np.flatnonzero(np.concatenate([[True], (self.gram[1:] != self.gram[:-1]) | (self.passage[1:] != self.passage[:-1])]))
        ends = np.append(starts[1:], len(kept))
        for a, b in zip(starts[ends - starts > 4], ends[ends - starts > 4]):
            line, seen = self.lines[self.passage[a]], set()
            for e in range(a, b):
                o = int(self.offset[e])
                around = (line[max(0, o - self.longest) : o], line[o : o + self.longest])
                kept[e] = around not in seen
                seen.add(around)
        return kept

    def anchors(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, passage, diagonal) of the rarest q-gram of every block that may lie in a region, ENTRIES at a time."""
        hit = self.table[_slots(grams)]
        total = np.concatenate([[0], np.cumsum(hit)])
        if total[-1] < self.least:
            return
        last = max(1, len(hit) - self.window + 1)
        dense = np.flatnonzero(total[np.minimum(np.arange(last) + self.window, len(hit))] - total[:last] >= self.least)
        if not len(dense):
            return
        cover = np.zeros(len(hit) + 1, np.int64)
        np.add.at(cover, dense, 1)
        np.add.at(cover, np.minimum(dense + self.window, len(hit)), -1)
        at = np.flatnonzero(hit & (np.cumsum(cover[:-1]) > 0))
        low = np.searchsorted(self.gram, grams[at], "left")
        counts = np.zeros(-(-len(hit) // self.block) * self.block, np.int64)
        counts[at] = np.searchsorted(self.gram, grams[at], "right") - low
        first = np.zeros(len(counts), np.int64)
        first[at] = low
        blocks = counts.reshape(-1, self.block)
        whole = np.flatnonzero(blocks.all(axis=1))
        picked = whole * self.block + blocks[whole].argmin(axis=1)
        size = np.cumsum(counts[picked])
        begin = 0
        while begin < len(picked):
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + ENTRIES, "right")))
            pos, n = picked[begin:end], counts[picked[begin:end]]
            entry = np.repeat(first[pos] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            where = np.repeat(pos, n)
            yield where, self.passage[entry], where - self.offset[entry]
            begin = end

    def in_band(self, grams: np.ndarray, pos: np.ndarray, passage: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Which anchors lie in a window of the line that shares enough q-grams with the passage in the band of diagonals that
        the edits allow around theirs. Bands overlap, as every anchor is the middle of its own."""
        w = self.window
        around = np.arange(-w + 1, w)
        line = np.concatenate([np.full(w, END_GRAM, np.uint64), grams, np.full(w, END_GRAM, np.uint64)])
        enough = np.zeros(len(pos), bool)
        for a in range(0, len(pos), BANDS):
            b = slice(a, a + BANDS)
            said = line[(pos[b] + w)[:, None] + around]
            place = (self.base[passage[b]] + pos[b] - diagonal[b])[:, None] + around
            shared = np.zeros(said.shape, bool)
            for k in range(-self.edits, self.edits + 1):
                shared |= said == self.row[place + k]
            total = np.concatenate([np.zeros((len(said), 1), np.int32), np.cumsum(shared, axis=1, dtype=np.int32)], axis=1)
            enough[b] = (total[:, w:] - total[:, :-w]).max(axis=1) >= self.least
        return enough

    def regions(self, line: bytes, found: set[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(passage, diagonal, positions of anchors) of stretches of a words line around a diagonal whose band meets the
        bound; passages of items that are found already are left out."""
        if not self.span or len(line) < self.span - self.edits:
            return
        grams = _grams(line)
        for pos, passage, diagonal in self.anchors(grams):
            enough = self.in_band(grams, pos, passage, diagonal)
            pos, passage, diagonal = pos[enough], passage[enough], diagonal[enough]
            if not len(pos):
                continue
            by = np.lexsort((pos, diagonal, passage))
            pos, passage, diagonal = pos[by], passage[by], diagonal[by]
            starts = np.flatnonzero(np.concatenate([[True], (passage[1:] != passage[:-1]) | (diagonal[1:] != diagonal[:-1])]))
            for a, b in zip(starts, np.append(starts[1:], len(pos))):
                if not self.items[passage[a]] <= found:
                    yield int(passage[a]), int(diagonal[a]), pos[a:b]

    def aligned(self, line: np.ndarray, p: int, d: int, at: int) -> list[tuple[int, int]]:
        """Banded alignment from a shared q-gram at ``at`` on diagonal ``d``: the stretches of the line, as (begin, end), that
        stand in the passage without an edit, one after another with an edit between two."""
        after = extended(line[at:], self.raw[p][at - d :], self.edits)
        before = extended(line[:at][::-1], self.raw[p][: at - d][::-1], self.edits)
        return [(at - before[0][1], at + after[0][1]), *((at + a, at + b) for a, b in after[1:]), *((at - b, at - a) for a, b in before[1:])]

    def leaks(self, text: str) -> set[int]:
        """Items of which ``words`` consecutive words stand in one segment."""
        found: set[int] = set()
        for line in pieces(words_line(text).encode(), max(PIECE, 4 * self.longest), self.longest + Q):
            raw = np.frombuffer(line, np.uint8)
            for p, d, positions in self.regions(line, found):
                end = -1
                for at in positions:
                    if at >= end:
                        stretches = self.aligned(raw, p, d, int(at))
                        end = stretches[0][1]
                        if any(b - a >= self.span and line.count(b" ", a, b) > self.words for a, b in stretches):  # whole words
                            found |= self.items[p]
                            break
        return found


def extended(a: np.ndarray, b: np.ndarray, edits: int) -> list[tuple[int, int]]:
    """The stretches of ``a``, as (begin, end), along the alignment with ``b`` from their starts: after each of up to ``edits``
    edits (another byte, one more, one less) the diagonal that reaches furthest is taken."""
    x = y = 0
    stretches = []
    for k in range(edits + 1):
        n = _same_from(a[x:], b[y:])
        stretches.append((x, x + n))
        x, y = x + n, y + n
        steps = [(i, j) for i, j in ((x + 1, y + 1), (x + 1, y), (x, y + 1)) if i <= len(a) and j <= len(b)]
        if k == edits or not steps:
            break
        x, y = max(steps, key=lambda s: _same_from(a[s[0] :], b[s[1] :]))
    return stretches


def pieces(line: bytes, size: int, overlap: int) -> Iterator[bytes]:
    """A words line in pieces of whole words, each of which repeats at least ``overlap`` bytes of the one before."""
    at = 0
    while len(line) - at > size + overlap:
        end = line.find(b" ", at + size + overlap - 1)
        if end < 0:
            break
        yield line[at : end + 1]
        at = line.rfind(b" ", 0, end + 1 - overlap)
    yield line[at:]


@lru_cache(maxsize=2)
def _index(passages: tuple[tuple[int, str], ...]) -> PassageIndex:
    return PassageIndex(passages)


def passage_blocks(items: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """Prompts and answers in blocks of bounded size, streamed to the driver one partition at a time."""
    sides = F.explode(F.array("prompt", "answer")).alias("text")
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), sides).where("text is not null").distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= BLOCK_CHARS:
            yield tuple(sorted(block))
            block, size = [], 0
    if block:
        yield tuple(sorted(block))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): one cell's source, or one output, holds 12 consecutive words of the item's prompt or answer.

    Documents without text or id and items without prompt and answer have no rows; passages of fewer words leak
    nothing; repeated documents and items give one row per pair of ids; texts of any length are read whole.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "export_form")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, part) for doc, text, form in zip(pdf["doc_id"], pdf["text"], pdf["export_form"]) for _, part in segments(text, form)]
            yield pd.DataFrame(rows, columns=["doc_id", "part"])

    def searched(block: tuple, parsed: DataFrame | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(shared.value)
            for pdf in batches:
                if "part" not in pdf:
                    pdf = next(parse(iter([pdf])))
                rows = [(doc, item) for doc, part in zip(pdf["doc_id"], pdf["part"]) for item in index.leaks(part)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        return (texts if parsed is None else parsed).mapInPandas(scan, "doc_id long, item_id long")

    blocks = passage_blocks(items)
    one, two = next(blocks, None), next(blocks, None)
    if one is None:
        return spark.createDataFrame([], "doc_id long, item_id long")
    parsed = None if two is None else materialise(texts.mapInPandas(parse, "doc_id long, part string"), "segments")  # several scans parse once
    found = searched(one, parsed)
    for block in ([] if two is None else [two, *blocks]):
        found = found.unionByName(searched(block, parsed))
    return found.distinct()
