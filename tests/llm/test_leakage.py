import random
import re

import numpy as np

from recordweave.llm import leakage
from recordweave.llm.cells import segments
from recordweave.llm.leakage import PassageIndex, leaks

DOCS = "doc_id long, text string, export_form string"
ITEMS = "item_id long, suite string, prompt string, answer string"
WORDS = "river stone cloud paper window garden silver number basket market forest winter candle bridge copper mirror pocket rocket saddle timber velvet walnut yellow zigzag ab c de 12 7".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(docs, items):
    runs = {}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    for item, _, *sides in items:
        for side in sides:
            w = words(side or "")
            for i in range(len(w) - 11):
                runs.setdefault(tuple(w[i : i + 12]), set()).add(item)
    out = set()
    for doc, t, form in docs:
        for _, part in segments(t, form):
            w = words(part)
            for i in range(len(w) - 11):
                out |= {(doc, item) for item in runs.get(tuple(w[i : i + 12]), ())}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(i, "s", sentence(rng, rng.choice([5, 12, 30, 60])), rng.choice([None, sentence(rng, 20)])) for i in range(40)]
    items += [(90, "s", items[3][2], None), (91, "s", None, None), (92, "s", "", "")]
    docs = []
    for d in range(120):
        parts = [sentence(rng, rng.randint(1, 40)) for _ in range(3)]
        source = rng.choice([i for i in items if i[2]])[2].split()
        a = rng.randint(0, max(0, len(source) - 8))
        piece = source[a : a + rng.choice([8, 11, 12, 13, 25])]
        how = rng.choice(["plain", "upper", "marks", "typo", "gap"])
        if how == "typo" and piece:
            piece[len(piece) // 2] = "typo"
        if how == "gap" and piece:
            piece.insert(len(piece) // 2, "extra")
        said = {"upper": str.upper, "marks": lambda s: s.replace(" ", ",_\n**")}.get(how, str)(" ".join(piece))
        parts.insert(rng.randint(0, 3), f"{sentence(rng, 2)} {said} {sentence(rng, 2)}" if rng.random() < 0.7 else said)
        docs.append((d, "\n\n".join(parts), "fenced"))
    docs += [(500, None, "fenced"), (501, "", None), (None, "x", "fenced"), docs[0], (502, "# %% [markdown]\n# " + items[3][2] + " é", "percent")]
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS item_id", "2 AS n"), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute([d for d in docs if d[0] is not None and d[1]], items)
    assert got == want and len(want) > 30


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, "s", sentence(rng, 30), None) for i in range(6)]
    docs = spark.createDataFrame([(i, items[i][2], "fenced") for i in range(6)], DOCS)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 200)
    assert {tuple(r) for r in leaks(docs, spark.createDataFrame(items, ITEMS)).collect()} == {(i, i) for i in range(6)}


def test_passage_over_two_cells_is_no_leak():
    rng = random.Random(7)
    passage = [rng.choice(WORDS[:20]) for _ in range(22)]
    index = PassageIndex(((1, " ".join(passage)),))
    assert index.leaks(" ".join(passage[:12])) == {1}
    assert index.leaks(" ".join(passage[:11])) == set()


def test_tails_of_long_passages_and_segments(spark):
    rng = random.Random(13)
    many = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(180_000)]  # a passage of two million characters
    passage = " ".join(many)
    assert len(passage) > 2_000_000
    items = spark.createDataFrame([(1, "s", passage, None), (2, "s", sentence(rng, 30), None)], ITEMS)
    padding = " ".join(f"pad{k}" for k in range(250_000))  # a segment of over two million characters
    cut = {1: many[:40], 2: many[-40:], 3: many[90_000:90_012], 4: many[-11:], 5: many[-12:]}
    docs = [(k, " ".join(w), "fenced") for k, w in cut.items()] + [(10, f"{padding} {' '.join(many[-30:])}", "fenced"), (11, f"{' '.join(many[-30:])} {padding}", "fenced"), (12, passage, "fenced")]
    assert sorted(tuple(r) for r in leaks(spark.createDataFrame(docs, DOCS), items).collect()) == [(k, 1) for k in (1, 2, 3, 5, 10, 11, 12)]


def test_pieces_keep_every_run():
    rng = random.Random(17)
    passage = [f"w{rng.randrange(10**4)}" for _ in range(12)]
    index = PassageIndex(((1, " ".join(passage)),))
    for size in (60, 90, 200):
        for k in range(0, 60, 7):
            line = leakage.words_line(" ".join([*(f"x{i}" for i in range(k)), *passage, *(f"y{i}" for i in range(50))])).encode()
            cut = list(leakage.pieces(line, size, index.longest + leakage.Q))
            assert sum(leakage.words_line(" ".join(passage)).encode() in p for p in cut) >= 1 and all(p[:1] == p[-1:] == b" " for p in cut)


def test_repetitive_passages_and_texts():
    index = PassageIndex(((1, "tick tock " * 5_000), (2, "tick tock " * 6), (3, "a b " * 40)))
    assert index.leaks("tick tock " * 20_000) == {1, 2}
    assert index.leaks("b a b a b a b a b a b a") == {3} and index.leaks("b a b a b a b a b a b") == set()
    assert len(index.gram) < 5_000


def test_a_phrase_that_all_passages_share():
    rng = random.Random(19)
    shared = "you may assume at most three rows per table and"  # ten words, no leak
    items = [(i, "s", f"{sentence(rng, 9)} {shared} {sentence(rng, 9)}", None) for i in range(400)]
    index = PassageIndex(tuple((i, p) for i, _, p, _ in items))
    said = items[7][2].split()
    for text in (f"{shared} " * 50, " ".join([*said[4:24], *shared.split()]), " ".join([*said[:8], "else", *said[8:]])):
        assert {(0, i) for i in index.leaks(text)} == brute([(0, text, "fenced")], items)


def test_alignment_goes_over_edits():
    index = PassageIndex(((1, "abcdefgh ijklmnop qrstuvwx yz012345 " * 4),), words=2, edits=1)
    line = b" abcdefgh ijklXmnop qrstuvwx "
    stretches = index.aligned(np.frombuffer(line, np.uint8), 0, 0, 1)
    assert stretches[0] == (0, 14) and stretches[1] == (15, 29)


def test_long_text_and_empty_tables(spark):
    rng = random.Random(9)
    passage = sentence(rng, 40)
    long = "value 0.123 " * 200_000 + passage + " tail" * 50_000
    docs = spark.createDataFrame([(1, long, "fenced")], DOCS)
    items = spark.createDataFrame([(5, "s", passage, None)], ITEMS)
    assert [tuple(r) for r in leaks(docs, items).collect()] == [(1, 5)]
    assert leaks(docs.limit(0), items).count() == leaks(docs, items.limit(0)).count() == 0
