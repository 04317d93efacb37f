"""Variant spellings of names typed by people.

A company is known by distinctive words (the first word of its name in either script, nicknames, codes) and by common
words (its line of business and qualifiers, which many companies share). Distinctive words are found through a
symmetric-delete index: a word and every string left after deleting up to two of its letters are looked up, so small
edit distances meet without comparing all pairs. What else the query says is aligned with the company's common words by
optimal assignment, with typos, initials and abbreviations at a cost; a word that cannot be placed rules a company out.

Both scripts are compared in Latin letters: Hangul is romanised letter by letter, and common words are translated by
the longest suffix that the Hangul forms of companies with the same Latin word share.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordweave.functions.names import LEGAL_WORDS
from recordweave.operators.skew import salted_join
from recordweave.runtime import materialise, ship

#: Words in at least this share of companies are common words, so there are few of them.
COMMON_SHARE = 0.004
MAX_EDITS = 2
#: Words longer than this are indexed by the deletions of their ends.
LONG_WORD = 40
#: Bits of the presence filter of index keys, at most; 8 MB.
FILTER_BITS = 1 << 26
#: Two companies whose costs are nearer than this are told apart by nothing.
CLEAR = 0.05
MISSPELT = 0.2
#: The longest Hangul word, in syllables, that is looked at as a translation of a common word.
MAX_TRANSLATION = 16

# Spelt-out legal forms beside LEGAL_WORDS, words for groups, and the letters of romanised Hangul in Unicode order.
SPELT_LEGAL = ["company limited", "incorporated", "limited"]
GROUP_WORDS = ["group", "그룹", "holdings", "the"]
LEADS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
TAILS = ["", "k", "k", "ks", "n", "nj", "nh", "t", "l", "lk", "lm", "lb", "ls", "lt", "lp", "lh", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "h"]

_LATIN_LEGAL = sorted({tuple(re.findall("[a-z]+", w)) for w in [*LEGAL_WORDS, *SPELT_LEGAL] if w[0].isascii() and w[0].isalpha()}, key=lambda ws: (-len(ws), -len("".join(ws)), ws))
_LEGAL_WORD = re.compile(r"(?<![a-z0-9])(?:" + "|".join(r"[\s.,]*".join(ws) for ws in _LATIN_LEGAL) + r")(?![a-z0-9])\.?")
_OTHER_LEGAL = [unicodedata.normalize("NFKC", w) for w in LEGAL_WORDS if not (w[0].isascii() and w[0].isalpha())]
_NUMBER = re.compile(r"(?<!\d)(?:\d[\s-]?){9}\d(?!\d)")
_HANGUL = re.compile(r"[가-힣]+")
_PIECE = re.compile(r"[가-힣]+|[a-z]+\d+|[a-z]+|\d+")
_SPACED = re.compile(r"(?<![^ ])[a-z](?: [a-z](?![^ ])){2,}")


def romanised(text: str) -> str:
    out = []
    for ch in text:
        k = ord(ch) - 0xAC00
        out.append(LEADS[k // 588] + VOWELS[k % 588 // 28] + TAILS[k % 28] if 0 <= k < 11172 else ch)
    return "".join(out)


def folded(text: str) -> str:
    """Compatibility form without legal forms, lower-cased; words that were only set apart by capitals are parted."""
    s = unicodedata.normalize("NFKC", text)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s).lower()
    for form in _OTHER_LEGAL:
        s = s.replace(form, " ")
    return _LEGAL_WORD.sub(" ", s)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; ``most + 1`` if it is higher. Only cells within ``most`` of the
    diagonal are filled, so long words cost their length."""
    if a == b:
        return 0
    n, far = len(b), most + 1
    if abs(len(a) - n) > most:
        return far
    old: dict[int, int] = {}
    row = {j: j for j in range(min(n, most) + 1)}
    for i, x in enumerate(a, 1):
        older, old, row = old, row, {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            d = i if j == 0 else min(old.get(j, far) + 1, row.get(j - 1, far) + 1, old.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older.get(j - 2, far) + 1)
            row[j] = min(d, far)
        if min(row.values()) > most:
            return far
    return row[n]


def deletions(word: str, edits: int = MAX_EDITS) -> set[str]:
    """The word and what is left of it after up to ``edits`` deletions; at least one letter stays."""
    found = edge = {word}
    for _ in range(min(edits, len(word) - 1)):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found = found | edge
    return found


def allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def later_words(forms: list[str]) -> set[str]:
    """The Latin words after the first of a company's folded forms."""
    return {w for f in forms if not _HANGUL.search(f) for w in re.findall(r"[a-z]+", f)[1:]}


def is_common(word: str, n: int, companies: int) -> bool:
    return n >= max(2, COMMON_SHARE * companies) and len(word) > 2 and word not in GROUP_WORDS


def both_scripts(forms: list[str], common: set[str]) -> tuple[list[str], str] | None:
    """(common Latin words, Hangul form) of a company whose folded forms have both."""
    latin = next((ws for f in forms if not _HANGUL.search(f) and len(ws := re.findall(r"[a-z]+", f)) > 1), None)
    local = next((x for f in forms if (x := "".join(_HANGUL.findall(f))) and not re.search(r"[a-z]", f)), None)
    return ([w for w in latin[1:] if w in common], local) if latin and local else None


def without_last(pair: tuple[list[str], str], hangul: dict[str, str]) -> tuple[list[str], str] | None:
    """The pair without its last word, where the Hangul form ends with what that word is called."""
    words, local = pair
    end = next((h for h in sorted(hangul, key=len, reverse=True) if hangul[h] == words[-1] and local.endswith(h)), None) if words else None
    return (words[:-1], local[: -len(end)]) if end else None


def suffixes(pair: tuple[list[str], str]) -> list[tuple[str, str]]:
    """(last word, suffix) for every suffix of the Hangul form but itself, of up to MAX_TRANSLATION syllables."""
    words, local = pair
    return [(words[-1], local[i:]) for i in range(max(1, len(local) - MAX_TRANSLATION), len(local))] if words else []


def translated(hangul: dict[str, str], best: list[tuple[str, str, int]]) -> dict[str, str]:
    """``hangul`` with the best (word, suffix, companies) added; of two words for one suffix the more frequent holds."""
    return {s: w for w, s, _ in sorted(best, key=lambda b: (b[2], b[0]))} | hangul


class Vocabulary:
    """Common words (Latin) and the Hangul words that mean them."""

    def __init__(self, forms: list[list[str]]) -> None:
        """forms: per company its name and aliases, as typed. ``learned`` does the same for a table."""
        split = [[folded(f) for f in fs] for fs in forms]
        seen = Counter(w for fs in split for w in later_words(fs))
        common = {w for w, n in seen.items() if is_common(w, n, len(forms))}
        hangul: dict[str, str] = {}
        pairs = [p for fs in split if (p := both_scripts(fs, common))]
        for _ in range(2):  # last words, then the qualifiers before them
            counts: dict[str, Counter[str]] = defaultdict(Counter)
            for w, s in (x for p in pairs for x in suffixes(p)):
                counts[w][s] += 1
            tops = {w: max(c.values()) for w, c in counts.items()}
            best = [(w, *max(((s, n) for s, n in c.items() if n >= 0.8 * tops[w]), key=lambda x: (len(x[0]), x[1], x[0]))) for w, c in counts.items() if tops[w] >= 2]
            hangul = translated(hangul, best)
            pairs = [r for p in pairs if (r := without_last(p, hangul))]
        self._set(common, hangul)

    def _set(self, common: set[str], hangul: dict[str, str]) -> None:
        self.common, self.hangul = common, hangul
        self.by_length = sorted(hangul, key=len, reverse=True)

    @classmethod
    def of(cls, common: tuple[str, ...], hangul: tuple[tuple[str, str], ...]) -> Vocabulary:
        made = cls.__new__(cls)
        made._set(set(common), dict(hangul))
        return made

    def cut(self, local: str) -> tuple[str, list[str]]:
        """Hangul run -> (what is left in front, common words at its end)."""
        found: list[str] = []
        while local and (hit := self._ending(local, not found)):
            found.insert(0, hit[1])
            local = local[: -hit[0]]
        return local, found

    def _ending(self, local: str, last: bool) -> tuple[int, str] | None:
        """(length, common word) of the end of a Hangul run: in full, else with a typo or shortened to its beginning
        (only the last word of a name is shortened or misspelt in a way that hides where it begins)."""
        if hit := next((h for h in self.by_length if local.endswith(h)), None):
            return len(hit), self.hangul[hit]
        if not last:
            return None
        for h in self.by_length:
            if len(h) > 2 and len(local) >= len(h):
                spelt = romanised(h)
                if any(distance(romanised(local[-n:]), spelt, 1 + (len(h) > 3)) <= 1 + (len(h) > 3) for n in (len(h), len(h) - 1, len(h) + 1) if len(local) > n):
                    return len(h), self.hangul[h]
        for h in self.by_length:
            for n in range(len(h) - 1, 1, -1):
                if (len(local) == n or len(local) > n + 1) and local.endswith(h[:n]):
                    return n, self.hangul[h]
        return None

    def pieces(self, text: str) -> list[list[str]]:
        """Per part of the text (outside and inside brackets) its words in Latin letters; common words in Hangul are
        translated, everything else is romanised."""
        parts = []
        inner = re.findall(r"\(([^()]*)\)", text)
        for part in [re.sub(r"\([^()]*\)", " ", text), *inner]:
            words: list[str] = []
            for piece in _PIECE.findall(part):
                if piece in GROUP_WORDS:
                    continue
                if _HANGUL.fullmatch(piece):
                    front, common = self.cut(piece)
                    words += ([romanised(front)] if front else []) + common
                else:
                    words.append(piece)
            if words:
                parts.append(words)
        return parts


def likeness(said: str, word: str) -> float | None:
    """Cost of reading ``said`` as ``word``: equal, one or two edits, an initial, a beginning or a shortening
    (letters in order from the first); None if it is none of these."""
    if said == word:
        return 0.0
    if len(said) < len(word) and word.startswith(said):
        return 0.3 if len(said) == 1 else 0.15
    if (d := distance(said, word, 1 if len(word) < 6 else 2)) <= (1 if len(word) < 6 else 2) and len(said) > 2:
        return 0.4 * d
    if 1 < len(said) < len(word) and said[0] == word[0]:
        at = iter(word)
        if all(ch in at for ch in said):
            return 0.25
    if len(said) > 2 and said[0] == word[0] and min(distance(said, word[:k], 1) for k in range(2, len(word))) <= 1:
        return 0.6
    return None


def assigned(said: list[str], words: tuple[str, ...]) -> float | None:
    """Least total cost of giving each said word a different word of the company; None if one cannot be placed."""
    if len(said) > len(words):
        return None
    best: dict[int, float] = {0: 0.0}
    for s in said:
        step: dict[int, float] = {}
        for used, cost in best.items():
            for i, w in enumerate(words):
                if not used >> i & 1 and (c := likeness(s, w)) is not None:
                    key = used | 1 << i
                    if cost + c < step.get(key, 1e9):
                        step[key] = cost + c
        best = step
        if not best:
            return None
    used, cost = min(best.items(), key=lambda x: (x[1], -x[0]))
    return cost


def readings(rest: str, words: tuple[str, ...]) -> float | None:
    """Least cost of a glued remainder as one or two of the company's common words."""
    if len(rest) > 2 * max(map(len, words), default=0) + 4:
        return None
    options = [c for w in words if (c := likeness(rest, w)) is not None]
    for k in range(1, len(rest)):
        if (c := assigned([rest[:k], rest[k:]], words)) is not None:
            options.append(c)
    return min(options, default=None)


def edits_for(word: str) -> int:
    return 1 if re.search(r"\d", word) else allowed(word)


def neighbourhood(word: str, edits: int) -> set[str]:
    """The strings under which a word is indexed and looked up. Two words of any length within ``edits`` (at most two)
    of each other share one: short words by what is left after deletions; of long ones, whose deletions grow with the
    square of the length, two edits leave at least one end with no more than one."""
    found = deletions(word, edits) if len(word) <= LONG_WORD + MAX_EDITS else set()
    if len(word) > LONG_WORD - MAX_EDITS:
        found |= {f"<{d}" for d in deletions(word[: LONG_WORD // 2])} | {f"{d}>" for d in deletions(word[-(LONG_WORD // 2) :])}
    return found


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1  # fits a long


class Reader:
    """Reads queries with a vocabulary; ``most`` and ``longest`` are the number and the length of common words that
    any company has, ``top`` the length of its longest distinctive word; they bound how a query can be cut without losing a reading."""

    def __init__(self, common: tuple[str, ...], hangul: tuple[tuple[str, str], ...], most: int, longest: int, top: int) -> None:
        self.vocabulary, self.most, self.longest, self.top = Vocabulary.of(common, hangul), most, longest, top + MAX_EDITS

    def described(self, forms: list[str]) -> tuple[list[str], list[str]]:
        """(distinctive words, common words) of a company: the first words of all its forms, the longest list of common words."""
        common: list[str] = []
        firsts: set[str] = set()
        for form in forms:
            for words in self.vocabulary.pieces(folded(form))[:1]:
                own = [w for w in words if w not in self.vocabulary.common]
                mine = [w for w in words if w in self.vocabulary.common]
                common = max(common, mine, key=len)
                firsts.add("".join(own) if own else words[0])
        return sorted(firsts), list(dict.fromkeys(common))

    def tries(self, words: list[str]) -> dict[tuple[str, str], list[str]]:
        """(head, rest of its word) -> other words, for every way in which a head can be the distinctive word: a word or
        its beginning, or the first words joined. Ways that leave more than a company's common words can take are left out."""
        found: dict[tuple[str, str], list[str]] = {}
        if len(words) - 1 <= self.most:
            for i, w in enumerate(words):
                others = words[:i] + words[i + 1 :]
                if len(w) <= self.top:
                    found.setdefault((w, ""), others)
                for k in range(min(len(w) - 1, self.top), max(1, len(w) - 2 * self.longest - 5), -1):
                    found.setdefault((w[:k], w[k:]), others)
        for i in range(max(2, len(words) - self.most), len(words) + 1):
            if len(head := "".join(words[:i])) <= self.top:
                found.setdefault((head, ""), words[i:])
        spelt = _SPACED.sub(lambda m: m[0].replace(" ", ""), " ".join(words)).split()  # letters set apart by blanks
        return found if len(spelt) == len(words) else self.tries(spelt) | found

    @lru_cache(maxsize=4_096)
    def parts(self, query: str) -> list[tuple[list[str], int, dict[tuple[str, str], list[str]]]]:
        return [(words, sum(map(len, words)), self.tries(words)) for words in self.vocabulary.pieces(folded(query))]

    def probes(self, query: str) -> set[int]:
        heads = {head for _, _, tries in self.parts(query) for head, _ in tries}
        return {hashed(s) for h in heads for s in neighbourhood(h, 0 if len(h) < 3 else edits_for(h) or 1)}

    def reading(self, part: tuple, firsts: list[str], common: tuple[str, ...]) -> float | None:
        """Least cost of reading a part of a query as a company's name."""
        _, letters, tries = part
        best = None
        for (head, rest), others in tries.items():
            for w in firsts:
                if abs(len(w) - len(head)) > MAX_EDITS:
                    continue
                code = bool(re.search(r"\d", head))
                most = 1 if code else min(allowed(w), allowed(head) or 1)
                if bool(re.search(r"\d", w)) != code or (d := distance(head, w, most)) > most or d and (len(head) < 3 or rest and len(head) < 5):
                    continue
                cost = explained(rest, others, common)
                if cost is not None:
                    cost += d + 0.02 * (letters - len(head) - len(rest) > 0) + 0.05 * bool(rest)
                    best = cost if best is None else min(best, cost)
        return best

    def support(self, part: tuple, firsts: list[str], common: tuple[str, ...]) -> float | None:
        """Cost of a part beside one that names the company: nothing if it is common words alone, MISSPELT if it has a first
        word with more typos than a reading would allow; None if it speaks against the company."""
        words = part[0]
        if assigned(words, common) is not None:
            return 0.0
        own = "".join(w for w in words if w not in self.vocabulary.common)
        near = own and assigned([w for w in words if w in self.vocabulary.common], common) is not None and any(distance(own, w, 3) <= 3 for w in firsts)
        return MISSPELT if near else None

    def score(self, query: str, firsts: list[str], common: tuple[str, ...]) -> tuple[float | None, bool]:
        """(cost of the best reading and of what stands beside it, whether every part is a reading or supported)."""
        parts = self.parts(query)
        costs = [self.reading(p, firsts, common) for p in parts]
        cost = min((c for c in costs if c is not None), default=None)
        if cost is None or len(parts) == 1:
            return cost, True
        beside = [self.support(p, firsts, common) for p, c in zip(parts, costs) if c is None]
        return cost + sum(b or 0.0 for b in beside), None not in beside


def explained(rest: str, others: list[str], own: tuple[str, ...]) -> float | None:
    """Least cost of what a reading leaves beside the distinctive word: the rest of its word and the other words."""
    if rest:
        if others:
            costs = [assigned([rest, *others], own)]
            costs += [assigned([rest[:k], rest[k:], *others], own) for k in range(1, len(rest))] if len(own) > len(others) + 1 else []
            cost = min((c for c in costs if c is not None), default=None)
        else:
            cost = readings(rest, own)
    else:
        cost = assigned(others, own)
        if cost is None and len(others) == 1:
            cost = readings(others[0], own)
    if cost is None:
        return None
    said = len(others) + bool(rest)
    return cost + 0.1 * max(0, len(own) - said) + (0.3 if not said and own else 0)


def number_in(query: str) -> str | None:
    """The ten digits of a business number in a query."""
    m = _NUMBER.search(unicodedata.normalize("NFKC", query))
    return re.sub(r"\D", "", m[0]) if m else None


def learned(companies: DataFrame) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """The common words and their (Hangul, Latin) translations, counted over all companies. Only common words, whose
    number the least share bounds, and one suffix for each come to the driver."""
    rows = companies.where("name is not null or aliases is not null").select("name", "aliases")
    total = rows.count()

    def forms(pdf: pd.DataFrame) -> list[list[str]]:
        return [[folded(f) for f in (name, *(aliases if aliases is not None else [])) if f] for name, aliases in zip(pdf["name"], pdf["aliases"])]

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(Counter(w for fs in forms(pdf) for w in later_words(fs)).items(), columns=["word", "n"])

    seen = rows.mapInPandas(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, COMMON_SHARE * total)).collect()
    common = {r.word for r in seen if is_common(r.word, r.n, total)}
    hangul: dict[str, str] = {}
    for last in (True, False):  # last words, then the qualifiers before them

        def endings(batches: Iterator[pd.DataFrame], known: dict[str, str] = hangul, last: bool = last) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pairs = [p for fs in forms(pdf) if (p := both_scripts(fs, common))]
                if not last:
                    pairs = [r for p in pairs if (r := without_last(p, known))]
                found = Counter(x for p in pairs for x in suffixes(p))
                yield pd.DataFrame([(*x, n) for x, n in found.items()], columns=["word", "suffix", "n"])

        counts = rows.mapInPandas(endings, "word string, suffix string, n long").groupBy("word", "suffix").agg(F.sum("n").alias("n"))
        tops = counts.groupBy("word").agg(F.max("n").alias("top")).where("top >= 2")
        best = counts.join(F.broadcast(tops), "word").where(F.col("n") >= 0.8 * F.col("top")).groupBy("word").agg(F.max(F.struct(F.length("suffix").alias("size"), "n", "suffix")).alias("b"))
        hangul = translated(hangul, [(r.word, r.b.suffix, r.b.n) for r in best.collect()])
    return tuple(sorted(common)), tuple(sorted(hangul.items()))


def described_companies(companies: DataFrame, common: tuple, hangul: tuple) -> DataFrame:
    """id, digits (of a ten-digit business number, else null), firsts, common: one row per company. Of rows with one id,
    one counts, with a name if there is one; a row without a name has its aliases and number."""
    row = F.struct("name", "aliases", "business_number")
    first = F.struct(F.isnull("name"), F.isnull("aliases"), F.isnull("business_number"), "name", "aliases", "business_number")
    rows = companies.where("id is not null").groupBy("id").agg(F.min_by(row, first).alias("r")).select(F.col("id").cast("string").alias("id"), "r.*")
    forms = F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda f: f.isNotNull() & (f != ""))
    digits = F.regexp_replace("business_number", r"\D", "")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(common, hangul, 0, 0, 0)
        for pdf in batches:
            both = [reader.described(list(forms)) for forms in pdf["forms"]]
            yield pd.DataFrame({"id": pdf["id"], "digits": pdf["digits"], "firsts": [b[0] for b in both], "common": [b[1] for b in both]})

    slim = rows.select("id", F.when(F.length(digits) == 10, digits).alias("digits"), forms.alias("forms"))
    return materialise(slim.mapInPandas(describe, "id string, digits string, firsts array<string>, common array<string>"), "companies")


def presence(keys: DataFrame, n: int) -> bytes:
    """One bit per slot that a key of the index falls on, at most FILTER_BITS; what it lets through is joined exactly."""
    size = 1 << 15
    while size < min(FILTER_BITS, 16 * n):
        size *= 2
    slots = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("s"))
    # bit positions count from 0 in every bucket of 32,768
    parts = slots.groupBy((F.col("s") / (1 << 15)).cast("long").alias("b")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect()
    bits = bytearray(size // 8)
    for p in parts:
        bits[p.b * 4096 : (p.b + 1) * 4096] = p.bits
    return bytes(bits)


def resolve(queries: DataFrame, companies: DataFrame) -> DataFrame:
    """(query_id, company_id): the company each query means; a query that means none has no row.

    A full business number decides alone, else the name does. Null and empty queries mean none; a repeated query id
    gives one row; queries that fit two companies equally well mean none.

    Both sides meet by equi-joins: a query on the hashes of its heads' neighbourhoods, a company on those of its
    distinctive words. Companies with one distinctive word and the same common words are one class, as no single part
    of a query tells them apart, so a first word that many companies share costs a query its classes, not its companies.
    """
    spark = queries.sparkSession
    ship(spark)
    common, hangul = learned(companies)
    firms = described_companies(companies, common, hangul)
    by_word = firms.select("id", "firsts", "common", F.explode("firsts").alias("w")).where("w <> ''")
    classes = by_word.groupBy("w", "common").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min_by("firsts", "id").alias("firsts"))
    sizes = firms.agg(F.max(F.size("common")).alias("most"), F.max(F.coalesce(F.array_max(F.transform("common", F.length)), F.lit(0))).alias("longest"), F.max(F.array_max(F.transform("firsts", F.length))).alias("top")).first()
    reader = (common, hangul, sizes.most or 0, sizes.longest or 0, sizes.top or 0)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(hashed(s), w) for w in pdf["w"] for s in neighbourhood(w, edits_for(w))], columns=["key", "w"])

    index = materialise(by_word.select("w").distinct().mapInPandas(spread, "key long, w string"), "names")
    bits = spark.sparkContext.broadcast(presence(index, index.count()))  # at most FILTER_BITS

    asked = queries.where("query_id is not null and trim(query) <> ''").select(F.col("query_id").cast("long").alias("query_id"), F.md5("query").alias("q"), "query")
    # equal texts are read once, and joins carry digests; reading costs more than bytes tell, so the number of tasks is given
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = asked.repartition(tasks, "q").groupBy("q").agg(F.first("query").alias("query"))
    asked = asked.select("query_id", "q")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told, there = _reader(*reader), bits.value
        mask = 8 * len(there) - 1
        for pdf in batches:
            rows = []
            for q, query in zip(pdf["q"], pdf["query"]):
                if number := number_in(query):
                    rows.append((q, number, 0))
                else:
                    rows += [(q, None, k) for k in told.probes(query) if there[(s := k & mask) >> 3] >> (s & 7) & 1]
            yield pd.DataFrame(rows, columns=["q", "digits", "key"])

    probes = materialise(texts.mapInPandas(look, "q string, digits string, key long"), "probes")
    near = materialise(salted_join(probes.where("digits is null").select("q", "key"), index, ["key"]).select("q", "w").distinct(), "near")
    pairs = salted_join(near, classes, ["w"]).join(texts, "q")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = _reader(*reader)
        for pdf in batches:
            rows = []
            for q, query, w, own, low, high, firsts in zip(pdf["q"], pdf["query"], pdf["w"], pdf["common"], pdf["low"], pdf["high"], pdf["firsts"]):
                cost, whole = told.score(query, list(firsts) if low == high else [w], tuple(own))
                if cost is not None:
                    rows.append((q, w, list(own), low, high, cost, whole))
            yield pd.DataFrame(rows, columns=["q", "w", "common", "low", "high", "cost", "whole"])

    weighed = materialise(pairs.mapInPandas(weigh, "q string, w string, common array<string>, low string, high string, cost double, whole boolean"), "weighed")
    named = weighed.where("whole").select("q", F.explode(F.array_distinct(F.array("low", "high"))).alias("id"), "cost")
    # what one part leaves open between the companies of a class another part may tell
    several = weighed.where("not whole and low <> high").select("q", "w", "common").join(by_word, ["w", "common"]).select("q", "id", "firsts", "common").distinct().join(texts, "q")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = _reader(*reader)
        for pdf in batches:
            scores = [told.score(query, list(f), tuple(c)) for query, f, c in zip(pdf["query"], pdf["firsts"], pdf["common"])]
            yield pd.DataFrame([(q, i, s[0]) for q, i, s in zip(pdf["q"], pdf["id"], scores) if s[0] is not None and s[1]], columns=["q", "id", "cost"])

    numbers = firms.where("digits is not null").groupBy("digits").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    by_number = probes.where("digits is not null").select("q", "digits").join(numbers, "digits")
    named = named.unionByName(several.mapInPandas(tell, "q string, id string, cost double"))
    named = named.unionByName(by_number.select("q", F.explode(F.array_distinct(F.array("low", "high"))).alias("id"), F.lit(-1.0).alias("cost")))

    least = named.groupBy("q", "id").agg(F.min("cost").alias("cost"))
    two = least.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("cost", "id"))).where("k <= 2")
    meant = two.groupBy("q").agg(F.min_by("id", "k").alias("company_id"), F.min("cost").alias("a"), F.max("cost").alias("b"), F.max("k").alias("n"))
    meant = meant.where((F.col("n") == 1) | (F.col("b") - F.col("a") >= CLEAR)).select("q", "company_id")
    return salted_join(asked, meant, ["q"]).select("query_id", "company_id").distinct()


@lru_cache(maxsize=2)
def _reader(*told: object) -> Reader:
    return Reader(*told)
