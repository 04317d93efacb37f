import random

import pytest

from recordweave.llm import names
from recordweave.operators import skew
from recordweave.llm.names import Reader, Vocabulary, allowed, assigned, deletions, distance, edits_for, likeness, neighbourhood, number_in, resolve

TRADES = {"Energy": "에너지", "Games": "게임즈", "Optics": "광학", "Logistics": "로지스틱스"}
EXTRA = {"Green": "그린", "Future": "미래"}
FIRSTS = {"Haengaengde": "행앵데", "Tubochi": "투보치", "Myoltenbe": "묠텐베", "Gekinkon": "게킨콘", "Saengtal": "생탈", "Jumekum": "주메쿰", "Beoriseo": "버리서", "Nobingho": "노빙호", "Paeopo": "패오포", "Dinderen": "딘데렌", "Kilsyonpo": "킬숀포", "Rudolmae": "루돌매"}


@pytest.fixture(scope="module")
def firms():
    rows = []
    for i, (latin, local) in enumerate(FIRSTS.items()):
        trade = list(TRADES)[i % 4]
        extra = list(EXTRA)[i % 2] if i % 3 == 0 else None
        full = " ".join(x for x in (latin, extra, trade) if x)
        glued = local + (EXTRA[extra] if extra else "") + TRADES[trade]
        rows.append((f"c{i}", f"{full} Inc.", (glued,), f"{100 + i}-45-67890") if i % 2 == 0 else (f"c{i}", f"(주){glued}", (full, f"Nick{chr(97 + i) * 2}x"), ""))
    return rows


class ByHand:
    """Every company scored for every query."""

    def __init__(self, firms):
        v = Vocabulary([[f for f in (n, *a) if f] for _, n, a, _ in firms])
        self.reader = Reader(tuple(sorted(v.common)), tuple(sorted(v.hangul.items())), 9, 20, 60)
        self.firms = [(i, *self.reader.described([f for f in (n, *a) if f]), "".join(c for c in b or "" if c.isdigit())) for i, n, a, b in firms]

    def meant(self, query):
        if number := number_in(query):
            ids = sorted({i for i, _, _, digits in self.firms if digits == number})
            return ids[0] if len(ids) == 1 else ""
        scores = [(*self.reader.score(query, firsts, tuple(common)), i) for i, firsts, common, _ in self.firms]
        best = sorted((cost, i) for cost, whole, i in scores if cost is not None and whole)
        return best[0][1] if best and (len(best) == 1 or best[1][0] - best[0][0] >= names.CLEAR) else ""


@pytest.fixture(scope="module")
def index(firms):
    return ByHand(firms)


def meant(index, query):
    return index.meant(query)


def table_of(spark, firms):
    return spark.createDataFrame([(i, n, list(a), b) for i, n, a, b in firms], "id string, name string, aliases array<string>, business_number string")


def resolved(spark, firms, queries):
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    found = {r.query_id: r.company_id for r in resolve(asked, table_of(spark, firms)).collect()}
    return [found.get(k, "") for k in range(len(queries))]


@pytest.mark.parametrize(
    ("query", "company"),
    [
        ("Haengaengde Green Energy", "c0"), ("HAENGAENGDE ENERGY, INC", "c0"), ("green energy, haengaebgde", "c0"), ("HaengaengdeG.Energy Company", "c0"), ("haengaengdegreeenrgy", "c0"),
        ("행앵데그린에너지㈜", "c0"), ("행애데Energy", "c0"), ("에너지 행앵데", "c0"), ("행앵데 그린 에너지(Haengaengde Energy)", "c0"), ("Ｈａｅｎｇａｅｎｇｄｅ", "c0"),
        ("Tubochi Gms.", "c1"), ("투보치 게임즈", "c1"), ("Nickbbx", "c1"), ("Nickbbx Games", "c1"), ("Myoltenbe", "c2"), ("Saengtal Engery", "c4"), ("something (100-45-67890)", "c0"),
        ("Haengaengde Optics", ""), ("행앵데광학", ""), ("Unknownword Energy", ""), ("Energy", ""), ("9999999999", ""), ("9999999999 Haengaengde Energy", ""), ("", ""), ("()", ""), ("!!!", ""),
    ],
)
def test_spellings(index, query, company):
    assert meant(index, query) == company


def test_symmetric_deletions_find_what_edit_distance_allows():
    rng = random.Random(4)
    for size in (3, 4, 5, 7, 12, 37, 39, 41, 43, 90):
        for _ in range(60):
            word = "".join(rng.choices("abcd", k=size))
            said = list(word)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(said))
                rng.choice([lambda: said.pop(k), lambda: said.insert(k, "q"), lambda: said.__setitem__(k, "q"), lambda: said.insert(k, said.pop())])()
            said = "".join(said) or "a"
            most = min(allowed(word), allowed(said) or 1)
            meets = bool(neighbourhood(word, edits_for(word)) & neighbourhood(said, edits_for(said) or 1))
            assert meets or distance(word, said, most) > most


def plain_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance():
    rng = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(2))
        for most in (0, 1, 2, 3):
            assert distance(a, b, most) == min(plain_distance(a, b), most + 1), (a, b, most)
    assert distance("x" * 200_000 + "ab", "x" * 200_000 + "ba", 2) == 1


def test_pieces():
    assert distance("abcd", "abdc", 2) == 1 and distance("abc", "xyz", 2) == 3
    assert deletions("ab") == {"ab", "a", "b"}
    assert likeness("enrg", "energy") and likeness("g", "green") and likeness("zebra", "energy") is None
    assert assigned(["green", "energy"], ("energy", "green")) == 0 and assigned(["energy", "energy"], ("energy", "green")) is None
    assert assigned([], ()) == 0


def test_table(spark, firms):
    companies = spark.createDataFrame([(i, n, list(a), b) for i, n, a, b in firms] + [(None, "x", None, None), ("c99", None, None, None)], "id string, name string, aliases array<string>, business_number string").selectExpr("*", "1 AS cost", "'w' AS w", "2L AS query_id")
    asked = spark.createDataFrame([(1, "Haengaengde Energy"), (1, "Haengaengde Energy"), (2, None), (3, " "), (4, "nobody at all"), (None, "x"), (5, "Tubochi" + " x" * 2000), (6, "q" * 200_000)], "query_id long, query string").selectExpr("*", "'k' AS company_id", "2 AS cost", "3L AS key")
    assert [(r.query_id, r.company_id) for r in resolve(asked, companies).collect()] == [(1, "c0")]
    assert resolve(asked, companies.limit(0)).count() == 0
    assert resolve(asked.limit(0), companies).count() == 0


def test_joins_agree_with_every_company_scored(spark, firms, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)  # every frequent key is dealt out
    shared = [(f"s{i}", f"Bluestork {trade} Inc.", (f"Kode{chr(97 + i)}{i}",), "") for i, trade in enumerate(["Energy", "Games", "Games", "Games", "Optics"])]
    everyone = [*firms, *shared]
    by_hand = ByHand(everyone)
    rng = random.Random(11)
    queries = ["Bluestork Energy", "Bluestork Games", "Bluestork", "Bluestork Games (Kodeb1)", "Kodec2 (Bluestork Games)", "Bluestork Games (Games)", "Bluestork Games (Kodee4)", "Games Bluestork"]
    for _ in range(80):
        _, name, aliases, _ = rng.choice(everyone)
        said = list(rng.choice([name, *aliases]))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(said))
            rng.choice([lambda: said.pop(k), lambda: said.insert(k, "e"), lambda: said.__setitem__(k, "o")])()
        queries.append("".join(said) + rng.choice(["", "", " (Energy)", f" ({rng.choice(everyone)[1]})"]))
    assert resolved(spark, everyone, queries) == [by_hand.meant(q) for q in queries]
    assert by_hand.meant("Bluestork Games (Kodeb1)") == "s1" and by_hand.meant("Bluestork Games") == ""


def test_names_spelt_with_blanks(spark, firms):
    more = [*firms, ("long", "Haengaengdemoltabirusan Energy", (), "")]
    assert resolved(spark, more, ["T u b o c h i Games", "H a e n g a e n g d e m o l t a b i r u s a n Energy", "T u b o c h i G a m e s"]) == ["c1", "long", "c1"]


def test_vocabulary_is_learned_from_all_companies(spark, firms):
    forms = [[n, *a] for _, n, a, _ in firms]
    table = spark.createDataFrame([(f[0], f[1:]) for f in forms], "name string, aliases array<string>")
    by_hand = Vocabulary(forms)
    assert names.learned(table) == (tuple(sorted(by_hand.common)), tuple(sorted(by_hand.hangul.items())))


def test_words_of_late_companies_are_common(spark):
    early = spark.range(20_500, numPartitions=1).selectExpr("CAST(id AS string) AS id", "concat('Q', id, ' Trading') AS name", "CAST(NULL AS array<string>) AS aliases", "'' AS business_number")
    late = spark.createDataFrame([(f"{latin}{x}", f"{latin}{x} Optics", [f"{local}{x}광학"], "") for latin, local in FIRSTS.items() for x in "abcdefghij"], early.schema)
    companies = early.unionByName(late).coalesce(1)
    asked = spark.createDataFrame([(1, "Haengaengdea"), (2, "Tubochij Optics"), (3, "Tubochij Trading")], "query_id long, query string")
    assert {r.query_id: r.company_id for r in resolve(asked, companies).collect()} == {1: "Haengaengdea", 2: "Tubochij"}


def test_first_words_of_one_or_two_letters(spark, firms):
    more = [*firms, ("lg", "LG Energy Inc.", (), ""), ("sk", "SK Games", (), ""), ("x", "X Optics Corp.", (), "")]
    short = ByHand(more)
    cases = {"LG Energy": "lg", "LG": "lg", "Energy LG": "lg", "sk games": "sk", "SKGames": "sk", "SK Energy": "", "LK Games": "", "L Energy": "", "X Optics": "x", "X": "x", "Haengaengde Energy": "c0"}
    assert resolved(spark, more, list(cases)) == list(cases.values())
    assert [meant(short, q) for q in cases] == list(cases.values())


def test_companies_without_a_name(spark, firms):
    nameless = [("n1", None, ["Bluestork", None], "222-33-44444"), ("n2", None, None, "3334455555"), ("n3", None, None, None), ("c0", None, ["Elsewhere"], None)]
    companies = spark.createDataFrame([(i, n, list(a), b) for i, n, a, b in firms] + nameless, "id string, name string, aliases array<string>, business_number string")
    asked = spark.createDataFrame(list(enumerate(["222-33-44444", "Bluestork", "x 333-44-55555", "Haengaengde Energy", "", "None"])), "query_id long, query string")
    assert {r.query_id: r.company_id for r in resolve(asked, companies).collect()} == {0: "n1", 1: "n1", 2: "n2", 3: "c0"}
