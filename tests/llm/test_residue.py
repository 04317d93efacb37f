import importlib
import inspect
import json

import pytest

from recordweave.llm import seeds
from recordweave.llm.residue import BUCKETS, ResidueModel, counted, masked, parts, prose_counts, read_parts, residue_documents, shape_grams, word_grams

DOCS = "doc_id long, text string, export_form string"
PROSE = ["Our harbour queues were shifted, then weekly.", "Only 149 of 5849 rows kept their scores, so the errors stay out.", "Next, merge each parcel by mask and keep the raw one.", "The histogram of levels looks steady once the spline is applied.", "TIP: weigh before you compare; otherwise ratios creep in.", "모아 행을 확인했다 측정 단위 변하지 않았다.", "Wir sortieren die Werte nach der Woche.", "La curva crece y queda clara al final.",
         "Slots are written as and get filled by the fold step.", "The phrase is used here as a probe for the daily residual.", "Set with on the interval, see the guide.", "Some 12% of the rows have a gap of 3% or more.", "About half of the logs are 404 or 500 answers; pages that ask for JavaScript were counted apart."]


@pytest.fixture(scope="module")
def model():
    return ResidueModel(counted(PROSE * 300 + plain_english()))


def plain_english():
    """Paragraphs of the standard library's documentation."""
    modules = [importlib.import_module(m) for m in "argparse json logging collections statistics random decimal datetime textwrap threading subprocess tempfile pathlib functools itertools asyncio http.client email csv shutil".split()]
    texts = [inspect.getdoc(o) for m in modules for o in (m, *vars(m).values()) if callable(o) or o is m]
    return [p for t in texts if t for p in t.split("\n\n") if p.isascii() and not set(p) & set("<>{}%$#[]_")]


def excluded(model, text, form):
    page, own = parts(text, form)
    return bool(page) and model.is_notice(page) or bool(own) and model.has_filler(own)


def cells(*parts):
    return json.dumps({"cells": [{"cell_type": k, "source": t, **({"outputs": [{"text": o}]} if (o := (r or [None])[0]) else {})} for k, t, *r in parts]})


# wordings that are in no seed text
UNSEEN_SLOTS = ["{{ title }}", "{{results}}", "{{cookiecutter.goal}}", "[[Contact]]", "__DATASET__", "@@ProjectName@@", "#{author}", "<<period>>", "<%= goal %>", "%RESULTS%", "${SUMMARY}", "{% block goal %}{% endblock %}", "[INSERT GOAL]", "[Your author here]", "<Enter the title>", "<your results>", "(goal to be filled in)", "XXX goal goes here XXX"]
UNSEEN_FILLER = ["Text goes here. Text goes here.", "Hier steht ein Blindtext als Platzhalter.", "여기에 내용을 입력하세요. 예시 문구입니다.", "Aquí va el texto.", "Dummy text for the body of this section, to be replaced later.", "Replace this paragraph with your own words. This is sample text to show the layout.", "asdf xxxx asdf blah test test foo bar", "Sed ut nostrud ipsum elit magna quis ullamco."]
UNSEEN_NOTICES = ["Access denied. You do not have permission to view this notebook.", "Error 500. That is all we know about /nb/a/b.ipynb.", "Rate limit reached for this address. Try again in 12 minutes.", "Sorry, something went wrong. Reload? Unable to render this notebook.", "Bitte aktivieren Sie JavaScript, um das Notizbuch zu sehen.", "이 페이지를 보려면 자바스크립트를 켜 주세요.", "요청하신 페이지를 찾을 수 없습니다 (404). 주소를 다시 확인해 주세요.", "La página solicitada no existe (error 404).", "You need to enable JavaScript to run this app.", "Kernel gateway timed out while waiting for /nb/a.ipynb."]


def test_recall_on_wordings_the_model_has_not_seen(model):
    filler, notices = seeds.seed_texts()
    seen = "\n".join(filler + notices).lower()
    for t in UNSEEN_SLOTS + UNSEEN_FILLER + UNSEEN_NOTICES:
        assert t.lower() not in seen, t
    assert all(excluded(model, cells(("markdown", f"# {s}")), "ipynb") for s in UNSEEN_SLOTS)
    assert all(excluded(model, f"{PROSE[0]}\n\n- Owner: {s}\n\n{PROSE[1]}", "fenced") for s in UNSEEN_SLOTS)
    found = [excluded(model, f"{PROSE[2]}\n\n{t}\n\n{PROSE[3]}", "fenced") for t in UNSEEN_FILLER] + [excluded(model, t, "rendered") for t in UNSEEN_NOTICES]
    assert sum(found) >= 0.9 * len(found)


def test_the_models_decide(model):
    filler, notices = seeds.seed_texts()
    korean = "여기에 내용을 입력하세요. 예시 문구입니다."
    without = ResidueModel(counted(PROSE * 300), [t for t in filler if not any("가" <= c <= "힣" for c in t)], notices)
    assert excluded(model, korean, "fenced") and not without.has_filler(parts(korean, "fenced")[1])
    page = "Access denied. You do not have permission to view this notebook."
    assert not ResidueModel(counted(PROSE * 300), filler, ["x"]).is_notice(page)


def test_filler(model):
    for t in ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.", "asdf xxxx asdf blah test test foo bar", "Text goes here. Text goes here.", "Hier steht ein Blindtext als Platzhalter.", "여기에 내용을 입력하세요. 예시 문구입니다."):
        assert excluded(model, f"{PROSE[2]}\n\n{t}\n\n{PROSE[3]}", "fenced"), t


def test_short_filler_lines(model):
    for t in ("blah blah asdf asdf", "asdf xxxx xxxx blah", "# Lorem ipsum", "blah blah blah", "Lorem ipsum dolor.", "foo bar foo", "Lorem\nipsum"):
        assert excluded(model, cells(("markdown", PROSE[0]), ("markdown", t)), "ipynb"), t
        if "\n" not in t:
            assert excluded(model, f"{PROSE[2]}\n\n{t}\n\n{PROSE[3]}", "fenced"), t
    for t in ("# Test", "In est", 'The "lorem ipsum" text is gone.', '"lorem ipsum"', "# `foo` bar", "Test of the bar"):
        assert not excluded(model, cells(("markdown", PROSE[0]), ("markdown", t)), "ipynb"), t


def test_topics_code_and_outputs_are_kept(model):
    kept = [
        cells(("markdown", "Slots are written as `{{ title }}` or `[Your name here]` and get filled.")), cells(("markdown", 'The phrase "lorem ipsum dolor sit amet consectetur" is used as a probe.')),
        cells(("code", "Template('{{ name }} ${HOST}')", "owner: {{ owner }}\nlorem ipsum dolor sit amet consectetur elit")), cells(("markdown", r"Set $\mathbf{{x}}_{3}$ with $\frac{{a}}{{b}}$ on [2, 13], see [the guide][1].")),
        cells(("markdown", "About 54% of the logs are 404 or 500 answers; pages that ask for JavaScript were counted apart.")), cells(("code", "fetch()", "404 : Not Found\nThe page you asked for could not be found.")),
        *(cells(("markdown", p)) for p in PROSE),
    ]
    for text in kept:
        book = json.loads(text)
        book["cells"] += [{"cell_type": "markdown", "source": p} for p in PROSE[:4]]
        assert not excluded(model, json.dumps(book), "ipynb"), text


def test_pages(model):
    pages = ["Access denied. You do not have permission to view this notebook.", "\n\nError 500. That is all we know about /nb/a/b.ipynb.\n", "<html><head><title>502 Bad Gateway</title></head><body><h1>Bad Gateway</h1><hr></body></html>", '{"message": "Gone", "status": 410, "path": "/nb/x.ipynb"}', "Bitte aktivieren Sie JavaScript, um das Notizbuch zu sehen.", "이 페이지를 보려면 자바스크립트를 켜 주세요.", "503 Service Unavailable"]
    for page in pages:
        for form in ("ipynb", "rendered", "fenced", "percent"):
            assert excluded(model, page, form), (page, form)
    for p in PROSE:
        assert not excluded(model, p, "rendered")


def test_masking_keeps_length():
    t = 'a `b` "c" $d$ ${E} ```f\ng``` «h»'
    assert len(masked(t)) == len(t) and "${E}" in masked(t) and "b" not in masked(t)


def test_table(spark):
    rows = [(1, "\n\n".join(PROSE), "fenced"), (2, PROSE[0] + "\n\n[[Author]]", "fenced"), (2, PROSE[0] + "\n\n[[Author]]", "fenced"), (3, None, "fenced"), (4, "", None), (None, "[[Author]]", "fenced"), (5, "404 Not Found", None), (6, PROSE[1] + "\n\n" + "plain words stay " * 100_000, "fenced")]
    rows += [(100 + i, "\n\n".join(PROSE[i % 8 :]), "fenced") for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS gram", "2 AS n")
    assert sorted(r.doc_id for r in residue_documents(df).collect()) == [2, 5]
    assert residue_documents(df.limit(0)).count() == 0


def test_prose_is_counted_over_all_documents(spark):
    df = spark.range(45_000).selectExpr("id AS doc_id", "'plain words stay' AS text", "'fenced' AS export_form")
    counts = prose_counts(read_parts(df))
    cell = parts("plain words stay", "fenced")[1]
    words, shapes = (set(g[g > 0].tolist()) for g in (word_grams(cell), shape_grams(cell)[0]))
    assert {counts[g] for g in words} | {counts[BUCKETS + g] for g in shapes} == {45_000}
    assert counts.sum() == 45_000 * (len(words) + len(shapes))
