import json

from recordweave.llm.cells import CODE, OUTPUT, PAGE, TEXT, segments


def test_ipynb_escapes_outputs_and_shapes():
    book = {"cells": [
        {"cell_type": "markdown", "source": ["a\n", "b \"q\""]}, {"cell_type": "raw", "source": "r"},
        {"cell_type": "code", "source": "x = 1", "outputs": [{"output_type": "stream", "text": ["1\n", "2"]}, {"data": {"text/plain": "p", "image/png": "AAAA"}}, {"ename": "E", "evalue": "v", "traceback": ["t1", "t2"]}, None]}, "odd",
    ]}
    assert segments(json.dumps(book), "ipynb") == [(TEXT, 'a\nb "q"'), (TEXT, "r"), (CODE, "x = 1"), (OUTPUT, "1\n2"), (OUTPUT, "p"), (OUTPUT, "E\nv\nt1\nt2")]
    assert segments("404 Not Found", "ipynb") == [(PAGE, "404 Not Found")]
    assert segments("[1, 2]", "ipynb") == [(PAGE, "[1, 2]")]


def test_percent():
    t = "# %% [markdown]\n# # T\n# \n# body\n\n# %%\nx = 1\n# note\n\n# Out[1]:\n# > 5\n# > 6\n\n# %% [markdown]\n# end"
    assert segments(t, "percent") == [(TEXT, "# T\n\nbody"), (CODE, "x = 1\n# note"), (OUTPUT, "5\n6"), (TEXT, "end")]


def test_fenced():
    t = "one\n\n```python\na\n\nb\n```\n\n    out 1\n\n    out 2\n\ntwo\nthree\n\n    not an output"
    assert segments(t, "fenced") == [(TEXT, "one"), (CODE, "a\n\nb"), (OUTPUT, "out 1\n\nout 2"), (TEXT, "two\nthree"), (TEXT, "    not an output")]


def test_rendered():
    t = "intro\n\nIn [1]:\ndef f():\n    a\n\n    return b\n\nOut[1]:\n5\n\ntext\n\nIn [ ]:\ny"
    assert segments(t, "rendered") == [(TEXT, "intro"), (CODE, "def f():\n    a\n\n    return b"), (OUTPUT, "5"), (TEXT, "text"), (CODE, "y")]


def test_nothing_and_unknown_forms():
    assert segments(None, "ipynb") == segments("", "fenced") == segments("  \n", None) == []
    assert segments('{"cells": []}', None) == []
    assert segments("# %%\nx", "odd") == [(CODE, "x")]
