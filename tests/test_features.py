"""Context features on a small hand-written code snippet."""

from linden.operators import candidates as cd
from linden.operators import features as ft
from linden.sources import views

SNIPPET = [
    "import os",
    "",
    "",
    "def fn(xx):",
    "    for item in print(xx, yy):",
    "        value = item",
]


def _ctx(spark):
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(SNIPPET)], "doc_id long, line int, text string")
    pos = cd.positions(views.tokens(lines)).select(*ft.GROUP, "t")
    rows = ft.context_features(ft.positions_with_context(lines, pos)).join(pos, ft.GROUP)
    return {(r["line"], r["t"]): r for r in rows.collect()}


def test_context_features(spark):
    f = _ctx(spark)
    d = f[(3, "def")]
    assert d["blank_line_before"] == 2 and d["indent_delta"] == 0 and d["at_line_start"] == 0
    yy = f[(4, "yy")]
    assert yy["in_function_print"] == 1 and yy["for"] == 1 and yy["left_char_is_("] == 1
    assert yy["left_char_is_,"] == 1 and yy["indent"] == 4 and yy["indent_delta"] == 4
    assert yy["last_line_ends_with_:"] == 1
    item = f[(5, "item")]
    assert item["left_char_is_="] == 1 and item["in_function_print"] == 0 and item["for"] == 0
    assert item["indent_delta"] == 4 and item["line_number"] == 5
    xx = f[(4, "xx")]
    assert xx["left_char_is_,"] == 0 and xx["in_function_print"] == 1


def test_enclosing_call_closed_paren(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("f(a) + g(b, c",), ("h(k(x), y",), ("plain",)], "head string")
    got = [r[0] for r in df.select(ft.enclosing_call(F.col("head"))).collect()]
    assert got == ["g", "h", ""]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0


def partial(a, b):
    short, long = sorted((a.lower(), b.lower()), key=len)
    return max(ratio(short, long[i:i + len(short)]) for i in range(len(long) - len(short) + 1)) if short else 0


def test_similarity_features(spark):
    text = ["def __init__(self, regularizers):", "kernel = 'kernel_regularizer'", "", "value = 3", "from regularizers import get",
            "kernel_regularizer = get(kernel, regular)"]
    lines = spark.createDataFrame([(0, i, t) for i, t in enumerate(text)], "doc_id long, line int, text string")
    tokens = views.tokens(lines)
    at = {(r.line, r.t): r.pos for r in tokens.collect()}
    asked = [(5, "kernel", "regularizers"), (5, "kernel_regularizer", "kernel"), (0, "regularizers", "self"), (3, "value", "kernel"), (1, "kernel", "def")]
    cands = spark.createDataFrame([(0, line, at[line, t], c, 0) for line, t, c in asked], "doc_id long, line int, pos int, c string, y int")
    got = {(r.line, r.c): r for r in ft.similarity_features(cands, tokens).collect()}
    assert len(got) == len(asked)
    r = got[5, "regularizers"]
    first = "kernel_regularizer"
    assert (r.first_token_ratio, r.first_token_partial_ratio) == (ratio(first, "regularizers"), partial(first, "regularizers")) == (73, 92)
    above = ("value", "", "kernel", "def")  # of lines 3, 2, 1 and 0
    assert r.last_n_lines_first_token_partial_ratio == max(partial(t, "regularizers") for t in above) > 0
    assert r.all_token_ratio == max(ratio(t, "regularizers") for t in (first, "get", "regular")) == 74
    assert r.last_line_all_token_ratio == 100 and r.last_line_first_token_ratio == ratio("from", "regularizers")
    r = got[5, "kernel"]  # the cursor is in the line's first token
    assert (r.first_token_ratio, r.first_token_partial_ratio) == (-2, -2) and r.all_token_ratio == 100
    r = got[0, "self"]
    assert r.last_n_lines_first_token_partial_ratio == r.last_line_first_token_ratio == r.last_line_all_token_ratio == -1
    assert got[1, "def"].last_n_lines_first_token_partial_ratio == -1
    r = got[3, "kernel"]  # an empty line above, nothing else in the line
    assert (r.last_line_first_token_ratio, r.last_line_all_token_ratio, r.all_token_ratio, r.last_n_lines_first_token_partial_ratio) == (0, -1, -1, 100)


def test_lcs_of_all_lengths(spark):
    import random

    from pyspark.sql import functions as F

    from linden.functions import similarity as sim

    rng = random.Random(5)
    pairs = [("".join(rng.choices("abé", k=n)), "".join(rng.choices("abéc", k=m))) for n in (0, 1, 5, 61, 62, 63, 70) for m in (0, 1, 7, 62, 63, 80)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.n for r in df.select("i", sim.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: lcs(*p) for i, p in enumerate(pairs)}
