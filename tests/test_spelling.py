"""Spelling and segmentation on tiny hand-written inputs."""

import math

from pyspark.sql import functions as F

from linden.operators import retrieve as rt
from linden.operators import spelling as sp
from linden.sources import views


def test_highlight_and_first_occurrence(spark):
    lines = spark.createDataFrame(
        [(0, 0, "class SomethingWorng:"), (0, 1, "    SomethingWorng = 1"), (0, 2, "    value_count = 2")],
        "doc_id long, line int, text string")
    dictionary = spark.createDataFrame([("something", 1), ("value", 1), ("count", 1)], "w string, f long")
    got = {(r.line, r.token): r.highlighted for r in sp.spelling(views.tokens(lines), dictionary, False).collect()}
    # Reported once, at its first checked occurrence; known words stay plain.
    assert got == {(0, "SomethingWorng"): "Something<em>Worng</em>"}


def test_decompose(spark):
    df = spark.createDataFrame([("SomeClass",), ("SOME_CONSTANT",), ("some_variable2x",), ("HTTPServer",)], "t string")
    got = [r[0] for r in df.select(sp.decompose(F.col("t"))).collect()]
    assert got == [["some", "class"], ["some", "constant"], ["some", "variable"], ["server"]]


def _viterbi(word, vocab, total):
    def score(w):
        return math.log(vocab[w] / total) if w in vocab else math.log(10.0 / (total * 10 ** len(w)))
    best = [0.0] + [None] * len(word)
    back = [0] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i in range(j):
            c = best[i] + score(word[i:j])
            if best[j] is None or c > best[j]:
                best[j], back[j] = c, i
    out, j = [], len(word)
    while j > 0:
        out.insert(0, word[back[j]:j])
        j = back[j]
    return out


def test_segmentation_matches_brute_force(spark):
    vocab = {"a": 50, "dog": 20, "cache": 5, "the": 80, "hot": 7, "dogs": 3, "at": 30}
    total = sum(vocab.values())
    parts = ["adog", "cacheadog", "thehotdogs", "xyz", "atthe"]
    v = spark.createDataFrame(list(vocab.items()), "w string, f long")
    p = spark.createDataFrame([(x,) for x in parts], "part string")
    got = {r.part: r.words for r in rt.segment_parts(p, v).collect()}
    assert got == {x: _viterbi(x, vocab, total) for x in parts}
    assert got["adog"] == ["a", "dog"]


def test_project_dictionary_counts_from_its_line(spark):
    from linden.operators import spelling as sp
    from linden.sources import views
    text = ["# flurble glonk", "flurble_glonk = 1", "# wibbly", "zorbo_thing = 2", "# zorbo again"]
    tokens = views.tokens(spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(text)], "doc_id long, line int, text string"))
    words = spark.createDataFrame([("again",), ("thing",)], "w string")
    added = spark.createDataFrame([(1, "flurble", 0), (1, "glonk", 1), (1, "wibbly", 3), (1, "zorbo", 3)], "doc_id long, w string, line int")

    def found(project):
        return {(r.doc_id, r.line, r.token) for r in sp.spelling(tokens, words, project=project).collect()}

    none = found(None)
    assert {(1, 0, "flurble"), (1, 0, "glonk"), (1, 2, "wibbly"), (1, 3, "zorbo_thing")} <= none
    # flurble is known from its line on, glonk a line too late, wibbly too, zorbo in time
    assert found(added) == {x for x in none if x[0] == 2} | {(1, 0, "glonk"), (1, 2, "wibbly")}
