"""Similarity scores pinned by the reference's feature and UI tests."""

from pyspark.sql import functions as F
from tests.conftest import SMALL

from linden.functions import similarity as sim
from linden.plans.registry import QUERIES
from linden.plans.similarity import _pairs

RATIO = [("_underscore", "__dunder", 63), ("regularizers", "kernel_regularizer", 73),
         ("regularizers", "regularize", 91), ("placeholder", "hold", 53), ("string", "str", 67),
         ("have_fun", "__dunder", 38)]
PARTIAL = [("_underscore", "__dunder", 75), ("'kernel_regularizer'", "regularizers", 92),
           ("regularizers", "placeholder", 36), ("regularizers", "regularize", 100)]


def test_ratio(spark):
    df = spark.createDataFrame(RATIO, "a string, b string, want int")
    got = df.select("want", sim.ratio(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_partial_ratio(spark):
    df = spark.createDataFrame(PARTIAL, "a string, b string, want int")
    got = df.select("want", sim.partial_ratio(F.lower("a"), F.lower("b")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_ratio_empty(spark):
    df = spark.createDataFrame([("", "abc"), ("abc", "")], "a string, b string")
    assert [r[0] for r in df.select(sim.ratio(F.col("a"), F.col("b"))).collect()] == [0, 0]


def test_abbreviation_order_relations():
    s = sim.abbreviation_score
    assert s("abc", "abc") == 1000
    assert s("abc", "abc") > s("ABC", "abc")
    assert s("a", "a") > s("A", "a")
    assert s("A", "A") > s("A", "a")
    assert s("AbcBbcCbc", "abc") > 0
    assert s("AbcBbcCbc", "abc") == s("AbBbCb", "abc")
    assert s("abc", "abc") > s("AaBbCc", "abc")
    assert s("AaBbCc", "abc") > s("AaXbCc", "abc")
    assert s("AaBbXx", "abc") > s("AaYyXx", "abc")


def test_abbreviation_scores_as_numbers():
    """Worked out by hand from the rule: 100 for the first letter in its case, 5
    inside a word, 10 at a word's start, -1 a run of skips, -200 beyond the end."""
    s = sim.abbreviation_score
    assert s("import", "im") == 100 + 5 - 1
    assert s("backs", "baks") == 100 + 5 - 1 + 5 + 5 - 1  # the last match ends the target: the skip counts all the same
    assert s("ab", "abc") == 100 + 5 - 1 - 200
    assert s("aXbX", "axx") == 100 + 10 - 1 + 10 - 1
    assert s("_a_dog", "_adog") == 100 + 10 - 1 + 10 + 5 + 5 - 1
    assert s("ABC", "abc") == 10 + 5 + 5 - 1
    assert s("bca", "a") == -1 + 5
    assert s("abc", "x") == s("", "x") == -9999
    assert s("ab", "xb") == -9999 + 5 - 1
    assert s("a", "") == 0 and s("abc", "") == -1 and s("", "") == 1000


def test_abbreviation_udf_matches_python(spark):
    rows = [("AbcBbcCbc", "abc"), ("import", "im"), ("_a_dog", "_adog")]
    df = spark.createDataFrame(rows, "t string, s string")
    got = [r[0] for r in df.select(sim.abbreviation_score_udf("t", "s")).collect()]
    assert got == [sim.abbreviation_score(t, s) for t, s in rows]


def test_abbreviation_query_scores_every_prefix(spark):
    got = QUERIES["abbrev_score"](spark, SMALL).collect()
    want = {(r.b, r.a[:n].lower()) for r in _pairs(spark, SMALL).collect() for n in range(1, len(r.a) + 1)}
    assert len(got) == len(want) and {(r.target, r.typed) for r in got} == want
    assert max(len(r.typed) for r in got) > 3
    assert all(r.score == sim.abbreviation_score(r.target, r.typed) for r in got[:2000])


def test_scores_equal_plain_loops(spark):
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        return row[-1]

    def ratio(a, b):
        return round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0

    def partial(a, b):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        return max(ratio(a, b[i:i + len(a)]) for i in range(len(b) - len(a) + 1)) if a else 0

    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé_😀") for _ in range(n))
    pairs = [(word(rng.randint(0, 9)), word(rng.randint(0, 12))) for _ in range(150)] + [(word(64), word(66)), (word(62), word(70)), (word(3), word(80))]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", sim.ratio(F.col("a"), F.col("b")).alias("r"), sim.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r.r, r.p) for r in got] == [(ratio(r.a, r.b), partial(r.a, r.b)) for r in got]
