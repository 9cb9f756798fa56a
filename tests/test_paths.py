"""Keyword cover highlighting (cases from the reference's UI unit tests),
link-list harvest and ignore rules."""

import pytest
from pyspark.sql import functions as F

from linden.operators import paths

COVER_CASES = [
    ("a", ["a"], "<em>a</em>"),
    ("A", ["a"], "<em>A</em>"),
    ("abc", ["abc"], "<em>abc</em>"),
    ("import", ["im"], "<em>im</em>port"),
    ("AbcBbcCbc", ["abc"], "<em>Abc</em>BbcCbc"),
    ("pypy", ["py"], "<em>pypy</em>"),
    ("abac", ["a", "c"], "<em>a</em>b<em>ac</em>"),
    ("abac", ["a", "ac"], "<em>a</em>b<em>ac</em>"),
    ("abac", ["b"], "a<em>b</em>ac"),
    ("abac", ["ba"], "a<em>ba</em>c"),
    ("abac", ["ddd", "eee"], "abac"),
    ("abac", [], "abac"),
    ("abac", ["c", ""], "aba<em>c</em>"),
]


def test_cover_display(spark):
    df = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(COVER_CASES)],
                               "i int, target string, kws array<string>")
    m = paths.cover_mask(F.col("target"), F.col("kws"))
    out = df.select("i", paths.cover_display(F.col("target"), m).alias("d"),
                    F.size(F.filter(m, lambda x: x)).alias("score")).orderBy("i").collect()
    assert [r.d for r in out] == [c[2] for c in COVER_CASES]
    assert out[6].score == 3


def test_markdown_links(spark):
    lines = spark.createDataFrame([
        (0, 0, "* [Django](https://github.com/django/django) - The web framework."),
        (0, 1, "* [Docs](https://example.org/docs) - Documentation (site)."),
        (0, 2, "- [Not](https://x.y) - bullet"),
    ], "doc_id long, line int, text string")
    got = {(r.name, r.url, r.hosted) for r in paths.markdown_links(lines).collect()}
    assert got == {("Django", "https://github.com/django/django", True),
                   ("Docs", "https://example.org/docs", False)}


@pytest.mark.parametrize("path,expected", [
    ("a/b/x.html", True), ("es/1.txt", True), ("es/5.txt", False), ("a/9x", True), ("fr/3", True), ("fr/7", False),
])
def test_ignore_rules_last_match_wins(spark, path, expected):
    rules = ["*.html", "/es/", "!/es/5*", "**/9*", "fr/*[0-4]"]
    got = spark.createDataFrame([(path,)], "p string").select(paths.ignored(F.col("p"), rules)).first()[0]
    assert got is expected


def test_marks_are_found_once_for_a_text(spark):
    """Not again for each of its characters: long texts take time in proportion."""
    import time

    text = "Red İ bo [x] ring rebo " * 150
    low = text.lower()
    want = [False] * len(text)
    for k in ("red", "bo", "ing", "[x]"):
        at = low.find(k)
        while at >= 0:
            want[at:at + len(k)] = [True] * len(k)
            at = low.find(k, at + len(k))
    df = spark.createDataFrame([(text,)] * 8, "t string")
    begin = time.time()
    got = paths.keyword_cover(df, "t", ["RED", "bo", "", "ing", "[x]"]).collect()
    assert time.time() - begin < 20
    covered = sum(want[:len(text)])
    assert [r.score for r in got] == [covered] * 8
    assert got[0].display.replace("<em>", "").replace("</em>", "") == text
