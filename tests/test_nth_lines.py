"""The look-back for a text in the lines above: block arrays, each line moved
once and a bit, against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from linden.operators import features as ft


def _lines(seed=3):
    rnd = random.Random(seed)
    return [(d, n, " ".join(rnd.choice("ab cd Ef gh xy zz".split()) for _ in range(rnd.randint(0, 2)))) for d in range(3) for n in range(rnd.randint(1, 90))]


@pytest.mark.parametrize("block", [20, 64])
def test_nth_lines_against_a_scan(spark, block):
    lines = _lines()
    text = {(d, n): t for d, n, t in lines}
    asked = [(d, n, "head", c) for d, n, _ in lines for c in ("ab", "ef", "Ef", "nowhere", "ea")]
    df = spark.createDataFrame(lines, "doc_id long, line int, text string")
    got = ft.nth_lines(spark.createDataFrame(asked, "doc_id long, line int, head string, c string"),
                       ft.line_blocks(df, block=block), ft.NTH_LINE, "c", block=block).collect()

    def scan(d, n, head, c, fold):
        if n == 0:
            return 99999
        if fold(c) in fold(head):
            return 0
        return next((k for k in range(1, 20) if n - k >= 1 and fold(c) in fold(text[d, n - k])), 99999)

    want = sorted((d, n, c, scan(d, n, h, c, str), scan(d, n, h, c, str.lower)) for d, n, h, c in asked)
    assert sorted((r.doc_id, r.line, r.c, r.contains_in_nth_line, r.contains_in_nth_line_lower) for r in got) == want


def test_each_line_is_kept_once_and_a_bit(spark):
    df = spark.createDataFrame([(0, n, f"text {n}") for n in range(640)], "doc_id long, line int, text string")
    kept = ft.line_blocks(df).select(F.explode("lines")).count()
    assert kept < 640 * 1.4
