"""Blocked look-backs against a brute-force scan, with blocks small enough
that every carry crosses block boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from linden.operators.sequence import carry_last, carry_next, shift_lines


def _data(seed=7):
    rnd = random.Random(seed)
    rows = []
    for doc in range(4):
        n = rnd.randint(1, 40)
        for line in range(n):
            v = rnd.choice([None, None, rnd.randint(0, 9)])
            rows.append((doc, line, v))
    return rows


def _brute(rows, inclusive, reverse=False):
    out = {}
    by_doc = {}
    for d, l, v in rows:
        by_doc.setdefault(d, []).append((l, v))
    for d, items in by_doc.items():
        items.sort(reverse=reverse)
        last = None
        for l, v in items:
            if inclusive and v is not None:
                last = v
            out[(d, l)] = last
            if not inclusive and v is not None:
                last = v
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 2048])
@pytest.mark.parametrize("inclusive", [False, True])
def test_carry_last_matches_scan(spark, block, inclusive):
    rows = _data()
    df = spark.createDataFrame(rows, "doc_id long, line int, v int")
    got = {(r.doc_id, r.line): r.c for r in
           carry_last(df, F.col("v"), "c", block=block, inclusive=inclusive).collect()}
    assert got == _brute(rows, inclusive)


@pytest.mark.parametrize("block", [2, 5])
def test_carry_next_matches_scan(spark, block):
    rows = _data(11)
    df = spark.createDataFrame(rows, "doc_id long, line int, v int")
    got = {(r.doc_id, r.line): r.c for r in carry_next(df, F.col("v"), "c", block=block).collect()}
    assert got == _brute(rows, False, reverse=True)


def test_shift_lines_exact_offset(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 3, "d")], "doc_id long, line int, text string")
    got = {r.line: r.prev_text for r in shift_lines(df, ["text"]).collect()}
    assert got == {0: None, 1: "a", 3: None}


def _brute_trigrams(docs):
    from linden.functions import lexicon as lx
    import regex
    out = []
    for doc, text in docs:
        t2 = t1 = ""
        for line, content in enumerate(text.split("\n")):
            for pos, t in enumerate(regex.findall(lx.TOKEN_PATTERN, content)):
                if t.startswith("#") or regex.match(r"\p{N}", t) or len(t) > lx.STAT_MAX_LEN:
                    continue
                out.append((doc, line, pos, t2, t1, t))
                t2, t1 = t1, t
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_ngram_stream_crosses_blocks(spark, block):
    from linden.operators import ngrams
    from linden.sources import views
    docs = [(0, "a b\n\nc\n# x\nd e f\n1 2\ng"), (1, "x\ny\n\n\nz w"), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngrams.ngram_rows(views.lines(df), block).collect())
    assert got == _brute_trigrams(docs)
