"""Nearest statement around a position: blocks of lines against a plain scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linden.operators import retrieve as rt

TEXTS = ["foo = bar(foo, x[1])", "class foo:", "# foo bar", "import foo", "for foo in bar:", "", "x = 'foo", "refoo foo = 1", "bar)", "foo", "y = (bar, {foo: [1, 2]}), z"]


def _end(s, i):
    st = []
    for k in range(i, len(s)):
        ch = s[k]
        if ch in "([{":
            st.append(")]}"["([{".index(ch)])
        elif st and ch == st[-1]:
            st.pop()
        elif not st and ch in rt.RIGHT_HALVES:
            return k
    return len(s)


def _scan(lines, d, n, t):
    shape = lambda s: [bool(re.search(rx, s)) for rx in rt.CONSISTENCY_CHECKS]
    for off in (x for j in range(1, rt.STATEMENT_SCAN + 1) for x in (-j, j)):
        s = lines.get((d, n + off))
        if s is None:
            continue
        i, h = s.find(t), s.find("#")
        if i < 0 or 0 <= h < i or (i > 0 and re.match("[A-Za-z0-9_]", s[i - 1])) or re.search(rt.IMPORT_CHECK, s) \
                or shape(s) != shape(lines[d, n]) or (s[:i].count('"') + s[:i].count("'")) % 2 or len(t) + i + 1 >= len(s):
            continue
        return (d, n, 0, t, n + off, s[i:_end(s, i)])
    return None


@pytest.mark.parametrize("block", [7, 128])
def test_full_statement_against_a_scan(spark, block):
    rnd = random.Random(5)
    lines = {(d, n): rnd.choice(TEXTS if d else TEXTS[:6] + [""] * 40) for d in range(3) for n in range(150)}
    asked = [(d, n, 0, t) for d, n in lines for t in ("foo", "bar")]
    got = rt.full_statement(spark.createDataFrame(asked, "doc_id long, line int, pos int, t string"),
                            spark.createDataFrame([(*k, v) for k, v in lines.items()], "doc_id long, line int, text string"), block)
    want = sorted(x for x in (_scan(lines, d, n, t) for d, n, _, t in asked) if x)
    assert sorted(map(tuple, got.collect())) == want


def test_positions_are_not_multiplied(spark):
    lines = spark.createDataFrame([(0, n, "foo = 1 2 3") for n in range(300)], "doc_id long, line int, text string")
    plan = rt.full_statement(lines.select("doc_id", "line", F.lit(0).alias("pos"), F.lit("foo").alias("t")), lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the lines' blocks; positions meet one block each
