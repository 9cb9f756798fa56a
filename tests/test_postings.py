"""Postings, prefix index and dirty-line detection (scenarios from the
reference's token-map tests, rewritten as DataFrames)."""

import datetime as dt

from pyspark.sql import functions as F

from linden.operators import lookup
from linden.streaming import edits


def _tokens(spark, rows):
    return spark.createDataFrame([(0, line, i, "NAME", t) for i, (line, t) in enumerate(rows)],
                                 "doc_id long, line int, pos int, kind string, t string")


def _lines_of(postings, t):
    return {r.line for r in postings.where(F.col("t") == t).collect()} or None


def test_token_postings_and_line_removal(spark):
    tok = _tokens(spark, [(1, "a"), (1, "b"), (2, "c"), (3, "a")])
    p = lookup.postings(tok)
    assert _lines_of(p, "a") == {1, 3}
    assert _lines_of(p, "c") == {2}
    assert _lines_of(p, "not found") is None
    removed = p.join(spark.createDataFrame([(0, 1)], "doc_id long, line int"), ["doc_id", "line"], "left_anti")
    assert _lines_of(removed, "a") == {3}


def test_prefix_index_min_max_and_prefix(spark):
    tok = _tokens(spark, [(1, "ape"), (1, "appear"), (1, "apple"), (2, "apple"), (3, "apple"), (4, "banana")])
    mm = {r.t: (r.min_line, r.max_line) for r in lookup.token_min_max(tok).collect()}
    assert mm["apple"] == (1, 3)
    found = {r.t for r in lookup.prefix_lookup(tok, "app").collect()}
    assert {"apple", "appear"} <= found
    near = [r.t for r in lookup.prefix_nearest(tok, "app", 1).orderBy("rank").collect()]
    assert set(near) == {"apple", "appear"}
    for gone, expect in ((1, 2), (2, 3)):
        tok = tok.where(F.col("line") != gone)
        assert {r.t: r.min_line for r in lookup.token_min_max(tok).collect()}["apple"] == expect


def test_dirty_lines(spark):
    base = spark.createDataFrame([(0, 0, ""), (0, 1, "a"), (0, 2, "b")], "doc_id long, line int, text string")
    t0 = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(0, 1, "a", t0, 1), (0, 2, "c", t0, 2)],
                                  "doc_id long, line int, text string, ts timestamp, seq long")
    got = [r.line for r in edits.dirty_edits(edits.with_base(batch, base)).where("dirty").collect()]
    assert got == [2]
    again = batch.union(spark.createDataFrame([(0, 2, "c", t0, 3)], batch.schema))
    assert [r.seq for r in edits.dirty_edits(edits.with_base(again, base)).where("dirty").collect()] == [2]
