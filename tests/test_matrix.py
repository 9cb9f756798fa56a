"""Candidates of whole documents, without a shuffle, against the joins over lines."""

import random

import pytest
from pyspark.sql import functions as F

from linden.operators import features as ft
from linden.operators import matrix as mx
from linden.operators.sequence import last_before
from linden.plans import features as plans
from linden.sources import views

TEXTS = ["import os, Sys.path as foo", "from Foo.bar import (baz, fooBar)", "", "  ", "class Fab(object):", "    async def foo(self, bar=1, *baz, Übung: int):",
         "\tdef bar(a, (b, foo), foo='x, y'):", "foo = 'bar # foo", "bar = \"foo bar\" + foo(bar, baz[foo", "Foo.bar  =  [1, 2]", "Übung1 = Übung.foo(_ba, __bar)",
         "# foo bar", "if foo == bar: x1 = b'1'", "for foo in bar(foo, baz): # baz", "baz = True", "baz\t=  3.5", "f" * 70 + " = " + "f" * 65, "y=foo(bar(baz), fab"]


def _codes(spark, n=6, seed=7):
    rnd = random.Random(seed)
    docs = [(d, [rnd.choice(TEXTS) for _ in range(rnd.choice((1, 5, 30, 60)))]) for d in range(n)]
    return spark.createDataFrame([*docs, (97, []), (98, [""]), (99, TEXTS)], "doc_id long, codes array<string>")


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("matrix", [False, True])
def test_candidates_of_documents_are_those_of_their_lines(spark, matrix):
    codes = _codes(spark)
    got = mx.candidates(mx.positions(codes), matrix)
    want = plans.candidates_by_line(codes.select("doc_id", F.posexplode("codes").alias("line", "text")), matrix).select(got.columns)
    if matrix:
        got, want = ft.with_similarity(got), ft.with_similarity(want)
    assert _rows(got) == _rows(want) and got.count() > 500


def test_candidates_of_documents_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "one two three four\n" * 20), (2, "")], "doc_id long, text string")
    plan = mx.candidates(mx.positions(views.code_line_arrays(docs)), True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_repeated_ids_and_many_lines_go_line_by_line(spark, monkeypatch):
    text = "\n".join(f"alpha beta{i % 3} gamma delta eps" for i in range(20))
    docs = [(1, text), (2, text), (2, text), (None, text), (3, None), (4, "\n".join(f"alpha {'abc'[i % 3]}b" for i in range(60)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole, rest = views.whole_documents(df, most_lines=50)
    assert [r.doc_id for r in whole.collect()] == [1] and sorted(str(r.doc_id) for r in rest.collect()) == ["2", "2", "4", "None"]
    monkeypatch.setattr(plans, "documents", lambda *_: df.where("doc_id is null or doc_id <> 2"))
    monkeypatch.setattr(plans.mx, "MOST_LINES", 50)
    split = _rows(ft.completion_features(plans.candidate_frame(spark, None)))
    monkeypatch.setattr(plans.mx, "MOST_LINES", 1 << 14)
    assert split == _rows(ft.completion_features(plans.candidate_frame(spark, None))) and len(split) > 100


def test_last_before(spark):
    df = spark.createDataFrame([([], 3), ([0], 3), ([2], 3), ([0, 1, 2], 3), ([1, 4], 7), ([], 0)], "m array<int>, n int")
    got = [r[0] for r in df.select(last_before(F.col("m"), F.col("n"))).collect()]
    assert got == [[max((x for x in m if x < i), default=-1) for i in range(n)] for m, n in df.collect()]


def test_completion_features_shuffle_only_the_counts(spark, monkeypatch):
    """The n-gram counts are written before; the candidates that join them are not shuffled."""
    docs = spark.createDataFrame([(d, "\n".join(f"alpha beta{i % 3} gamma delta eps" for i in range(20))) for d in range(3)], "doc_id long, text string")
    monkeypatch.setattr(plans, "documents", lambda *_: docs)
    plan = plans.completion_features(spark, None)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
