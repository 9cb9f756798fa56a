"""Array forms over whole documents against the blocked forms over lines:
same rows, and nothing shuffled before the counts."""

import pytest
from pyspark.sql import functions as F

from linden.operators import blocks, lookup, ngrams
from linden.sources import views

DOCS = [(0, "a b\n\nc\n# x\nd e f\n1 2\ng a b c"), (1, "x\ny\n\n\nz w\nx y\nx"), (2, ""), (3, "x = y . z ( )\n'one two' x = y\nx = y"),
        (4, "twice a b"), (4, "twice\na b"), (5, None), (None, "a\nb a"), (6, "long " * 40)]


def _docs(spark, docs=DOCS):
    return spark.createDataFrame(docs, "doc_id long, text string")


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("op", [ngrams.ngram_rows, ngrams.token_context, ngrams.trigram_counts, ngrams.bigram_counts, ngrams.token_counts])
def test_documents_give_the_rows_of_their_lines(spark, op):
    once = [d for d in DOCS if d[0] != 4]
    assert _rows(op(_docs(spark, once))) == _rows(op(views.lines(_docs(spark, once))))


def test_repeated_null_and_long_documents_go_line_by_line(spark):
    whole, rest = views.whole_documents(_docs(spark), limit=100)
    assert sorted(r.doc_id for r in whole.collect()) == [0, 1, 2, 3]
    assert sorted(str(r.doc_id) for r in rest.collect()) == ["4", "4", "6", "None"]
    # a token occurs as often as before where an id is repeated
    counts = {r.t0: r.n for r in ngrams.token_counts(_docs(spark)).collect()}
    assert counts["twice"] == 2 and counts["long"] == 40


def test_nearest_ngram_of_documents(spark):
    once = _docs(spark, [d for d in DOCS if d[0] != 4])
    got = lookup.nearest_ngram(once)
    assert _rows(got) == _rows(lookup.nearest_ngram(ngrams.token_context(views.lines(once))))


def test_no_shuffle_before_the_counts(spark):
    docs = _docs(spark, [d for d in DOCS if d[0] in (0, 1, 2, 3)])
    assert _exchanges(ngrams.ngram_rows(docs)) == 0
    assert _exchanges(ngrams.token_context(docs)) == 0
    assert _exchanges(lookup.nearest_ngram(docs)) == 0
    for op in (ngrams.token_counts, ngrams.bigram_counts, ngrams.trigram_counts):
        assert _exchanges(op(docs)) == 1
    # the pruned statistics are sent to the token rows
    found = lookup.ngram_lookup(ngrams.token_context(docs), ngrams.pruned_statistics(docs, materialize=True))
    assert _exchanges(found) == 0
    assert found.where(F.col("token_frequency") > 0).count() > 0


def test_postings_of_documents(spark):
    """Same rows as of the tokens, repeated ids and null ids included; unique documents shuffle nothing."""
    docs = _docs(spark)
    assert _rows(lookup.document_postings(docs)) == _rows(lookup.postings(views.tokens(views.lines(docs))))
    gone = spark.createDataFrame([(0, 0), (4, 0), (None, 0)], "doc_id long, line int")
    want = lookup.postings(views.tokens(views.lines(docs))).join(gone, ["doc_id", "line"], "left_anti").select("doc_id", "t", "line", "n")
    assert _rows(lookup.document_postings(docs, gone)) == _rows(want)
    once = _docs(spark, [d for d in DOCS if d[0] in (0, 1, 2, 3)])
    assert _exchanges(lookup.document_postings(once)) == 0


CODE = [(d, "\n".join(f"{w} Übung three_{i} four five six{i} {'seven ' * (i % 3)}" if i % 5 else "" for i in range(n))) for d, w, n in ((0, "one", 33), (1, "", 9), (2, "x", 1), (3, "two", 70))]


def test_dedented_bodies_of_documents(spark):
    docs = _docs(spark, [*CODE, *DOCS, (8, "\n".join("ab c" * 3 for _ in range(20))), (9, "only text")])
    once = docs.where("doc_id is null or doc_id <> 4")
    got = _rows(blocks.dedent_code(docs))
    assert got == _rows(blocks.dedent_blocks(views.code_lines(views.lines(docs)))) and len(got) > 100
    lines = views.code_line_arrays(once.where("text is not null")).select("doc_id", F.posexplode("codes").alias("line", "text"))
    assert _rows(lines) == _rows(views.code_lines(views.lines(once)))
    assert _exchanges(blocks.dedent_code(_docs(spark, CODE))) == 0


def test_dedent_of_lines_that_are_no_code_lines(spark):
    """Bodies that begin shallow, end at shallower lines, hold blanks, or are empty."""
    texts = ["x", "def a():", "    one", "  ", "      two", "  out", "    gone", "class B:", "def c():", "flat", "  deep", "", "async def d():"]
    arrays = spark.createDataFrame([(1, texts), (2, ["def e():"]), (3, [])], "doc_id long, codes array<string>")
    flat = arrays.select("doc_id", F.posexplode("codes").alias("line", "text"))
    got = _rows(blocks.dedent_arrays(arrays))
    assert got == _rows(blocks.dedent_blocks(flat)) == sorted(map(repr, [
        (1, 1, 2, "one"), (1, 1, 3, "  "), (1, 1, 4, "  two"), (1, 8, 9, "flat"), (1, 8, 10, "  deep"), (1, 8, 11, "")]))
