"""Queries: scans, tokenising and n-gram statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.operators import ngrams
from linden.plans import sql as q
from linden.plans.common import doc_lines, doc_tokens, documents
from linden.plans.registry import register
from linden.sources.tables import table


@register("line_scan", q.with_(q.LINES) + """
SELECT doc_id, line, text, CAST(length(text) AS INTEGER) AS n_chars FROM lines
""")
def line_scan(spark, sf):
    return doc_lines(spark, sf).withColumn("n_chars", F.length("text"))


@register("corpus_scan", """
SELECT doc_id, source, lang, n_chars FROM documents
WHERE n_chars > 100 AND n_chars < 100000
  AND source NOT LIKE '%/.%' AND source NOT LIKE '%\\_\\_%' ESCAPE '\\'
""")
def corpus_scan(spark, sf):
    from linden.operators.corpus import corpus_filter
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return corpus_filter(docs, path_col="source", size_col="n_chars")


@register("tokenize", q.with_(q.LINES, q.TOKENS) + """
SELECT doc_id, line, pos, kind, t FROM tokens
""")
def tokenize(spark, sf):
    return doc_tokens(spark, sf)


@register("token_filter", q.with_(q.LINES, q.TOKENS, q.STAT, q.NGRAMS) + """
SELECT doc_id, line, pos, t2, t1, t0 FROM ngr
""")
def token_filter(spark, sf):
    return ngrams.ngram_rows(documents(spark, sf))


@register("token_counts", q.with_(q.LINES, q.TOKENS, q.STAT, q.NGRAMS) + """
SELECT t0, count(*) AS n FROM ngr GROUP BY t0
""")
def token_counts(spark, sf):
    return ngrams.token_counts(documents(spark, sf))


@register("bigram_counts", q.with_(q.LINES, q.TOKENS, q.STAT, q.NGRAMS) + """
SELECT t1, t0, count(*) AS n FROM ngr GROUP BY t1, t0
""")
def bigram_counts(spark, sf):
    return ngrams.bigram_counts(documents(spark, sf))


@register("trigram_counts", q.with_(q.LINES, q.TOKENS, q.STAT, q.NGRAMS) + """
SELECT t2, t1, t0, count(*) AS n FROM ngr GROUP BY t2, t1, t0
""")
def trigram_counts(spark, sf):
    return ngrams.trigram_counts(documents(spark, sf))


_PRUNE_SQL = q.with_(q.LINES, q.TOKENS, q.STAT, q.NGRAMS, """tri AS (
  SELECT t2, t1, t0, count(*) AS n FROM ngr GROUP BY t2, t1, t0
)""", """bi AS (SELECT t1, t0, CAST(sum(n) AS BIGINT) AS n FROM tri GROUP BY t1, t0)""",
    """uni AS (SELECT t0, CAST(sum(n) AS BIGINT) AS n FROM tri GROUP BY t0)""")


PRUNE_SQL = _PRUNE_SQL + f"""
SELECT 'trigram' AS gram, t2, t1, t0, n FROM tri WHERE n > (SELECT max(n) FROM tri) * {lx.PRUNE_RATIO_TRIGRAM}
UNION ALL
SELECT 'bigram' AS gram, '' AS t2, t1, t0, n FROM bi WHERE n > (SELECT max(n) FROM bi) * {lx.PRUNE_RATIO_BIGRAM}
UNION ALL
SELECT 'token' AS gram, '' AS t2, '' AS t1, t0, n FROM uni WHERE n > (SELECT max(n) FROM uni) * {lx.PRUNE_RATIO_TOKEN}
"""


@register("prune_counts", PRUNE_SQL)
def prune_counts(spark, sf):
    p = ngrams.pruned_statistics(documents(spark, sf), materialize=True)
    e = F.lit("")
    return (
        p["trigram"].select(F.lit("trigram").alias("gram"), "t2", "t1", "t0", "n")
        .unionByName(p["bigram"].select(F.lit("bigram").alias("gram"), e.alias("t2"), "t1", "t0", "n"))
        .unionByName(p["token"].select(F.lit("token").alias("gram"), e.alias("t2"), e.alias("t1"), "t0", "n"))
    )


@register("token_context", q.with_(q.LINES, q.TOKENS, q.TOKEN_CONTEXT) + """
SELECT doc_id, line, pos, t0, t1, t2, t3 FROM tctx
""")
def token_context(spark, sf):
    return ngrams.token_context(documents(spark, sf))
