"""Queries: vocabularies, dictionaries, postings and n-gram lookups."""

from __future__ import annotations

from linden.operators import dictionary as dct
from linden.operators import lookup, ngrams
from linden.plans import sql as q
from linden.plans.common import doc_tokens, documents
from linden.plans.registry import register
from linden.sources.tables import table

# --- fixed values: query parameters -------------------------------------------------
LOOKUP_PREFIX = "th"
LOOKUP_LINE = 5


def _vocab(spark, sf):
    return dct.vocabulary(table(spark, sf, "documents").select("text"))


def _dict(spark, sf):
    return dct.vocabulary(table(spark, sf, "benchmark").select("text"))


@register("prefix_top6", q.with_(q.VOCAB) + """
SELECT p, w, f, rank FROM (
  SELECT substr(w, 1, 3) AS p, w, f,
         CAST(row_number() OVER (PARTITION BY substr(w, 1, 3) ORDER BY f DESC, w) AS INTEGER) AS rank
  FROM vocab WHERE length(w) >= 4
) WHERE rank <= 6
""")
def prefix_top6(spark, sf):
    return dct.prefix_top(_vocab(spark, sf))


@register("unknown_words", q.with_(q.VOCAB, q.DICT) + """
SELECT w, f FROM vocab WHERE w NOT IN (SELECT w FROM dict)
""")
def unknown_words(spark, sf):
    return dct.unknown_words(_vocab(spark, sf), _dict(spark, sf))


@register("prefix_anti", q.with_(q.VOCAB, q.DICT) + """
SELECT v.w, v.f FROM vocab v
WHERE length(v.w) >= 3
  AND NOT EXISTS (SELECT 1 FROM dict d WHERE length(d.w) >= 4 AND starts_with(d.w, v.w))
""")
def prefix_anti(spark, sf):
    return dct.not_a_prefix(_vocab(spark, sf), _dict(spark, sf))


@register("dict_union", q.with_(q.VOCAB, q.DICT) + """
SELECT w FROM vocab UNION SELECT w FROM dict
""")
def dict_union(spark, sf):
    return dct.union_words(_vocab(spark, sf), _dict(spark, sf))


@register("vocab_intersect", q.with_(q.VOCAB, q.DICT) + """
SELECT w FROM vocab INTERSECT SELECT w FROM dict
""")
def vocab_intersect(spark, sf):
    return dct.intersect_words(_vocab(spark, sf), _dict(spark, sf))


@register("plural_pairs", q.with_(q.VOCAB) + """
SELECT s.w AS singular, p.w AS plural FROM vocab p JOIN vocab s ON p.w = s.w || 's'
""")
def plural_pairs(spark, sf):
    return dct.plural_pairs(_vocab(spark, sf))


@register("postings", q.with_(q.LINES, q.TOKENS) + """
SELECT doc_id, t, line, count(*) AS n FROM tokens GROUP BY doc_id, t, line
""")
def postings(spark, sf):
    return lookup.document_postings(documents(spark, sf))


@register("token_min_max", q.with_(q.LINES, q.TOKENS) + """
SELECT doc_id, t, min(line) AS min_line, max(line) AS max_line
FROM tokens WHERE kind = 'NAME' AND length(t) >= 4 GROUP BY doc_id, t
""")
def token_min_max(spark, sf):
    return lookup.token_min_max(doc_tokens(spark, sf))


@register("prefix_lookup", q.with_(q.LINES, q.TOKENS) + f"""
SELECT DISTINCT doc_id, t FROM tokens
WHERE kind = 'NAME' AND length(t) >= 4 AND starts_with(t, '{LOOKUP_PREFIX}')
""")
def prefix_lookup(spark, sf):
    return lookup.prefix_lookup(doc_tokens(spark, sf), LOOKUP_PREFIX)


@register("prefix_nearest", q.with_(q.LINES, q.TOKENS) + f"""
SELECT doc_id, t, dist, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY dist, t) AS INTEGER) AS rank
FROM (
  SELECT doc_id, t, min(abs(line - {LOOKUP_LINE})) AS dist FROM tokens
  WHERE kind = 'NAME' AND length(t) >= 4 AND starts_with(t, '{LOOKUP_PREFIX}')
  GROUP BY doc_id, t
)
""")
def prefix_nearest(spark, sf):
    return lookup.prefix_nearest(doc_tokens(spark, sf), LOOKUP_PREFIX, LOOKUP_LINE)


@register("nearest_ngram", q.with_(q.LINES, q.TOKENS, q.TOKEN_CONTEXT) + """
SELECT doc_id, line, pos,
  CAST(coalesce(line - lag(line) OVER (PARTITION BY doc_id, t1, t0 ORDER BY line, pos), 99999) AS INTEGER) AS t1_match,
  CAST(CASE WHEN t2 = '' THEN 99999 ELSE coalesce(line - lag(line) OVER (PARTITION BY doc_id, t2, t0 ORDER BY line, pos), 99999) END AS INTEGER) AS t2_match,
  CAST(CASE WHEN t3 = '' THEN 99999 ELSE coalesce(line - lag(line) OVER (PARTITION BY doc_id, t3, t0 ORDER BY line, pos), 99999) END AS INTEGER) AS t3_match,
  CAST(CASE WHEN t2 = '' THEN 99999 ELSE coalesce(line - lag(line) OVER (PARTITION BY doc_id, t2, t1, t0 ORDER BY line, pos), 99999) END AS INTEGER) AS trigram_match
FROM tctx
""")
def nearest_ngram(spark, sf):
    return lookup.nearest_ngram(documents(spark, sf))


@register("ngram_lookup", q.with_(q.LINES, q.TOKENS, q.STAT, q.NGRAMS, q.PRUNED, q.TOKEN_CONTEXT) + """
SELECT c.doc_id, c.line, c.pos,
  coalesce(u.n, 0) AS token_frequency,
  CASE WHEN c.t1 <> '' THEN coalesce(b.n, 0) ELSE 0 END AS bigram_frequency,
  CASE WHEN c.t1 <> '' AND c.t2 <> '' THEN coalesce(r.n, 0) ELSE 0 END AS trigram_frequency
FROM tctx c
LEFT JOIN puni u ON u.t0 = c.t0
LEFT JOIN pbi b ON b.t1 = c.t1 AND b.t0 = c.t0
LEFT JOIN ptri r ON r.t2 = c.t2 AND r.t1 = c.t1 AND r.t0 = c.t0
""")
def ngram_lookup(spark, sf):
    docs = documents(spark, sf)
    return lookup.ngram_lookup(ngrams.token_context(docs), ngrams.pruned_statistics(docs, materialize=True))
