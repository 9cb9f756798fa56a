"""Queries: candidate sets over code lines and their evaluation."""

from __future__ import annotations

from linden.operators import candidates as cd
from linden.operators import ngrams
from linden.plans import sql as q
from linden.plans.common import code_tokens
from linden.plans.registry import register
from linden.session import materialize

BASE = [q.LINES, q.CODE_LINES, q.CODE_TOKENS, """pos AS (
  SELECT doc_id, line, pos, t, substr(t, 1, 1) AS p FROM ctokens
  WHERE kind = 'NAME' AND length(t) >= 2 AND regexp_matches(t, '^[\\p{L}\\p{N}]')
)""", """vocab AS (
  SELECT doc_id, t AS c, min(line) AS first_line, substr(t, 1, 1) AS p FROM ctokens WHERE kind = 'NAME' GROUP BY doc_id, t
)""", """cands AS (
  SELECT p.doc_id, p.line, p.pos, p.t, v.c, CAST(v.c = p.t AS INTEGER) AS y
  FROM pos p JOIN vocab v ON v.doc_id = p.doc_id AND v.p = p.p AND v.first_line < p.line
  WHERE EXISTS (SELECT 1 FROM vocab f WHERE f.doc_id = p.doc_id AND f.c = p.t AND f.first_line < p.line)
)""", """sizes AS (
  SELECT doc_id, line, pos, count(*) AS size, sum(y) AS n_pos FROM cands GROUP BY doc_id, line, pos
)""", """uni AS (
  SELECT t AS c, count(*) AS n FROM ctokens WHERE kind IN ('STRING', 'OP', 'NAME') AND length(t) <= 30 GROUP BY t
)""", """scored AS (
  SELECT c.*, CAST(coalesce(u.n, 0) AS DOUBLE) AS score FROM cands c LEFT JOIN uni u ON u.c = c.c
)"""]
SQL = q.with_(*BASE)


@register("dot_candidates", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, """after_dot AS (
  SELECT doc_id, line, pos, name, t FROM (
    SELECT doc_id, line, pos, kind, t, lag(t) OVER w AS dot, lag(t, 2) OVER w AS name, lag(kind, 2) OVER w AS name_kind
    FROM ctokens WINDOW w AS (PARTITION BY doc_id, line ORDER BY pos))
  WHERE kind = 'NAME' AND dot = '.' AND name_kind = 'NAME'
)""") + """
SELECT a.doc_id, a.line, a.pos, a.name, a.t, b.t AS c, CAST(a.t = b.t AS INTEGER) AS y
FROM after_dot a JOIN (SELECT DISTINCT doc_id, line, name, t FROM after_dot) b ON b.doc_id = a.doc_id AND b.name = a.name AND b.line < a.line
WHERE EXISTS (SELECT 1 FROM after_dot e WHERE e.doc_id = a.doc_id AND e.name = a.name AND e.t = a.t AND e.line < a.line)
GROUP BY a.doc_id, a.line, a.pos, a.name, a.t, b.t
""")
def dot_candidates(spark, sf):
    return cd.dot_candidates(materialize(code_tokens(spark, sf), "code-tokens"))


def _cands(spark, sf):
    return cd.candidates(code_tokens(spark, sf))


def _scored(spark, sf):
    t = materialize(code_tokens(spark, sf), "code-tokens")
    return cd.frequency_scored(cd.candidates(t), ngrams.unigram_counts(t))


@register("candidates", SQL + "SELECT doc_id, line, pos, t, c, y FROM cands")
def candidates(spark, sf):
    return _cands(spark, sf)


@register("naive_accuracy", SQL + """
SELECT count(s.size) AS successful, count(*) - count(s.size) AS failed, round(avg(1.0 / s.size), 9) AS naive_accuracy
FROM pos p LEFT JOIN sizes s ON s.doc_id = p.doc_id AND s.line = p.line AND s.pos = p.pos
""")
def naive_accuracy(spark, sf):
    t = code_tokens(spark, sf)
    return cd.naive_accuracy(t, cd.candidates(t))


@register("random_baseline", SQL + """
SELECT count(*) AS n_groups, round(sum(1.0 / size), 6) AS expected_hits, round(avg(1.0 / size), 9) AS random_top1,
       count(*) FILTER (WHERE n_pos <> 1) AS bad_groups
FROM sizes
""")
def random_baseline(spark, sf):
    return cd.random_baseline(_cands(spark, sf))


TOP1 = """top AS (
  SELECT doc_id, line, pos, t, arg_min(c, (-score, c)) AS pick, arg_min(y, (-score, c)) AS hit
  FROM scored GROUP BY doc_id, line, pos, t
)"""


@register("top1_accuracy", SQL + "," + TOP1 + """
SELECT count(*) AS n_groups, CAST(sum(hit) AS BIGINT) AS n_correct, round(avg(hit), 9) AS top1_accuracy FROM top
""")
def top1_accuracy(spark, sf):
    return cd.top1_accuracy(_scored(spark, sf))


@register("top1_known_initial", SQL + """,
boosted AS (SELECT doc_id, line, pos, t, c, y,
  score + CASE WHEN substr(c, 1, 1) = substr(t, 1, 1) THEN 0.3 ELSE 0.0 END AS score FROM scored),
top AS (SELECT doc_id, line, pos, arg_min(y, (-score, c)) AS hit FROM boosted GROUP BY doc_id, line, pos, t)
SELECT count(*) AS n_groups, CAST(sum(hit) AS BIGINT) AS n_correct, round(avg(hit), 9) AS top1_accuracy FROM top
""")
def top1_known_initial(spark, sf):
    return cd.top1_accuracy(cd.known_initial(_scored(spark, sf)))


@register("outcome_rollup", SQL + "," + TOP1 + """,
names AS (SELECT doc_id, line, pos, t FROM ctokens WHERE kind = 'NAME' AND regexp_matches(t, '^[\\p{L}\\p{N}]')),
oc AS (
  SELECT CASE WHEN length(n.t) = 1 THEN 'not_required' WHEN tp.hit IS NULL THEN 'not_available'
              WHEN tp.hit = 1 THEN 'correct' ELSE 'wrong' END AS outcome
  FROM names n LEFT JOIN top tp ON tp.doc_id = n.doc_id AND tp.line = n.line AND tp.pos = n.pos
)
SELECT correct, wrong, not_available, not_required,
  round(correct / (correct + wrong), 9) AS accuracy, round(correct / (correct + wrong + not_available), 9) AS success
FROM (SELECT count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'wrong') AS wrong,
             count(*) FILTER (WHERE outcome = 'not_available') AS not_available,
             count(*) FILTER (WHERE outcome = 'not_required') AS not_required FROM oc)
""")
def outcome_rollup(spark, sf):
    t = code_tokens(spark, sf)
    return cd.outcome_rollup(t, cd.frequency_scored(cd.candidates(t), ngrams.unigram_counts(t)))


@register("minmax_scale", SQL + """
SELECT doc_id, line, pos, c, CAST(CASE WHEN mx - mn >= 0.001 THEN trunc(10000 * (score - mn) / (mx - mn)) ELSE score END AS BIGINT) AS scaled
FROM (SELECT *, min(score) OVER g AS mn, max(score) OVER g AS mx FROM scored WINDOW g AS (PARTITION BY doc_id, line, pos))
""")
def minmax_scale(spark, sf):
    s = cd.minmax_scale(_scored(spark, sf), "score", "scaled")
    return s.select("doc_id", "line", "pos", "c", "scaled")


@register("dataset_shape", SQL + """
SELECT count(*) AS n_rows, (SELECT count(*) FROM sizes) AS n_groups, CAST(sum(y) AS BIGINT) AS n_positive, 1 AS n_features FROM cands
""")
def dataset_shape(spark, sf):
    return cd.dataset_shape(_cands(spark, sf), 1)
