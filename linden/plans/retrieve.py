"""Queries: word segmentation, extra predictions, final ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.operators import candidates as cd
from linden.operators import dictionary as dct
from linden.operators import ngrams
from linden.operators import retrieve as rt
from linden.plans import ranking
from linden.plans import sql as q
from linden.plans.common import code_tokens, documents
from linden.plans.registry import register
from linden.session import materialize
from linden.sources import views
from linden.sources.tables import table

SEG_SQL = """tot AS (SELECT CAST(sum(f) AS DOUBLE) AS n FROM vocab),
subs AS (
  SELECT part, j, i, substr(part, i + 1, j - i) AS w FROM (
    SELECT part, j, unnest(range(0, j)) AS i FROM (SELECT part, unnest(range(1, length(part) + 1)) AS j FROM parts))
),
scored AS (
  SELECT s.part, s.j, s.i, coalesce(ln(v.f / tot.n), ln(10.0 / (tot.n * power(10.0, length(s.w))))) AS s
  FROM subs s LEFT JOIN vocab v ON v.w = s.w, tot
),
dp AS (
  SELECT part, list_reduce(list({'j': j, 'i': i, 's': s} ORDER BY j, i), lambda acc, e:
    CASE WHEN len(acc.best) = e.j THEN {'best': list_append(acc.best, acc.best[e.i + 1] + e.s), 'back': list_append(acc.back, e.i)}
         WHEN acc.best[e.i + 1] + e.s > acc.best[e.j + 1]
           THEN {'best': list_append(acc.best[1:e.j], acc.best[e.i + 1] + e.s), 'back': list_append(acc.back[1:e.j], e.i)}
         ELSE acc END, {'best': [0.0], 'back': [0]}).back AS back
  FROM scored GROUP BY part
),
seg AS (
  SELECT part, list_reduce(range(1, length(part) + 1), lambda acc, x:
    CASE WHEN acc.pos > 0 THEN {'pos': back[acc.pos + 1],
      'words': list_prepend(substr(part, back[acc.pos + 1] + 1, acc.pos - back[acc.pos + 1]), acc.words)} ELSE acc END,
    {'pos': length(part), 'words': []::VARCHAR[]}).words AS words
  FROM dp
)"""


def _vocab(spark, sf):
    return dct.vocabulary(table(spark, sf, "documents").select("text"))


@register("segment_words", q.with_(q.VOCAB, q.LINES, q.CODE_LINES, q.CODE_TOKENS, """parts AS (
  SELECT DISTINCT part FROM (SELECT unnest(string_split(t, '_')) AS part FROM ctokens WHERE kind = 'NAME') WHERE length(part) > 0
)""", SEG_SQL) + """
SELECT part, array_to_string(words, ' ') AS segmentation, CAST(len(words) AS INTEGER) AS n_words FROM seg
""")
def segment_words(spark, sf):
    t = code_tokens(spark, sf).where(F.col("kind") == lx.KIND_NAME)
    parts = t.select(F.explode(F.split("t", "_", -1)).alias("part"))
    # The vocabulary is read twice (its total and the substring join).
    s = rt.segment_parts(parts, materialize(_vocab(spark, sf), "vocabulary"))
    return s.select("part", F.array_join("words", " ").alias("segmentation"), F.size("words").alias("n_words"))


EXTRA_SQL = q.with_(q.VOCAB, *ranking.BASE[:4], """typed AS (
  SELECT doc_id, line, pos, substr(t, 1, 3) AS text FROM pos WHERE length(t) > 3
)""", """top AS (
  SELECT substr(w, 1, 3) AS text, w AS c, row_number() OVER (PARTITION BY substr(w, 1, 3) ORDER BY f DESC, w) AS rank
  FROM vocab WHERE length(w) >= 4 QUALIFY rank <= 6
)""", """words AS (
  SELECT t.doc_id, t.line, t.pos, p.c, 'word' AS source, 990 - p.rank + 1 AS s, 0 AS prio FROM typed t JOIN top p ON p.text = t.text
)""", """idx AS (
  SELECT doc_id, t AS c, line AS l, substr(t, 1, 3) AS text FROM ctokens WHERE kind = 'NAME' AND length(t) >= 4
)""", """toks AS (
  SELECT doc_id, line, pos, c, 'token' AS source, 980 - row_number() OVER (PARTITION BY doc_id, line, pos ORDER BY dist, c) + 1 AS s, 1 AS prio
  FROM (SELECT t.doc_id, t.line, t.pos, i.c, min(abs(i.l - t.line)) AS dist FROM typed t
        JOIN idx i ON i.doc_id = t.doc_id AND i.text = t.text GROUP BY 1, 2, 3, 4)
)""", """dedup AS (
  SELECT doc_id, line, pos, c, source, s, prio FROM (SELECT * FROM words UNION ALL SELECT * FROM toks)
  QUALIFY row_number() OVER (PARTITION BY doc_id, line, pos, c ORDER BY prio) = 1
)""", """parts AS (SELECT DISTINCT unnest(string_split(text, '_')) AS part FROM typed)""", SEG_SQL, """snake AS (
  SELECT doc_id, line, pos, array_to_string(flatten(list(CASE WHEN part = '' THEN [''] ELSE words END ORDER BY k)), '_') AS c
  FROM (SELECT t.doc_id, t.line, t.pos, x.k, x.part, g.words FROM (
          SELECT doc_id, line, pos, CAST(generate_subscripts(ps, 1) AS INTEGER) AS k, unnest(ps) AS part
          FROM (SELECT doc_id, line, pos, string_split(text, '_') AS ps FROM typed)) x
        JOIN typed t ON t.doc_id = x.doc_id AND t.line = x.line AND t.pos = x.pos
        LEFT JOIN seg g ON g.part = x.part)
  GROUP BY doc_id, line, pos
)""")


@register("extra_predictions", EXTRA_SQL + """
SELECT doc_id, line, pos, c, source, CAST(s AS INTEGER) AS s FROM dedup
UNION ALL
SELECT n.doc_id, n.line, n.pos, n.c, 'word-segment' AS source, 1 AS s FROM snake n
WHERE n.c <> '' AND (SELECT count(*) FROM dedup d WHERE d.doc_id = n.doc_id AND d.line = n.line AND d.pos = n.pos) < 6
  AND NOT EXISTS (SELECT 1 FROM dedup d WHERE d.doc_id = n.doc_id AND d.line = n.line AND d.pos = n.pos AND d.c = n.c)
""")
def extra_predictions(spark, sf):
    # The token table feeds the typed texts, the prefix index and the
    # segmentation: written once, read by every branch.
    t = materialize(code_tokens(spark, sf), "code-tokens")
    return rt.extra_predictions(cd.positions(t), t, _vocab(spark, sf))


@register("rank_candidates")
def rank_candidates(spark, sf):
    t = code_tokens(spark, sf)
    scored = cd.frequency_scored(cd.candidates(t), ngrams.unigram_counts(t))
    return rt.rank_candidates(scored, F.substring("t", 1, 1))


_CHECKS = " AND ".join(f"(regexp_matches(s, {q.lit(rx)}) = regexp_matches(cur_text, {q.lit(rx)}))"
                       for rx in rt.CONSISTENCY_CHECKS)
_END = """(SELECT CASE WHEN r.p >= 0 THEN r.p ELSE length(s) END FROM (SELECT list_reduce(
  list_transform(range(0, length(s)), lambda i: {'c': substr(s, i + 1, 1), 'i': CAST(i AS INTEGER)}),
  lambda acc, x: CASE WHEN acc.p >= 0 OR x.i < idx THEN acc
    WHEN x.c IN ('(', '[', '{') THEN {'st': list_append(acc.st, CASE x.c WHEN '(' THEN ')' WHEN '[' THEN ']' ELSE '}' END), 'p': acc.p}
    WHEN coalesce(x.c = acc.st[-1], false) THEN {'st': acc.st[1:len(acc.st) - 1], 'p': acc.p}
    WHEN len(acc.st) = 0 AND contains(',)]}', x.c) THEN {'st': acc.st, 'p': x.i}
    ELSE acc END, {'st': []::VARCHAR[], 'p': -1}) AS r))"""


@register("full_statement", q.with_(*ranking.BASE[:4], """q AS (
  SELECT p.doc_id, p.line, p.pos, p.t, c.text AS cur_text, o.k, p.line + o.d AS source_line
  FROM pos p JOIN code_lines c ON c.doc_id = p.doc_id AND c.line = p.line,
  (SELECT CAST(generate_subscripts(ds, 1) - 1 AS INTEGER) AS k, unnest(ds) AS d
   FROM (SELECT list_concat(""" + ", ".join(f"[-{j}, {j}]" for j in range(1, rt.STATEMENT_SCAN + 1)) + """) AS ds)) o
)""", """j AS (
  SELECT q.*, l.text AS s, strpos(l.text, q.t) - 1 AS idx, strpos(l.text, '#') - 1 AS hash_at
  FROM q JOIN code_lines l ON l.doc_id = q.doc_id AND l.line = q.source_line
)""", f"""hits AS (
  SELECT * FROM j WHERE idx >= 0 AND NOT (hash_at >= 0 AND idx > hash_at)
    AND NOT (idx > 0 AND regexp_matches(substr(s, idx, 1), '^[A-Za-z0-9_]$'))
    AND NOT regexp_matches(s, {q.lit(rt.IMPORT_CHECK)}) AND {_CHECKS}
    AND (length(substr(s, 1, idx)) - length(regexp_replace(substr(s, 1, idx), '["'']', '', 'g'))) % 2 = 0
    AND length(t) + idx + 1 < length(s)
)""", """best AS (
  SELECT doc_id, line, pos, t, arg_min({'source_line': source_line, 's': s, 'idx': idx}, k) AS b FROM hits GROUP BY 1, 2, 3, 4
)""") + """
SELECT doc_id, line, pos, t, b.source_line AS source_line,
  substr(b.s, b.idx + 1, """ + _END.replace("length(s)", "length(b.s)").replace("substr(s,", "substr(b.s,")
    .replace("x.i < idx", "x.i < b.idx") + """ - b.idx) AS statement
FROM best
""")
def full_statement(spark, sf):
    whole, rest = views.whole_documents(documents(spark, sf))
    found = rt.document_full_statement(views.code_line_arrays(whole))
    if rest is None:
        return found
    lines = views.code_lines(views.lines(rest))
    return found.unionByName(rt.full_statement(cd.positions(views.tokens(lines)).select("doc_id", "line", "pos", "t"), lines))
