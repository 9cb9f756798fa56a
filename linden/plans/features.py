"""Queries: context features, completion features, the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.operators import blocks, code, ngrams
from linden.operators import candidates as cd
from linden.operators import features as ft
from linden.operators import matrix as mx
from linden.plans import code as code_plans
from linden.plans import ranking
from linden.plans import sql as q
from linden.plans.common import code_lines, documents
from linden.plans.registry import register
from linden.plans.search import _MATCH_SQL
from linden.session import materialize, step_tables
from linden.sources import views

WS = "' ' || chr(9)"

STARTS = _MATCH_SQL.replace("{re}", q.TOKEN_RE).replace("FROM lines WHERE", "FROM code_lines WHERE")
STARTS = STARTS.replace("pieces AS", "tpieces AS").replace("FROM pieces", "FROM tpieces") \
    .replace("mrows AS", "tmrows AS").replace("FROM mrows", "FROM tmrows").replace("matches AS (", "tstarts AS (") \
    .replace("SELECT doc_id, line, text, match,", "SELECT doc_id, line, text, CAST(i - 1 AS INTEGER) AS pos, match,")

CALL = ("coalesce(CASE WHEN stack[-1] IS NULL THEN '' ELSE regexp_extract(substr(head, 1, stack[-1]), "
        + q.lit(ft.CALL_NAME) + ", 1) END, '')")
STACK = ("list_reduce(list_transform(range(0, length(head)), lambda i: {'c': substr(head, i + 1, 1), 'i': CAST(i AS INTEGER)}), "
         "lambda acc, x: CASE WHEN x.c = '(' THEN list_append(acc, x.i) "
         "WHEN x.c = ')' AND len(acc) > 0 THEN acc[1:len(acc) - 1] ELSE acc END, []::INTEGER[])")

CTX_ROWS = f"""pctx AS (
  SELECT p.doc_id, p.line, p.pos, p.t, s.start, l.text, pl.text AS prev_text,
         substr(l.text, 1, s.start + 1) AS head, bb.blank_line_before, d.indent, d.indent_delta
  FROM pos p
  JOIN tstarts s ON s.doc_id = p.doc_id AND s.line = p.line AND s.pos = p.pos
  JOIN code_lines l ON l.doc_id = p.doc_id AND l.line = p.line
  LEFT JOIN code_lines pl ON pl.doc_id = p.doc_id AND pl.line = p.line - 1
  JOIN deltas d ON d.doc_id = p.doc_id AND d.line = p.line
  JOIN (SELECT doc_id, line, CASE WHEN line <= 1 THEN 0 ELSE line - 1 - coalesce(last_value(CASE WHEN trim(text, {WS}) <> '' AND line >= 1 THEN line END IGNORE NULLS)
          OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS blank_line_before
        FROM code_lines) bb ON bb.doc_id = p.doc_id AND bb.line = p.line
),
pctx2 AS (SELECT *, {STACK} AS stack FROM pctx),
pctx3 AS (SELECT *, {CALL} AS call FROM pctx2)"""


def _context_cols() -> str:
    cols = ["blank_line_before", "line AS line_number", "indent", "indent_delta",
            "CASE WHEN ltrim(head, ' ') = '' THEN 1 ELSE 0 END AS at_line_start"]
    cols += [f"CASE WHEN strpos(head, {q.lit(c)}) > 0 THEN 1 ELSE 0 END AS \"left_char_is_{c}\"" for c in lx.LEFT_CHARS]
    cols += [f"CASE WHEN line >= 1 AND coalesce(length(prev_text), 0) > 0 AND right(prev_text, 1) = {q.lit(c)} "
             f"THEN 1 ELSE 0 END AS \"last_line_ends_with_{c}\"" for c in lx.LINE_END_CHARS]
    cols += [f"CAST(call = {q.lit(f)} AS INTEGER) AS \"in_function_{f}\"" for f in lx.IN_FUNCTION_FEATURES]
    cols += [f"CAST(regexp_matches(head, {q.lit(rx)}) AS INTEGER) AS \"{n}\"" for n, rx in ft.HEAD_PATTERNS]
    return ",\n  ".join(cols)


CONTEXT_SQL = q.with_(*ranking.BASE[:5], code_plans.INDENTS, STARTS, CTX_ROWS) + \
    "SELECT doc_id, line, pos,\n  " + _context_cols() + "\nFROM pctx3"


def _ctx_rows(spark, sf):
    lines, t = _inputs(spark, sf)
    pos = cd.positions(t).select(*ft.GROUP, "t")
    return ft.positions_with_context(lines, pos)


@register("context_features", CONTEXT_SQL)
def context_features(spark, sf):
    return ft.context_features(_ctx_rows(spark, sf))


# ---- completion features -------------------------------------------------------------

CODE_STAT = q.STAT.replace("FROM tokens", "FROM ctokens")
CODE_TCTX = q.TOKEN_CONTEXT.replace("FROM tokens", "FROM ctokens").replace("tl AS (", "ctl AS (") \
    .replace("LEFT JOIN tl p", "LEFT JOIN ctl p").replace("tctx AS (", "ctctx AS (")

P = q.lit(ft.LITERAL_ASSIGN)
NAMES_SQL = f"""{code_plans.OUTLINE},
{code_plans.IMPORTS_CTE},
ranks AS (
  SELECT doc_id, c, min(rank) AS rank FROM (
    SELECT doc_id, name AS c, CASE WHEN kind = 'class' THEN 1 ELSE 2 END AS rank FROM outline
    UNION ALL SELECT doc_id, string_split(module, '.')[-1] AS c, 3 AS rank FROM imps
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_extract(text, '\\((.*)\\)', 1), {q.lit(ft.PARAM_NAME)}, 1)) AS c, 4 AS rank
      FROM code_lines WHERE regexp_matches(text, '^\\s*(async\\s+)?def\\s')
    UNION ALL SELECT doc_id, regexp_extract(text, {P}, 1) AS c, 5 AS rank FROM code_lines WHERE regexp_matches(text, {P})
  ) GROUP BY doc_id, c
),
lits AS (
  SELECT doc_id, c, arg_max(dtype, line) AS dtype FROM (
    SELECT doc_id, line, regexp_extract(text, {P}, 1) AS c, trim(regexp_extract(text, {P}, 2)) AS lit FROM code_lines
    WHERE regexp_matches(text, {P})
  ), LATERAL (SELECT CASE WHEN regexp_matches(lit, '^[bB][''"]') THEN 'bytes' WHEN regexp_matches(lit, '^[''"]') THEN 'str'
      WHEN regexp_matches(lit, '^(True|False)$') THEN 'bool' WHEN regexp_matches(lit, '^\\d+$') THEN 'int'
      WHEN regexp_matches(lit, '^\\d+\\.\\d*$') THEN 'float' WHEN starts_with(lit, '[') THEN 'list'
      WHEN starts_with(lit, '{{') THEN 'dict' WHEN starts_with(lit, '(') THEN 'tuple' END AS dtype)
  GROUP BY doc_id, c
),
nclass AS (
  SELECT n.doc_id, n.c, CASE WHEN n.c IN ({", ".join(q.lit(k) for k in lx.PY_KEYWORDS)}) THEN 'keyword'
    WHEN r.rank = 1 THEN 'class' WHEN r.rank = 2 THEN 'function' WHEN r.rank = 3 THEN 'module'
    WHEN r.rank = 4 THEN 'param' WHEN r.rank = 5 THEN 'statement' ELSE 'instance' END AS ctype, li.dtype
  FROM (SELECT DISTINCT doc_id, t AS c FROM ctokens WHERE kind = 'NAME') n
  LEFT JOIN ranks r ON r.doc_id = n.doc_id AND r.c = n.c
  LEFT JOIN lits li ON li.doc_id = n.doc_id AND li.c = n.c
)"""

MATCHES_SQL = """qrows AS (
  SELECT c.doc_id, c.line, c.pos, c.c, c.y, x.t1, x.t2, x.t3, pc.head
  FROM cands c JOIN ctctx x ON x.doc_id = c.doc_id AND x.line = c.line AND x.pos = c.pos
  JOIN pctx pc ON pc.doc_id = c.doc_id AND pc.line = c.line AND pc.pos = c.pos
),
m AS (
  SELECT q.doc_id, q.line, q.pos, q.c,
    (SELECT q.line - max(p.line) FROM ctctx p WHERE p.doc_id = q.doc_id AND p.t1 = q.t1 AND p.t0 = q.c AND p.line < q.line) AS d1,
    (SELECT q.line - max(p.line) FROM ctctx p WHERE p.doc_id = q.doc_id AND p.t2 = q.t2 AND p.t0 = q.c AND p.line < q.line) AS d2,
    (SELECT q.line - max(p.line) FROM ctctx p WHERE p.doc_id = q.doc_id AND p.t3 = q.t3 AND p.t0 = q.c AND p.line < q.line) AS d3,
    (SELECT q.line - max(p.line) FROM ctctx p WHERE p.doc_id = q.doc_id AND p.t2 = q.t2 AND p.t1 = q.t1 AND p.t0 = q.c AND p.line < q.line) AS d4,
    (SELECT min(q.line - l.line) FROM code_lines l WHERE l.doc_id = q.doc_id AND l.line BETWEEN q.line - 19 AND q.line - 1
       AND l.line >= 1 AND strpos(l.text, q.c) > 0) AS nth,
    (SELECT min(q.line - l.line) FROM code_lines l WHERE l.doc_id = q.doc_id AND l.line BETWEEN q.line - 19 AND q.line - 1
       AND l.line >= 1 AND strpos(lower(l.text), lower(q.c)) > 0) AS nth_lower
  FROM qrows q
)"""


def _completion_cols() -> str:
    cols = [f"CAST(coalesce(n.ctype = {q.lit(t)}, false) AS INTEGER) AS \"{t}\"" for t in ft.CANDIDATE_TYPES]
    cols += [f"CAST(coalesce(n.dtype = {q.lit(t)}, false) AS INTEGER) AS \"{t}\"" for t in ft.DATA_TYPES]
    cols += ["CAST(upper(r.c) = r.c AND lower(r.c) <> r.c AS INTEGER) AS is_upper_case",
             "CAST(lower(r.c) = r.c AND upper(r.c) <> r.c AS INTEGER) AS is_lower_case",
             "CAST(regexp_matches(substr(r.c, 1, 1), '^\\p{Lu}$') AS INTEGER) AS is_initial_upper_case",
             "CAST(contains(r.c, '_') AS INTEGER) AS contains__"]
    cols += [f"CAST(regexp_matches(r.c, {q.lit(rx)}) AS INTEGER) AS \"{nm}\"" for nm, rx in ft.NAME_PATTERNS]
    cols += [f"CAST(r.c = {q.lit(w)} AS INTEGER) AS \"kw_{w}\"" for w in lx.KEYWORD_FEATURES + lx.BUILTIN_FEATURES]
    cols += [f"CAST(r.c IN ({', '.join(q.lit(k) for k in lx.PY_KEYWORDS)}) AS INTEGER) AS is_keyword",
             f"CAST(r.c IN ({', '.join(q.lit(k) for k in lx.PY_BUILTINS)}) AS INTEGER) AS in_builtin_module"]
    for name, fold in (("contains_in_nth_line", ""), ("contains_in_nth_line_lower", "lower")):
        col = "m.nth" if not fold else "m.nth_lower"
        cols.append(f"CAST(CASE WHEN r.line = 0 THEN 99999 WHEN strpos({fold}(r.head), {fold}(r.c)) > 0 THEN 0 "
                    f"ELSE coalesce({col}, 99999) END AS INTEGER) AS {name}")
    cols += ["CAST(coalesce(m.d1, 99999) AS INTEGER) AS t1_match",
             "CAST(CASE WHEN r.t2 = '' THEN 99999 ELSE coalesce(m.d2, 99999) END AS INTEGER) AS t2_match",
             "CAST(CASE WHEN r.t3 = '' THEN 99999 ELSE coalesce(m.d3, 99999) END AS INTEGER) AS t3_match",
             "CAST(CASE WHEN r.t2 = '' THEN 99999 ELSE coalesce(m.d4, 99999) END AS INTEGER) AS trigram_match",
             "coalesce(pu.n, 0) AS token_frequency",
             "CASE WHEN r.t1 <> '' THEN coalesce(pb.n, 0) ELSE 0 END AS bigram_frequency",
             "CASE WHEN r.t1 <> '' AND r.t2 <> '' THEN coalesce(pt.n, 0) ELSE 0 END AS trigram_frequency"]
    return ",\n  ".join(cols)


COMPLETION_SQL = q.with_(*ranking.BASE[:6], code_plans.INDENTS, STARTS, CTX_ROWS, CODE_STAT,
                         q.NGRAMS, q.PRUNED, CODE_TCTX, NAMES_SQL, MATCHES_SQL) + \
    "SELECT r.doc_id, r.line, r.pos, r.c, r.y,\n  " + _completion_cols() + """
FROM qrows r JOIN m ON m.doc_id = r.doc_id AND m.line = r.line AND m.pos = r.pos AND m.c = r.c
LEFT JOIN nclass n ON n.doc_id = r.doc_id AND n.c = r.c
LEFT JOIN puni pu ON pu.t0 = r.c
LEFT JOIN pbi pb ON pb.t1 = r.t1 AND pb.t0 = r.c
LEFT JOIN ptri pt ON pt.t2 = r.t2 AND pt.t1 = r.t1 AND pt.t0 = r.c"""


def _inputs(spark, sf):
    """Code lines and their tokens, written once: every feature branch reads
    them (candidates, context, postings, statistics, name classes)."""
    lines = materialize(code_lines(spark, sf), "code-lines")
    return lines, views.tokens(lines)


def candidate_frame(spark, sf, counted=lambda docs: docs, matrix=False):
    """Candidates with what their completion features are computed from and,
    with ``matrix`` (inside a step), the inputs of the context and similarity
    features; ``counted`` picks the documents whose n-grams count.

    Whole documents give their candidates without a shuffle; those that come
    twice, have no id or are very long go line by line."""
    docs = documents(spark, sf)
    whole, rest = views.whole_documents(docs, most_lines=mx.MOST_LINES)
    positions = mx.positions(views.code_line_arrays(whole))
    if matrix:
        positions = materialize(mx.position_context(positions), "position-context", keep=1)
        rows = mx.offered_rows(positions, F.col("offered"), matrix)
    else:
        rows = mx.candidates(positions)
    if rest is not None:
        rows = rows.unionByName(candidates_by_line(views.code_lines(views.lines(rest)), matrix).select(rows.columns))
    return ft.with_frequencies(rows, ngrams.pruned_statistics(views.code_documents(counted(docs)), materialize=True))


def candidates_by_line(lines, matrix=False):
    """The candidates of lines (doc_id, line, text), by joins."""
    with step_tables(lines.sparkSession, "by-line"):  # the tables of the joins are gone when their result is written
        lines = materialize(lines, "code-lines")
        t = views.tokens(lines)
        cands = cd.candidates(t)
        ctx_rows = materialize(ft.positions_with_context(lines, cd.positions(t).select(*ft.GROUP, "t")), "line-context")
        rows = ft.candidate_rows(cands, lines, t, ngrams.token_context(lines), ctx_rows)
        if matrix:
            rows = materialize(rows, "line-rows")
            inputs = ft.similarity_inputs(cands, t, ctx_rows, blocks.signature_params(lines), code.outline(lines))
            inputs = materialize(inputs.select(*ft.GROUP, "c", *ft.SIMILARITY_INPUTS), "line-similarity")
            rows = rows.join(inputs, [*ft.GROUP, "c"]).join(ft.context_inputs(ctx_rows), ft.GROUP)
        return materialize(rows, "candidates", keep=1)


@register("completion_features", COMPLETION_SQL)
def completion_features(spark, sf):
    return ft.completion_features(candidate_frame(spark, sf))


@register("similarity_features")
def similarity_features(spark, sf):
    lines, t = _inputs(spark, sf)
    ctx_rows = ft.positions_with_context(lines, cd.positions(t).select(*ft.GROUP, "t"))
    return ft.similarity_features(cd.candidates(t), t, ctx_rows, blocks.signature_params(lines), code.outline(lines))


def feature_matrix_frame(spark, sf, counted=lambda docs: docs):
    """Candidates with every completion and similarity feature and the context
    features of their position.  Positions, candidates and candidates with
    their similarities are written one after the other; the statistics are
    gone when the candidates are written."""
    with step_tables(spark, "feature-parts"):
        rows = materialize(candidate_frame(spark, sf, counted, matrix=True), "candidate-rows", keep=1)
        rows = materialize(ft.with_similarity(rows), "similarity", keep=1)
    return ft.feature_matrix(rows)


@register("feature_matrix")
def feature_matrix(spark, sf):
    return feature_matrix_frame(spark, sf)
