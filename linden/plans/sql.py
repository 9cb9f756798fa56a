"""SQL building blocks for the oracle twins (DuckDB dialect).

These restate the derived views of ``linden.sources.views`` in SQL so every
oracle query starts from the raw parquet tables.
"""

from __future__ import annotations

from linden.functions import lexicon as lx


def lit(s: str) -> str:
    """SQL string literal (quotes doubled, backslashes verbatim)."""
    return "'" + s.replace("'", "''") + "'"


TOKEN_RE = lit(lx.TOKEN_PATTERN)
WORD_RE = lit(lx.WORD_PATTERN)

LINES = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line, unnest(parts) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
)"""

KIND_CASE = """CASE WHEN starts_with(t, '#') THEN 'COMMENT'
       WHEN length(t) >= 2 AND (starts_with(t, '"') OR starts_with(t, '''')) THEN 'STRING'
       WHEN regexp_matches(t, '^\\p{N}') THEN 'NUMBER'
       WHEN regexp_matches(t, '^[\\p{L}_]') THEN 'NAME'
       ELSE 'OP' END"""


def tokens_over(src: str, name: str = "tokens") -> str:
    return f"""{name} AS (
  SELECT doc_id, line, pos, {KIND_CASE} AS kind, t FROM (
    SELECT doc_id, line, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos, unnest(ts) AS t
    FROM (SELECT doc_id, line, regexp_extract_all(text, {TOKEN_RE}) AS ts FROM {src})
  )
)"""


TOKENS = tokens_over("lines")

STAT = """stat AS (
  SELECT doc_id, line, pos, t FROM tokens
  WHERE kind IN ('STRING', 'OP', 'NAME') AND length(t) <= 30
)"""

NGRAMS = """ngr AS (
  SELECT doc_id, line, pos,
         coalesce(lag(t, 2) OVER w, '') AS t2, coalesce(lag(t, 1) OVER w, '') AS t1, t AS t0
  FROM stat WINDOW w AS (PARTITION BY doc_id ORDER BY line, pos)
)"""

CODE_LINES = f"""code_words AS (
  SELECT doc_id, line, line % 8 AS m, regexp_extract_all(lower(text), {WORD_RE}) AS ws FROM lines
),
code_lines AS (
  SELECT doc_id, line * 2 AS line,
    CASE m
      WHEN 0 THEN concat('class ', upper(substr(w1, 1, 1)), substr(w1, 2), ':')
      WHEN 1 THEN concat('    def ', w1, '(self, ', w2, '=1):')
      WHEN 2 THEN concat('        ', w1, '_', w2, ' = ', w3, '.', w4, '(', w2, ')')
      WHEN 3 THEN concat('        # ', w1, ' ', w2, ' ', w3)
      WHEN 4 THEN ''
      WHEN 5 THEN concat('from ', w1, ' import ', w2, ', ', w3)
      WHEN 6 THEN concat('for ', w1, ' in ', w2, 's:')
      ELSE concat('    ', w1, '1 = ', w2, '[0].', w3)
    END AS text
  FROM (
    SELECT doc_id, line, m, coalesce(ws[1], 'x') AS w1, coalesce(ws[2], 'x') AS w2,
      coalesce(ws[3], 'x') AS w3, coalesce(ws[4], 'x') AS w4 FROM code_words
  )
  UNION ALL
  SELECT doc_id, line * 2 + 1,
    CASE WHEN len(ws) > n THEN repeat(' ', pad) || '# ' || array_to_string(ws[n + 1:], ' ') ELSE '' END
  FROM (
    SELECT doc_id, line, ws, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 4 THEN 0 WHEN 6 THEN 2 ELSE 3 END AS n,
      CASE m WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 8 WHEN 4 THEN 8 WHEN 7 THEN 4 ELSE 0 END AS pad FROM code_words
  )
)"""

CODE_TOKENS = tokens_over("code_lines", "ctokens")

EDIT_LOG = """edit_log AS (
  SELECT user_id AS doc_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS line,
         event_type AS text, ts, event_id AS seq
  FROM events
)"""

MANIFESTS = """manifest_old AS (
  SELECT CASE WHEN doc_id % 10 = 0 THEN 'old/' ELSE '' END || CAST(doc_id AS VARCHAR) AS path, md5(text) AS hash FROM documents
),
manifest_new AS (
  SELECT CASE WHEN doc_id % 7 = 0 THEN 'new/' ELSE '' END || CAST(doc_id AS VARCHAR) AS path,
         md5(text || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS hash
  FROM documents
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


VOCAB = """vocab AS (
  SELECT w, count(*) AS f FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) GROUP BY w
)"""

DICT = """dict AS (
  SELECT w, count(*) AS f FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM benchmark) GROUP BY w
)"""

TOKEN_CONTEXT = """tl AS (
  SELECT doc_id, line, list(t ORDER BY pos) AS toks FROM tokens GROUP BY doc_id, line
),
tctx AS (
  SELECT t.doc_id, t.line, t.pos, t.t AS t0,
         CASE WHEN t.pos = 0 THEN '' ELSE lag(t.t, 1) OVER w END AS t1,
         CASE WHEN t.pos >= 2 THEN lag(t.t, 2) OVER w
              WHEN t.pos = 1 THEN ''
              ELSE coalesce(p.toks[len(p.toks)], '') END AS t2,
         CASE WHEN t.pos >= 3 THEN lag(t.t, 3) OVER w
              WHEN t.pos = 2 THEN ''
              WHEN t.pos = 1 THEN coalesce(p.toks[len(p.toks)], '')
              ELSE coalesce(CASE WHEN len(p.toks) >= 2 THEN p.toks[len(p.toks) - 1] END, '') END AS t3
  FROM tokens t LEFT JOIN tl p ON p.doc_id = t.doc_id AND p.line = t.line - 1
  WINDOW w AS (PARTITION BY t.doc_id, t.line ORDER BY t.pos)
)"""

PRUNED = """tri AS (SELECT t2, t1, t0, count(*) AS n FROM ngr GROUP BY t2, t1, t0),
bi AS (SELECT t1, t0, CAST(sum(n) AS BIGINT) AS n FROM tri GROUP BY t1, t0),
uni AS (SELECT t0, CAST(sum(n) AS BIGINT) AS n FROM tri GROUP BY t0),
ptri AS (SELECT * FROM tri WHERE n > (SELECT max(n) FROM tri) * 0.005),
pbi AS (SELECT * FROM bi WHERE n > (SELECT max(n) FROM bi) * 0.0005),
puni AS (SELECT * FROM uni WHERE n > (SELECT max(n) FROM uni) * 0.00005)"""
