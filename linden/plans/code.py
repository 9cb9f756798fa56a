"""Queries over the code-shaped line view: outline, indentation, imports,
references, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.operators import code
from linden.plans import sql as q
from linden.plans.common import code_lines, doc_lines
from linden.plans.registry import register
from linden.session import materialize
from linden.sources.views import line_tokens

P = q.lit(code.OUTLINE_PATTERN)
WS = "' ' || chr(9)"

OUTLINE = f"""outline AS (
  SELECT doc_id, line, CAST(length(regexp_extract(text, {P}, 1)) AS INTEGER) AS indent,
         length(regexp_extract(text, {P}, 1)) / {code.INDENT_UNIT} AS level,
         CASE WHEN regexp_extract(text, {P}, 2) <> '' THEN 'async' ELSE regexp_extract(text, {P}, 3) END AS kind,
         regexp_extract(text, {P}, 4) AS name
  FROM code_lines WHERE regexp_matches(text, {P})
)"""

PARENT = """parented AS (
  SELECT o.doc_id, o.line, o.indent, o.level, o.kind, o.name,
         arg_max(p.line, p.line) AS parent_line, arg_max(p.name, p.line) AS parent_name,
         arg_max(p.kind, p.line) AS parent_kind
  FROM outline o LEFT JOIN outline p ON p.doc_id = o.doc_id AND p.line < o.line AND p.level < o.level
  GROUP BY o.doc_id, o.line, o.indent, o.level, o.kind, o.name
)"""


def _outline(spark, sf):
    return code.outline(code_lines(spark, sf))


def _parented(spark, sf):
    # Outline rows are read by the level probe and by every per-level
    # look-back: written once.
    items = materialize(_outline(spark, sf), "outline")
    # Distinct indentation levels: a tiny aggregate (bounded by line width).
    levels = [r[0] for r in items.select("level").distinct().collect()]
    return code.outline_parent(items, levels)


@register("code_lines", q.with_(q.LINES, q.CODE_LINES) + """
SELECT doc_id, line, text FROM code_lines
""")
def code_lines_q(spark, sf):
    return code_lines(spark, sf)


@register("outline", q.with_(q.LINES, q.CODE_LINES, OUTLINE) + """
SELECT * FROM outline
""")
def outline(spark, sf):
    return _outline(spark, sf)


@register("outline_parent", q.with_(q.LINES, q.CODE_LINES, OUTLINE, PARENT) + """
SELECT *, coalesce(parent_kind = 'class', false) AS is_method FROM parented
""")
def outline_parent(spark, sf):
    return _parented(spark, sf)


@register("enclosing_item", q.with_(q.LINES, q.CODE_LINES, OUTLINE) + """
SELECT l.doc_id, l.line,
  last_value(o.line IGNORE NULLS) OVER w AS item_line,
  last_value(o.name IGNORE NULLS) OVER w AS item_name
FROM code_lines l LEFT JOIN outline o ON o.doc_id = l.doc_id AND o.line = l.line
WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def enclosing_item(spark, sf):
    return code.enclosing_item(code_lines(spark, sf), _outline(spark, sf))


@register("class_without_init", q.with_(q.LINES, q.CODE_LINES, OUTLINE, PARENT) + """
SELECT doc_id, line, name FROM parented c WHERE kind = 'class'
  AND NOT EXISTS (SELECT 1 FROM parented m WHERE m.doc_id = c.doc_id AND m.parent_line = c.line
                  AND m.name = '__init__' AND m.parent_kind = 'class')
""")
def class_without_init(spark, sf):
    return code.class_without_init(_parented(spark, sf))


INDENTS = f"""ind AS (
  SELECT doc_id, line, text, CAST(length(text) - length(ltrim(text, {WS})) AS INTEGER) AS indent FROM code_lines
),
deltas AS (
  SELECT doc_id, line, indent, indent - coalesce(last_value(CASE WHEN text <> '' THEN indent END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS indent_delta
  FROM ind
)"""


@register("indent_delta", q.with_(q.LINES, q.CODE_LINES, INDENTS) + """
SELECT * FROM deltas
""")
def indent_delta(spark, sf):
    return code.indent_delta(code_lines(spark, sf))


@register("detect_indent", q.with_(q.LINES, q.CODE_LINES, INDENTS) + """
SELECT doc_id, indent_unit, n FROM (
  SELECT doc_id, indent_unit, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, indent_unit) AS r
  FROM (SELECT doc_id, abs(indent_delta) AS indent_unit, count(*) AS n FROM deltas WHERE indent_delta <> 0 GROUP BY 1, 2)
) WHERE r = 1
""")
def detect_indent(spark, sf):
    return code.detect_indent(code_lines(spark, sf))


@register("blank_before", q.with_(q.LINES) + f"""
SELECT doc_id, line,
  CASE WHEN line <= 1 THEN 0 ELSE line - 1 - coalesce(last_value(CASE WHEN trim(text, {WS}) <> '' AND line >= 1 THEN line END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS blank_line_before
FROM lines
""")
def blank_before(spark, sf):
    return code.blank_before(doc_lines(spark, sf))


@register("prev_line_end", q.with_(q.LINES) + "SELECT l.doc_id, l.line, " + ", ".join(
    f"CASE WHEN l.line >= 1 AND coalesce(length(p.text), 0) > 0 AND right(p.text, 1) = {q.lit(c)} THEN 1 ELSE 0 END "
    f"AS \"last_line_ends_with_{c}\"" for c in lx.LINE_END_CHARS) + """
FROM lines l LEFT JOIN lines p ON p.doc_id = l.doc_id AND p.line = l.line - 1
""")
def prev_line_end(spark, sf):
    return code.prev_line_end(doc_lines(spark, sf))


IMPORTS_CTE = """imps AS (
SELECT doc_id, line, i, CASE WHEN prefix <> '' THEN prefix || '.' || m ELSE m END AS module FROM (
  SELECT doc_id, line, prefix, CAST(generate_subscripts(ms, 1) - 1 AS INTEGER) AS i, trim(unnest(ms)) AS m FROM (
    SELECT doc_id, line, regexp_extract(text, '^\\s*from\\s+(\\S+)\\s+import\\s', 1) AS prefix,
      string_split(regexp_replace(string_split(regexp_extract(text, 'import\\s+(.*)$', 1), ' as ')[1], '[()]', '', 'g'), ',') AS ms
    FROM code_lines WHERE regexp_matches(text, '^\\s*(from|import)\\s')
  )
) WHERE m <> '' AND NOT starts_with(m, '.') AND NOT starts_with(prefix, '.')
)"""


@register("imports", q.with_(q.LINES, q.CODE_LINES, IMPORTS_CTE) + "SELECT doc_id, line, i, module FROM imps")
def imports(spark, sf):
    return code.imports(code_lines(spark, sf))


_KW = ", ".join(q.lit(k) for k in lx.PY_KEYWORDS)


@register("references", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS) + f"""
SELECT doc_id, t, count(*) FILTER (WHERE role = 'definition') AS n_def,
  count(*) FILTER (WHERE role = 'assignment') AS n_assign, count(*) FILTER (WHERE role = 'usage') AS n_use
FROM (
  SELECT doc_id, t, CASE WHEN lag(t) OVER w IN ('def', 'class') THEN 'definition'
                         WHEN lead(t) OVER w = '=' THEN 'assignment' ELSE 'usage' END AS role
  FROM ctokens WINDOW w AS (PARTITION BY doc_id, line ORDER BY pos)
) WHERE regexp_matches(t, '^[\\p{{L}}_]') AND t NOT IN ({_KW})
GROUP BY doc_id, t
""")
def references(spark, sf):
    cl = code_lines(spark, sf)
    return code.references(cl.select("doc_id", "line", line_tokens(F.col("text")).alias("toks")))


@register("cells", q.with_(q.LINES, q.CODE_LINES, f"""c1 AS (
  SELECT l.doc_id, l.line, l.text, p.text AS prev_text,
    first_value(CASE WHEN trim(l.text, {WS}) <> '' THEN length(l.text) - length(ltrim(l.text, {WS})) = 0 END IGNORE NULLS)
      OVER (PARTITION BY l.doc_id ORDER BY l.line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_col0
  FROM code_lines l LEFT JOIN code_lines p ON p.doc_id = l.doc_id AND p.line = l.line - 1
)""", f"""starts AS (
  SELECT doc_id, line + 1 AS line FROM c1
  WHERE trim(text, {WS}) = '' AND prev_text IS NOT NULL AND trim(prev_text, {WS}) <> ''
    AND NOT starts_with(ltrim(prev_text, ' '), '#') AND coalesce(next_col0, false)
)""") + """
SELECT l.doc_id, l.line, coalesce(last_value(s.line IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.line
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cell_start
FROM code_lines l LEFT JOIN starts s ON s.doc_id = l.doc_id AND s.line = l.line
""")
def cells(spark, sf):
    return code.cells(code_lines(spark, sf))
