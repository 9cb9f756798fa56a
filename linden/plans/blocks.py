"""Queries: signatures, dedented bodies, page sections, reflow, first
tokens, lint ordering, nth-line containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.operators import blocks as bl
from linden.operators import candidates as cd
from linden.operators import features as ft
from linden.plans import code as code_plans
from linden.plans import features as fplans
from linden.plans import ranking
from linden.plans import sql as q
from linden.plans.common import code_lines, code_tokens, documents
from linden.plans.registry import register
from linden.sources.tables import table

WS = "' ' || chr(9)"
STEP = """lambda acc, ch: CASE
  WHEN acc.done THEN acc
  WHEN contains('([{', ch) AND acc.d = 0 THEN {'d': 1, 'cur': acc.cur, 'parts': acc.parts, 'done': acc.done}
  WHEN contains('([{', ch) THEN {'d': acc.d + 1, 'cur': acc.cur || ch, 'parts': acc.parts, 'done': acc.done}
  WHEN contains(')]}', ch) AND acc.d = 1 THEN {'d': 0, 'cur': '', 'parts': list_append(acc.parts, acc.cur), 'done': true}
  WHEN contains(')]}', ch) AND acc.d > 1 THEN {'d': acc.d - 1, 'cur': acc.cur || ch, 'parts': acc.parts, 'done': acc.done}
  WHEN ch = ',' AND acc.d = 1 THEN {'d': acc.d, 'cur': '', 'parts': list_append(acc.parts, acc.cur), 'done': acc.done}
  WHEN acc.d >= 1 THEN {'d': acc.d, 'cur': acc.cur || ch, 'parts': acc.parts, 'done': acc.done}
  ELSE acc END"""


@register("signature_params", q.with_(q.LINES, q.CODE_LINES, f"""raw AS (
  SELECT doc_id, line, list_reduce(string_split(text, ''), {STEP},
    {{'d': 0, 'cur': '', 'parts': []::VARCHAR[], 'done': false}}).parts AS raw
  FROM code_lines WHERE regexp_matches(text, '^\\s*(async\\s+)?def\\s')
)""", """sk AS (
  SELECT doc_id, line, CASE WHEN raw[1] = 'self' AND len(raw) > 1 THEN raw[2:] ELSE raw END AS raw FROM raw
)""", """ps AS (
  SELECT doc_id, line, CAST(generate_subscripts(raw, 1) - 1 AS INTEGER) AS i, trim(unnest(raw)) AS p FROM sk
)""") + f"""
SELECT doc_id, line, i, replace(CASE WHEN regexp_extract(p, {q.lit(bl.PARAM_NAME_HEAD)}, 0) = '' THEN p
  ELSE regexp_extract(p, {q.lit(bl.PARAM_NAME_HEAD)}, 0) END, '*', '') AS param
FROM ps WHERE p <> ''
""")
def signature_params(spark, sf):
    return bl.signature_params(code_lines(spark, sf))


@register("dedent", q.with_(q.LINES, q.CODE_LINES, code_plans.OUTLINE, """d AS (
  SELECT l.doc_id, l.line, l.text, o.line IS NOT NULL AS is_item,
    last_value(o.line IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS item_line
  FROM code_lines l LEFT JOIN outline o ON o.doc_id = l.doc_id AND o.line = l.line
)""", f"""d2 AS (
  SELECT d.doc_id, d.line, d.text, d.item_line, coalesce(f.amount, 0) AS amount,
         length(d.text) - length(ltrim(d.text, {WS})) AS indent
  FROM d LEFT JOIN (SELECT doc_id, line - 1 AS item_line, length(text) - length(ltrim(text, {WS})) AS amount FROM code_lines) f
    ON f.doc_id = d.doc_id AND f.item_line = d.item_line
  WHERE d.item_line IS NOT NULL AND NOT d.is_item
)""", f"""d3 AS (
  SELECT *, last_value(CASE WHEN trim(text, {WS}) <> '' AND indent < amount THEN line END IGNORE NULLS)
    OVER (PARTITION BY doc_id, item_line ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM d2
)""") + f"""
SELECT doc_id, item_line, line, CASE WHEN trim(text, {WS}) = '' OR amount = 0 THEN text ELSE substr(text, amount + 1) END AS text
FROM d3 WHERE stop IS NULL
""")
def dedent(spark, sf):
    return bl.dedent_code(documents(spark, sf))


@register("section_shred", f"""
SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS section_no, unnest(parts) AS body FROM (
  SELECT page_id, regexp_split_to_array(html, {q.lit(bl.HEADING_SPLIT)}) AS parts FROM pages
)
""".replace("SELECT page_id, CAST", "SELECT page_id, section_no, regexp_extract(body, " + q.lit(bl.HEADING_TEXT) +
            ", 1) AS heading, CAST(length(body) AS INTEGER) AS n_chars, CAST(len(regexp_extract_all(body, '<a ')) AS INTEGER) AS n_links, "
            "CAST(len(regexp_extract_all(body, " + q.lit(bl.ROLE_PATTERN) + ")) AS INTEGER) AS n_roles FROM (SELECT page_id, CAST", 1)
    .rstrip() + "\n)")
def section_shred(spark, sf):
    return bl.sections(table(spark, sf, "pages").select("page_id", "html"))


@register("reflow", """
SELECT doc_id, CAST(generate_subscripts(paras, 1) - 1 AS INTEGER) AS para, unnest(paras) AS text FROM (
  SELECT doc_id, list_reduce(flags, lambda acc, f: CASE WHEN f.w THEN {'out': acc.out, 'tmp': list_append(acc.tmp, f.l)}
      ELSE {'out': list_append(acc.out, array_to_string(list_append(acc.tmp, f.l), ' ')), 'tmp': []::VARCHAR[]} END,
    {'out': []::VARCHAR[], 'tmp': []::VARCHAR[]}).out AS paras
  FROM (
    SELECT doc_id, list_transform(ls, lambda x, i: {'l': x, 'w':
      i < len(ls) AND length(x) >= width * 0.7
      AND length(x) + CASE WHEN strpos(ls[i + 1], ' ') - 1 < 0 THEN length(ls[i + 1]) ELSE strpos(ls[i + 1], ' ') - 1 END >= width
      AND NOT coalesce(starts_with(ls[i + 1], '>>>'), false)}) AS flags
    FROM (SELECT doc_id, ls, list_max(list_transform(ls, lambda x: length(x))) - 1 AS width
          FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)) AS ls FROM documents))
  )
)
""")
def reflow(spark, sf):
    return bl.reflow(table(spark, sf, "documents").select("doc_id", "text"))


@register("first_tokens", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, """ns AS (
  SELECT doc_id, line, arg_min(t, pos) AS first_token FROM ctokens WHERE kind IN ('NAME', 'STRING') GROUP BY doc_id, line
)""", """nm AS (
  SELECT doc_id, line, arg_min(t, pos) AS first_name FROM ctokens WHERE kind = 'NAME' GROUP BY doc_id, line
)""") + """
SELECT l.doc_id, l.line, a.first_token, b.first_token AS last_line_first_token, """ + ", ".join(
    f"n{k}.first_name AS first_name_{k}" for k in bl.FIRST_NAME_LOOKBACK) + """
FROM (SELECT DISTINCT doc_id, line FROM ctokens) l
LEFT JOIN ns a ON a.doc_id = l.doc_id AND a.line = l.line
LEFT JOIN ns b ON b.doc_id = l.doc_id AND b.line = l.line - 1
""" + "\n".join(f"LEFT JOIN nm n{k} ON n{k}.doc_id = l.doc_id AND n{k}.line = l.line - {k}" for k in bl.FIRST_NAME_LOOKBACK))
def first_tokens(spark, sf):
    return bl.first_tokens(code_tokens(spark, sf))


@register("lint_order", """
SELECT doc_id, line, col, seq, CASE WHEN i > 0 THEN substr(msg, 1, i) ELSE msg END AS title,
       CASE WHEN i > 0 THEN substr(msg, i + 2) ELSE '' END AS detail
FROM (SELECT user_id AS doc_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS line,
             TRY_CAST(floor(value) AS INTEGER) AS col, event_id AS seq, event_type || chr(10) || props AS msg,
             strpos(event_type || chr(10) || props, chr(10)) - 1 AS i FROM events)
""")
def lint_order(spark, sf):
    return bl.lint_order(bl.lint_rows(table(spark, sf, "events")))


@register("contains_nth_line", q.with_(*ranking.BASE[:5], code_plans.INDENTS, fplans.STARTS, fplans.CTX_ROWS) + """
SELECT p.doc_id, p.line, p.pos, CAST(CASE WHEN p.line = 0 THEN 99999 WHEN strpos(p.head, p.t) > 0 THEN 0
  ELSE coalesce((SELECT min(p.line - l.line) FROM code_lines l WHERE l.doc_id = p.doc_id AND l.line BETWEEN p.line - 19 AND p.line - 1
                 AND l.line >= 1 AND strpos(l.text, p.t) > 0), 99999) END AS INTEGER) AS contains_in_nth_line
FROM pctx p
""")
def contains_nth_line(spark, sf):
    lines = code_lines(spark, sf)
    t = code_tokens(spark, sf)
    rows = ft.positions_with_context(lines, cd.positions(t).select(*ft.GROUP, "t"))
    rows = ft.nth_lines(rows.select(*ft.GROUP, "t", "head"), ft.line_blocks(lines), {"contains_in_nth_line": lambda x: x}, "t")
    return rows.select(*ft.GROUP, "contains_in_nth_line")
