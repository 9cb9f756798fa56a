"""Queries: identifier decomposition, string words, scopes, spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.operators import dictionary as dct
from linden.operators import spelling as sp
from linden.plans import sql as q
from linden.plans.common import code_tokens, doc_tokens, documents
from linden.plans.registry import register
from linden.sources import views
from linden.sources.tables import table


def decompose_sql(t: str) -> str:
    parts = f"list_filter(regexp_split_to_array({t}, '[_\\d]+'), lambda p: p <> '')"
    joined = f"array_to_string({parts}, '')"
    upper = f"(upper({joined}) = {joined} AND lower({joined}) <> {joined})"
    humps = f"flatten(list_transform({parts}, lambda p: regexp_extract_all(p, '[A-Z][a-z]*|[^A-Z]+')))"
    chosen = f"(CASE WHEN {upper} THEN {parts} ELSE {humps} END)"
    return f"list_transform(list_filter({chosen}, lambda p: length(p) >= 3), lambda p: lower(p))"


FLAGS = """nb AS (
  SELECT doc_id, line, pos, kind, t, coalesce(lag(t) OVER wl, '') AS t1, lag(kind) OVER wl AS kind1
  FROM ctokens WINDOW wl AS (PARTITION BY doc_id, line ORDER BY pos)
),
fl AS (
  SELECT doc_id, line, pos, kind, t, t1, kind1,
    coalesce(last_value(CASE WHEN t1 = 'for' THEN true WHEN t = 'in' THEN false END IGNORE NULLS) OVER wd, false) AS for_,
    coalesce(last_value(CASE WHEN t1 = 'def' THEN true WHEN t = ':' AND t1 = ')' THEN false END IGNORE NULLS) OVER wd, false) AS def_,
    coalesce(last_value(CASE WHEN t1 = 'import' THEN true WHEN t IN ('as', 'from') THEN false END IGNORE NULLS) OVER wl2, false) AS import_
  FROM nb
  WINDOW wd AS (PARTITION BY doc_id ORDER BY line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wl2 AS (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

EVENTS = """ev AS (
  SELECT doc_id, line, pos, action,
    CASE WHEN action = 'prev' THEN t1 ELSE t END AS ct, CASE WHEN action = 'prev' THEN kind1 ELSE kind END AS ckind
  FROM (SELECT *, CASE WHEN t1 IN ('class', 'as') THEN 'self' WHEN def_ THEN 'self' WHEN t = '=' THEN 'prev'
          WHEN for_ THEN 'self' WHEN kind IN ('STRING', 'COMMENT') THEN 'self' WHEN import_ THEN 'import' END AS action
        FROM fl)
  WHERE action IS NOT NULL
)"""

SPELL = f"""imported AS (
  SELECT doc_id, w, min({{'l': line, 'p': pos, 's': 0}}) AS imp_o FROM (
    SELECT doc_id, line, pos, unnest(list_distinct(list_concat([lower(ct)], {decompose_sql('ct')}))) AS w
    FROM ev WHERE action = 'import' AND lower(ct) NOT IN (SELECT w FROM dict)
  ) GROUP BY doc_id, w
),
names AS (
  SELECT doc_id, line, pos, ct AS s, 0 AS sub FROM ev WHERE action <> 'import' AND ckind = 'NAME'
),
texts0 AS (
  SELECT doc_id, line, pos, CAST(generate_subscripts(ws, 1) AS INTEGER) AS sub, unnest(ws) AS s FROM (
    SELECT doc_id, line, pos, regexp_extract_all(ct, '\\p{{L}}+') AS ws FROM ev
    WHERE action <> 'import' AND ckind IN ('STRING', 'COMMENT'))
),
texts AS (
  SELECT t.doc_id, t.line, t.pos, t.s, t.sub FROM texts0 t
  LEFT JOIN imported i ON i.doc_id = t.doc_id AND i.w = t.s
  WHERE length(t.s) >= 4 AND lower(t.s) = t.s AND upper(t.s) <> t.s
    AND t.s NOT IN (SELECT w FROM dict)
    AND (i.imp_o IS NULL OR i.imp_o > {{'l': t.line, 'p': t.pos, 's': t.sub}})
),
checks0 AS (
  SELECT doc_id, line, pos, sub, s, {{'l': line, 'p': pos, 's': sub}} AS o, {decompose_sql('s')} AS ws
  FROM (SELECT * FROM names UNION ALL SELECT * FROM texts) WHERE length(s) > 3
),
items AS (
  SELECT doc_id, item, min(o) AS first_o FROM (
    SELECT doc_id, o, unnest(list_distinct(list_concat([s], ws))) AS item FROM checks0
  ) GROUP BY doc_id, item
),
checks AS (
  SELECT c.* FROM checks0 c JOIN items i ON i.doc_id = c.doc_id AND i.item = c.s WHERE i.first_o = c.o
),
words AS (
  SELECT doc_id, line, pos, sub, s, o, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS wi, unnest(ws) AS w FROM checks
),
judged AS (
  SELECT w.doc_id, w.line, w.pos, w.sub, w.s, w.wi, w.w,
    (w.w IN (SELECT w FROM dict)
     OR EXISTS (SELECT 1 FROM dict d WHERE length(d.w) >= 4 AND starts_with(d.w, w.w))
     OR coalesce(im.imp_o < w.o, false) OR coalesce(it.first_o < w.o, false)) AS ok
  FROM words w
  LEFT JOIN imported im ON im.doc_id = w.doc_id AND im.w = w.w
  LEFT JOIN items it ON it.doc_id = w.doc_id AND it.item = w.w
),
per_token AS (
  SELECT doc_id, line, pos, sub, s, list({{'wi': wi, 'w': w, 'ok': ok}} ORDER BY wi) AS wl FROM judged
  GROUP BY doc_id, line, pos, sub, s
)"""

HIGHLIGHT = """list_reduce(wl, lambda acc, x:
  CASE WHEN x.ok THEN {'r': acc.r, 'i': CASE WHEN strpos(substr(lower(acc.r), acc.i + 1), x.w) > 0
                                         THEN acc.i + strpos(substr(lower(acc.r), acc.i + 1), x.w) - 1 ELSE -1 END}
  ELSE {'r': concat(substr(acc.r, 1, CASE WHEN strpos(substr(lower(acc.r), acc.i + 1), x.w) > 0
                                         THEN acc.i + strpos(substr(lower(acc.r), acc.i + 1), x.w) - 1 ELSE -1 END),
                    '<em>',
                    substr(acc.r, CASE WHEN strpos(substr(lower(acc.r), acc.i + 1), x.w) > 0
                                         THEN acc.i + strpos(substr(lower(acc.r), acc.i + 1), x.w) - 1 ELSE -1 END + 1, length(x.w)),
                    '</em>',
                    substr(acc.r, CASE WHEN strpos(substr(lower(acc.r), acc.i + 1), x.w) > 0
                                         THEN acc.i + strpos(substr(lower(acc.r), acc.i + 1), x.w) - 1 ELSE -1 END + 1 + length(x.w))),
        'i': CASE WHEN strpos(substr(lower(acc.r), acc.i + 1), x.w) > 0
                  THEN acc.i + strpos(substr(lower(acc.r), acc.i + 1), x.w) - 1 ELSE -1 END + 9}
  END, {'r': s, 'i': 0}).r"""


def _dict(spark, sf):
    return dct.vocabulary(table(spark, sf, "benchmark").select("text"))


@register("decompose_identifiers", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS) + f"""
SELECT doc_id, line, pos, t, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS wi, unnest(ws) AS w FROM (
  SELECT doc_id, line, pos, t, {decompose_sql('t')} AS ws FROM ctokens WHERE kind = 'NAME'
)
""")
def decompose_identifiers(spark, sf):
    t = code_tokens(spark, sf).where(F.col("kind") == lx.KIND_NAME)
    return t.select("doc_id", "line", "pos", "t", F.posexplode(sp.decompose(F.col("t"))).alias("wi", "w"))


@register("string_words", q.with_(q.LINES, q.TOKENS) + """
SELECT doc_id, line, pos, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS wi, unnest(ws) AS w FROM (
  SELECT doc_id, line, pos, regexp_extract_all(t, '\\p{L}+') AS ws FROM tokens WHERE kind IN ('STRING', 'COMMENT')
)
""")
def string_words(spark, sf):
    t = doc_tokens(spark, sf).where(F.col("kind").isin(lx.KIND_STRING, lx.KIND_COMMENT))
    return t.select("doc_id", "line", "pos", F.posexplode(sp.string_words(F.col("t"))).alias("wi", "w"))


@register("scope_flags", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, FLAGS) + """
SELECT doc_id, line, pos, kind, t, t1, kind1, for_, def_, import_ FROM fl
""")
def scope_flags(spark, sf):
    whole, rest = views.whole_documents(documents(spark, sf))
    found = sp.document_scope_flags(views.code_line_arrays(whole))
    return found if rest is None else found.unionByName(sp.scope_flags(_tokens(rest)))


def _tokens(docs):
    return views.tokens(views.code_lines(views.lines(docs)))


@register("imported_names", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, FLAGS, EVENTS, q.DICT, SPELL) + """
SELECT doc_id, w, imp_o.l AS line, imp_o.p AS pos FROM imported
""")
def imported_names(spark, sf):
    ev = sp.check_events(sp.scope_flags(code_tokens(spark, sf)))
    d = _dict(spark, sf).select("w").distinct()
    imp = ev.where(F.col("action") == "import").select("doc_id", "line", "pos", F.col("ct").alias("t"))
    imp = imp.join(d.withColumnRenamed("w", "lt"), F.lower(imp["t"]) == F.col("lt"), "left_anti")
    items = imp.select("doc_id", "line", "pos", F.explode(F.array_union(F.array(F.lower("t")), sp.decompose(F.col("t")))).alias("w"))
    first = items.groupBy("doc_id", "w").agg(F.min(F.struct("line", "pos")).alias("o"))
    return first.select("doc_id", "w", F.col("o.line").alias("line"), F.col("o.pos").alias("pos"))


@register("spelling", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, FLAGS, EVENTS, q.DICT, SPELL) + f"""
SELECT doc_id, line, pos, sub, s AS token, {HIGHLIGHT} AS highlighted
FROM per_token WHERE list_bool_or(list_transform(wl, lambda x: NOT x.ok))
""")
def spelling(spark, sf):
    whole, rest = views.whole_documents(documents(spark, sf))
    found = sp.document_spelling(views.code_line_arrays(whole), _dict(spark, sf))
    return found if rest is None else found.unionByName(sp.spelling(_tokens(rest), _dict(spark, sf)))


# the last word of each line goes to its document's project dictionary behind that line
PROJECT = """project AS (
  SELECT doc_id, ws[-1] AS w, min(line) * 2 + 1 AS line FROM code_words WHERE len(ws) > 0 GROUP BY doc_id, ws[-1]
)"""
SPELL_PROJECT = SPELL.replace("""
  WHERE length(t.s) >= 4""", """
  LEFT JOIN project pr ON pr.doc_id = t.doc_id AND pr.w = t.s
  WHERE (pr.line IS NULL OR pr.line > t.line) AND length(t.s) >= 4""").replace("OR coalesce(it.first_o < w.o, false)", """
     OR coalesce(it.first_o < w.o, false) OR coalesce(pr.line <= w.line, false)""").replace("""
  LEFT JOIN items it""", """
  LEFT JOIN project pr ON pr.doc_id = w.doc_id AND pr.w = w.w
  LEFT JOIN items it""")


@register("spelling_project", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, FLAGS, EVENTS, q.DICT, PROJECT, SPELL_PROJECT) + f"""
SELECT doc_id, line, pos, sub, s AS token, {HIGHLIGHT} AS highlighted
FROM per_token WHERE list_bool_or(list_transform(wl, lambda x: NOT x.ok))
""")
def spelling_project(spark, sf):
    whole, rest = views.whole_documents(documents(spark, sf))
    last_words = F.transform(F.split("text", "\n", -1), lambda s, i: F.struct(F.get(F.reverse(_words(s)), 0).alias("w"), (i * 2 + 1).alias("line")))
    whole = whole.select("doc_id", "text", F.filter(last_words, lambda x: x["w"].isNotNull()).alias("project"))
    found = sp.document_spelling(views.code_line_arrays(whole, "project"), _dict(spark, sf))
    if rest is None:
        return found
    added = views.lines(rest).select("doc_id", (F.col("line") * 2 + 1).alias("line"), _words(F.col("text")).alias("ws")).where(F.size("ws") > 0) \
        .select("doc_id", F.element_at("ws", -1).alias("w"), "line")
    return found.unionByName(sp.spelling(_tokens(rest), _dict(spark, sf), project=added))


def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(lx.WORD_PATTERN), 0)


@register("first_unknown", q.with_(q.LINES, q.TOKENS, q.DICT) + """
SELECT doc_id, w, line, pos FROM (
  SELECT doc_id, lower(t) AS w, line, pos, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY line, pos) AS r
  FROM tokens WHERE kind = 'NAME' AND length(t) >= 4 AND lower(t) NOT IN (SELECT w FROM dict)
) WHERE r = 1
""")
def first_unknown(spark, sf):
    t = doc_tokens(spark, sf).where((F.col("kind") == lx.KIND_NAME) & (F.length("t") >= 4))
    t = t.select("doc_id", F.lower("t").alias("w"), "line", "pos")
    t = dct.unknown_words(t, _dict(spark, sf))
    # First occurrence = minimum position: an aggregation, not a window.
    return t.groupBy("doc_id", "w").agg(F.min(F.struct("line", "pos")).alias("o")).select(
        "doc_id", "w", F.col("o.line").alias("line"), F.col("o.pos").alias("pos"))
