"""Queries: regex search, replace, roll-ups, name filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.operators import search as srch
from linden.plans import sql as q
from linden.plans.common import doc_lines
from linden.plans.registry import register
from linden.sources.tables import table

# --- fixed values: query parameters -------------------------------------------------
SEARCH_REGEX = r"\p{Lu}\p{Ll}+ion"
WORD_QUERY = "the"
REPLACE_FIND = "the"
REPLACE_WITH = "THE"
NAME_KEYWORDS = "red bo"

_MATCH_SQL = """pieces AS (
  SELECT doc_id, line, text, regexp_extract_all(text, {re}) AS m, regexp_split_to_array(text, {re}) AS gap
  FROM lines WHERE regexp_matches(text, {re})
),
mrows AS (
  SELECT doc_id, line, text, i, m[i] AS match, length(gap[i]) AS g
  FROM (SELECT doc_id, line, text, m, gap, unnest(range(1, len(m) + 1)) AS i FROM pieces)
),
matches AS (
  SELECT doc_id, line, text, match,
    CAST(sum(g + length(match)) OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(match) AS INTEGER) AS start
  FROM mrows
)"""


def _matches_sql(pattern: str) -> str:
    return _MATCH_SQL.replace("{re}", q.lit(pattern))


@register("regex_search", q.with_(q.LINES, _matches_sql(SEARCH_REGEX)) + """
SELECT doc_id, line, start, CAST(start + length(match) AS INTEGER) AS "end", match,
  concat(substr(text, 1, start), '<em>', substr(text, start + 1, length(match)), '</em>', substr(text, start + length(match) + 1)) AS snippet
FROM matches
""")
def regex_search(spark, sf):
    lines = doc_lines(spark, sf)
    m = srch.find_matches(lines, SEARCH_REGEX)
    m = m.join(lines, ["doc_id", "line"])
    return m.select("doc_id", "line", "start", "end", "match",
                    srch.highlight(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


_WORD = srch.build_pattern(WORD_QUERY, regex=False, whole_word=True, case_sensitive=False)
_WORD_RE2 = srch.build_pattern(WORD_QUERY, regex=False, whole_word=True, case_sensitive=False, dialect="re2")


@register("whole_word_search", q.with_(q.LINES, _matches_sql(_WORD_RE2)) + """
SELECT doc_id, line, start, CAST(start + length(match) AS INTEGER) AS "end", match FROM matches
""")
def whole_word_search(spark, sf):
    return srch.find_matches(doc_lines(spark, sf), _WORD)


@register("search_rollup", q.with_(q.LINES, _matches_sql(_WORD_RE2), f"""per_file AS (
  SELECT doc_id, count(*) AS k FROM matches GROUP BY doc_id
)""", """visited AS (
  SELECT doc_id, k, coalesce(sum(k) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM per_file
)""") + f"""
SELECT count(*) AS n_files, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_matches,
       coalesce(sum(k), 0) > {srch.search_limit(WORD_QUERY)} AS overflow
FROM visited WHERE before <= {srch.search_limit(WORD_QUERY)}
""")
def search_rollup(spark, sf):
    m = srch.find_matches(doc_lines(spark, sf), _WORD)
    return srch.search_rollup(m, srch.search_limit(WORD_QUERY))


_REPL = srch.build_pattern(REPLACE_FIND, whole_word=True)
_REPL_RE2 = srch.build_pattern(REPLACE_FIND, whole_word=True, dialect="re2")


@register("replace_all", q.with_(q.LINES) + f"""
SELECT doc_id, line, regexp_replace(text, {q.lit(_REPL_RE2)}, '{REPLACE_WITH}', 'g') AS text,
       CAST(len(regexp_extract_all(text, {q.lit(_REPL_RE2)})) AS INTEGER) AS n
FROM lines WHERE regexp_matches(text, {q.lit(_REPL_RE2)})
""")
def replace_all(spark, sf):
    return srch.replace_all(doc_lines(spark, sf), _REPL, REPLACE_WITH)


@register("find_by_keywords", """
SELECT p_partkey, p_name FROM part
WHERE """ + " AND ".join(f"contains(lower(p_name), '{k}')" for k in NAME_KEYWORDS.lower().split()) + """
  AND NOT contains(p_name, '__pycache__')
""")
def find_by_keywords(spark, sf):
    return srch.keyword_filter(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", NAME_KEYWORDS)
