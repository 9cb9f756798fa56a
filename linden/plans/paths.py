"""Queries: URL paths, file types, ignore rules, links, file search, sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linden.operators import corpus, paths
from linden.operators import search as srch
from linden.plans import sql as q
from linden.plans.registry import register
from linden.session import scratch_path
from linden.sources.tables import spread, table

# --- fixed values: query parameters -------------------------------------------------
IGNORE_RULES = ["# generated pages", "*.html", "/es/", "!/es/5*", "**/9*", "fr/*[0-4]"]
COVER_KEYWORDS = ["red", "bo", "ing"]
FILE_QUERY = "red bo"
SPLIT_SEED = 26
SPLIT_SIZES = (100, 10, 10)

URL_PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def _pages(spark, sf):
    return table(spark, sf, "pages")


def _path_sql(col: str = "url") -> str:
    return f"regexp_extract({col}, {q.lit(URL_PATH_RE)}, 1)"


@register("relative_paths", f"""
SELECT page_id, array_to_string(parts, '/') AS rel, CAST(len(parts) AS INTEGER) AS depth, parts[1] AS first_part, parts[-1] AS last_part
FROM (SELECT page_id, CASE WHEN starts_with(p, '/') THEN list_filter(string_split(substr(p, 2), '/'), lambda x: x <> '') END AS parts
      FROM (SELECT page_id, {_path_sql()} AS p FROM pages))
""")
def relative_paths(spark, sf):
    p = _pages(spark, sf).select("page_id", paths.url_path(F.col("url")).alias("p"))
    d = p.select("page_id", paths.relative_parts(F.col("p")).alias("parts"))
    return d.select("page_id", F.array_join("parts", "/").alias("rel"), F.size("parts").alias("depth"),
                    F.get("parts", 0).alias("first_part"), F.get("parts", F.size("parts") - 1).alias("last_part"))


_KNOWN = ", ".join(q.lit(x) for x in paths.KNOWN_FILE_TYPES)


@register("file_type", f"""
SELECT page_id, name, CASE WHEN ext IN ({_KNOWN}) THEN ext WHEN ends_with(ext, 'rc') THEN 'rc'
  WHEN ends_with(ext, 'ignore') THEN 'ignore' ELSE 'default' END AS file_type
FROM (SELECT page_id, name, lower(regexp_extract(name, '[^.]*$')) AS ext
      FROM (SELECT page_id, string_split({_path_sql()}, '/')[-1] AS name FROM pages))
""")
def file_type(spark, sf):
    p = _pages(spark, sf).select("page_id", paths.file_name(paths.url_path(F.col("url"))).alias("name"))
    return p.select("page_id", "name", paths.file_type(F.col("name")).alias("file_type"))


def _ignore_sql(col: str) -> str:
    expr = "false"
    for rx, neg in [r for r in (paths.glob_to_regex(x) for x in IGNORE_RULES) if r is not None]:
        expr = f"CASE WHEN regexp_matches({col}, {q.lit(rx)}) THEN {str(not neg).lower()} ELSE {expr} END"
    return expr


@register("ignore_filter", f"""
SELECT page_id, rel FROM (SELECT page_id, ltrim({_path_sql()}, '/') AS rel FROM pages)
WHERE NOT ({_ignore_sql('rel')})
""")
def ignore_filter(spark, sf):
    p = _pages(spark, sf).select("page_id", F.ltrim(paths.url_path(F.col("url")), F.lit("/")).alias("rel"))
    return p.where(~paths.ignored(F.col("rel"), IGNORE_RULES))


# rule files of nested folders: the inner one replaces the outer one
NESTED_RULES = {"": ["*.html", "fr/"], "en": ["# nothing of the outer file holds here", "**/9*", "!/9*1"], "es": ["*", "!*[0-4]"]}


def _rules_sql(rules: list[str], col: str) -> str:
    expr = "false"
    for rx, neg in [r for r in (paths.glob_to_regex(x) for x in rules) if r is not None]:
        expr = f"CASE WHEN regexp_matches({col}, {q.lit(rx)}) THEN {str(not neg).lower()} ELSE {expr} END"
    return expr


@register("ignore_nested", f"""
SELECT page_id, rel, d AS rule_dir, CASE d WHEN 'en' THEN {_rules_sql(NESTED_RULES['en'], 'substr(rel, 4)')}
  WHEN 'es' THEN {_rules_sql(NESTED_RULES['es'], 'substr(rel, 4)')} ELSE {_rules_sql(NESTED_RULES[''], 'rel')} END AS ignored
FROM (SELECT *, CASE WHEN starts_with(rel, 'en/') THEN 'en' WHEN starts_with(rel, 'es/') THEN 'es' ELSE '' END AS d
      FROM (SELECT page_id, ltrim({_path_sql()}, '/') AS rel FROM pages))
""")
def ignore_nested(spark, sf):
    files = spark.createDataFrame([(d, n, r) for d, rules in NESTED_RULES.items() for n, r in enumerate(rules)], "dir string, n int, rule string")
    p = _pages(spark, sf).select("page_id", F.ltrim(paths.url_path(F.col("url")), F.lit("/")).alias("rel"))
    return paths.nearest_ignored(p, files)


@register("link_harvest", f"""
SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE starts_with(href, '/')) AS n_internal,
       count(*) FILTER (WHERE NOT starts_with(href, '/')) AS n_external
FROM (SELECT page_id, unnest(regexp_extract_all(html, {q.lit(paths.ANCHOR_PATTERN)}, 1)) AS href FROM pages)
GROUP BY page_id
""")
def link_harvest(spark, sf):
    a = paths.anchor_links(_pages(spark, sf))
    return a.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(F.col("href").startswith("/")).alias("n_internal"),
        F.count_if(~F.col("href").startswith("/")).alias("n_external"),
    )


def _cover_sql(col: str, keywords: list[str]) -> tuple[str, str]:
    kws = "[" + ", ".join(q.lit(k.lower()) for k in keywords if k) + "]"
    low = f"lower({col})"
    starts = (f"(CASE WHEN len(string_split({low}, k)) < 2 THEN []::INTEGER[] ELSE "
              f"list_transform(range(0, len(string_split({low}, k)) - 1), lambda j: "
              f"CAST(list_sum(list_transform(string_split({low}, k)[1:j + 1], lambda p: length(p))) + j * length(k) AS INTEGER)) END)")
    mask = (f"(CASE WHEN length({col}) = 0 THEN []::BOOLEAN[] ELSE list_transform(range(0, length({col})), lambda i: "
            f"list_bool_or(list_transform({kws}, lambda k: coalesce(list_bool_or(list_transform({starts}, lambda s: s <= i AND i < s + length(k))), false)))) END)")
    return mask, kws


_MASK, _ = _cover_sql("p_name", COVER_KEYWORDS)
_DISPLAY = ("(CASE WHEN length(p_name) = 0 THEN '' ELSE array_to_string(list_transform(range(0, length(p_name)), lambda i: "
            "(CASE WHEN m[i + 1] AND NOT coalesce(CASE WHEN i > 0 THEN m[i] END, false) THEN '<em>' "
            "WHEN NOT m[i + 1] AND coalesce(CASE WHEN i > 0 THEN m[i] END, false) THEN '</em>' ELSE '' END) || substr(p_name, i + 1, 1)), '') END"
            " || CASE WHEN coalesce(m[length(p_name)], false) THEN '</em>' ELSE '' END)")


@register("keyword_cover", f"""
SELECT p_partkey, p_name, {_DISPLAY} AS display,
  CAST(len(list_filter(m, lambda x: x)) + CASE WHEN ends_with(p_name, '.py') THEN 1 ELSE 0 END AS INTEGER) AS score
FROM (SELECT p_partkey, p_name, {_MASK} AS m FROM part)
""")
def keyword_cover(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    return paths.keyword_cover(p, "p_name", COVER_KEYWORDS)


_FMASK, _ = _cover_sql("p_name", FILE_QUERY.split(" "))


@register("file_top9", """
SELECT p_partkey, p_name, score FROM (
  SELECT p_partkey, p_name, CAST(len(list_filter(m, lambda x: x)) + CASE WHEN ends_with(p_name, '.py') THEN 1 ELSE 0 END AS INTEGER) AS score
  FROM (SELECT p_partkey, p_name, """ + _FMASK + """ AS m FROM part
        WHERE """ + " AND ".join(f"contains(lower(p_name), '{k}')" for k in FILE_QUERY.lower().split()) + """
          AND NOT contains(p_name, '__pycache__'))
) ORDER BY score DESC, p_name, p_partkey LIMIT 9
""")
def file_top9(spark, sf):
    p = srch.keyword_filter(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", FILE_QUERY)
    s = paths.keyword_cover(p, "p_name", FILE_QUERY.split(" "))
    return s.orderBy(F.col("score").desc(), "p_name", "p_partkey").limit(9).select("p_partkey", "p_name", "score")


@register("seeded_split", f"""
SELECT doc_id, CASE WHEN rank < {SPLIT_SIZES[0]} THEN 'statistic' WHEN rank < {SPLIT_SIZES[0] + SPLIT_SIZES[1]} THEN 'training'
  ELSE 'testing' END AS split, rank FROM (
  SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS INTEGER) AS rank
  FROM documents
) WHERE rank < {sum(SPLIT_SIZES)}
""")
def seeded_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return corpus.seeded_split(d, "doc_id", *SPLIT_SIZES, seed=SPLIT_SEED)


@register("split_features", f"""
WITH lists AS (
  SELECT doc_id, CASE WHEN rank < {SPLIT_SIZES[0]} THEN 'statistic' WHEN rank < {SPLIT_SIZES[0] + SPLIT_SIZES[1]} THEN 'training' ELSE 'testing' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('{SPLIT_SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents)
  WHERE rank < {sum(SPLIT_SIZES)}
), feats AS (
  SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM documents
  WHERE n_chars > {corpus.MIN_SIZE_EXCLUSIVE} AND n_chars < {corpus.MAX_SIZE_EXCLUSIVE}
)
SELECT l.split, l.doc_id, f.n_lines, f.doc_id IS NULL AS missing FROM lists l LEFT JOIN feats f ON f.doc_id = l.doc_id
WHERE l.split = 'testing' OR f.doc_id IS NOT NULL
""")
def split_features(spark, sf):
    """Features of the corpus scan, loaded by the written lists of the splits."""
    docs = table(spark, sf, "documents")
    path = scratch_path(spark, f"split-lists-{uuid.uuid4().hex[:12]}")
    corpus.write_lists(corpus.seeded_split(docs.select("doc_id"), "doc_id", *SPLIT_SIZES, seed=SPLIT_SEED), "doc_id", path)
    sized = docs.where((F.col("n_chars") > corpus.MIN_SIZE_EXCLUSIVE) & (F.col("n_chars") < corpus.MAX_SIZE_EXCLUSIVE))
    feats = sized.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    parts = [corpus.load_split(feats, path, "doc_id", s).select(F.lit(s).alias("split"), "doc_id", "n_lines", "missing") for s in ("statistic", "training", "testing")]
    return parts[0].union(parts[1]).union(parts[2])
