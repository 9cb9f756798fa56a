"""Queries: keyed records (events), manifests and small-table lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions import text as tx
from linden.operators import manifest as mf
from linden.operators import records as rec
from linden.plans import sql as q
from linden.plans.common import edit_log
from linden.plans.registry import register
from linden.sources import views
from linden.sources.tables import table

# --- fixed values: query parameters -------------------------------------------------
STATE_TYPE = "view"                       # messages that carry an execution state
ENABLED_LINT_TYPES = ("error", "warning", "convention")
RECENT_N = 10
DEFAULT_CONFIG = {"k": "0", "theme": "light"}


def _events(spark, sf):
    return table(spark, sf, "events")


@register("json_source", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
""")
def json_source(spark, sf):
    e = _events(spark, sf)
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@register("kv_latest", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value,
       arg_max(props, (ts, event_id)) AS props, max((ts, event_id))[2] AS event_id
FROM events GROUP BY user_id
""")
def kv_latest(spark, sf):
    e = _events(spark, sf)
    return rec.latest_per_key(e, ["user_id"], "ts", "event_id", ["event_type", "value", "props", "event_id"])


@register("kv_default", """
SELECT c.c_custkey AS user_id, coalesce(l.props, '{}') AS props FROM customer c
LEFT JOIN (SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id) l ON l.user_id = c.c_custkey
""")
def kv_default(spark, sf):
    """Every customer's latest settings, empty ones for who has none."""
    latest = rec.latest_per_key(_events(spark, sf), ["user_id"], "ts", "event_id", ["props"])
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return rec.with_default(keys, latest, ["user_id"], {"props": "{}"})


@register("edit_latest", q.with_(q.EDIT_LOG) + """
SELECT doc_id, line, arg_max(text, (ts, seq)) AS text FROM edit_log GROUP BY doc_id, line
""")
def edit_latest(spark, sf):
    return rec.latest_per_key(edit_log(spark, sf), ["doc_id", "line"], "ts", "seq", ["text"])


@register("merge_maps", """
SELECT user_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value
FROM (SELECT user_id, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id)
UNION ALL
SELECT user_id, 'theme' AS key, 'light' AS value FROM (SELECT DISTINCT user_id FROM events)
""")
def merge_maps(spark, sf):
    e = _events(spark, sf)
    latest = rec.latest_per_key(e, ["user_id"], "ts", "event_id", ["props"])
    user_map = F.from_json("props", "map<string,string>")
    default = F.create_map(*[x for k, v in DEFAULT_CONFIG.items() for x in (F.lit(k), F.lit(v))])
    merged = latest.select("user_id", rec.merge_maps(default, user_map).alias("m"))
    return merged.select("user_id", F.explode("m").alias("key", "value"))


@register("merge_configs", """
WITH latest AS (
  SELECT user_id, event_type, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS e, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k
  FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id, event_type
), merged AS (
  SELECT user_id, json_merge_patch(
    coalesce(max(CASE WHEN event_type = 'view' THEN '{"ui":{"k":' || k || ',"from":"view"},"n":' || k || ',"seen":{"view":' || e || '}}' END), '{}'),
    coalesce(max(CASE WHEN event_type <> 'view' THEN CASE CAST(k AS INTEGER) % 3 WHEN 0 THEN '{"ui":{"k":' || k || ',"from":"click","extra":[' || k || ']},"n":{"deep":' || k || '}}'
      WHEN 1 THEN '{"ui":' || k || ',"seen":{"click":' || e || '}}' ELSE '{"new":{},"seen":{"view":{"again":' || k || '}}}' END END), '{}')) AS m
  FROM latest GROUP BY user_id
), sections AS (SELECT user_id, s AS section, json_extract(m, '$.' || s) AS v FROM (SELECT user_id, m, unnest(json_keys(m)) AS s FROM merged))
SELECT user_id, section, n AS name, CAST(json_extract(v, '$.' || n) AS VARCHAR) AS value
FROM (SELECT *, unnest(json_keys(v)) AS n FROM sections WHERE json_type(v) = 'OBJECT')
UNION ALL SELECT user_id, section, NULL, CASE WHEN json_type(v) <> 'OBJECT' THEN CAST(v AS VARCHAR) END FROM sections
WHERE json_type(v) <> 'OBJECT' OR len(json_keys(v)) = 0
""")
def merge_configs(spark, sf):
    e = _events(spark, sf).where(F.col("event_type").isin("view", "click"))
    latest = rec.latest_per_key(e, ["user_id", "event_type"], "ts", "event_id", ["props", "event_id"])
    latest = latest.withColumns({"k": F.get_json_object("props", "$.k"), "e": F.col("event_id").cast("string")})
    text = lambda t: F.concat(*[F.col(x) if x in ("k", "e") else F.lit(x) for x in t.split("|")])
    kind = F.col("k").cast("int") % 3
    view = text('{"ui":{"k":|k|,"from":"view"},"n":|k|,"seen":{"view":|e|}}')
    click = F.when(kind == 0, text('{"ui":{"k":|k|,"from":"click","extra":[|k|]},"n":{"deep":|k|}}')) \
        .when(kind == 1, text('{"ui":|k|,"seen":{"click":|e|}}')).otherwise(text('{"new":{},"seen":{"view":{"again":|k|}}}'))
    both = latest.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", view)).alias("a"), F.max(F.when(F.col("event_type") == "click", click)).alias("b"))
    rows = both.select("user_id", F.explode(rec.setting_rows(rec.merge_configs(F.col("a"), F.col("b")))).alias("s"))
    return rows.select("user_id", "s.section", "s.name", "s.value")


@register("compact_states", f"""
SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> '{STATE_TYPE}'
UNION ALL
SELECT arg_max(event_id, (ts, event_id)), user_id, arg_max(event_type, (ts, event_id)), arg_max(value, (ts, event_id))
FROM events WHERE event_type = '{STATE_TYPE}' GROUP BY user_id
""")
def compact_states(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", "event_type", "value", "ts")
    out = rec.compact_states(e, "user_id", F.col("event_type") == STATE_TYPE, "ts", "event_id")
    return out.drop("ts")


@register("coalesce_latest", """
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS batch_start,
       arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts)
""")
def coalesce_latest(spark, sf):
    e = _events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    return rec.coalesce_latest(e, "user_id", "ts", "event_id").select(
        "user_id", "batch_start", "event_id", "event_type")


@register("recent_n", f"""
SELECT user_id, event_id, event_type, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events
  ) WHERE prev IS NULL OR prev <> event_type
) WHERE rank <= {RECENT_N}
""")
def recent_n(spark, sf):
    e = _events(spark, sf).select("user_id", "event_id", "event_type", "ts")
    return rec.recent_n(e, "user_id", "event_type", "ts", "event_id", RECENT_N).select(
        "user_id", "event_id", "event_type", "rank")


_TYPES_VALUES = ", ".join(f"('{t}', {i})" for i, t in enumerate(lx.LINT_TYPES))


@register("lint_counts", f"""
SELECT t.type, coalesce(c.n, 0) AS n, t.ord FROM (VALUES {_TYPES_VALUES}) AS t(type, ord)
LEFT JOIN (SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type) c ON c.type = t.type
""")
def lint_counts(spark, sf):
    return rec.type_counts(_events(spark, sf), "event_type")


@register("lint_filter", f"""
SELECT event_id, user_id, event_type FROM events
WHERE event_type IN ({", ".join(q.lit(t) for t in ENABLED_LINT_TYPES)})
""")
def lint_filter(spark, sf):
    return _events(spark, sf).where(F.col("event_type").isin(*ENABLED_LINT_TYPES)).select(
        "event_id", "user_id", "event_type")


@register("manifest_diff", q.with_(q.MANIFESTS) + """
SELECT coalesce(o.path, n.path) AS path,
  CASE WHEN o.hash IS NULL THEN 'untracked' WHEN n.hash IS NULL THEN 'deleted' ELSE 'changed' END AS status
FROM manifest_old o FULL OUTER JOIN manifest_new n ON o.path = n.path
WHERE o.hash IS NULL OR n.hash IS NULL OR o.hash <> n.hash
""")
def manifest_diff(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return mf.manifest_diff(views.manifest_old(d), views.manifest_new(d))


_STATUS_SQL = q.with_(q.MANIFESTS, """diff AS (
  SELECT coalesce(o.path, n.path) AS path,
    CASE WHEN o.hash IS NULL THEN 'untracked' WHEN n.hash IS NULL THEN 'deleted' ELSE 'changed' END AS status
  FROM manifest_old o FULL OUTER JOIN manifest_new n ON o.path = n.path
  WHERE o.hash IS NULL OR n.hash IS NULL OR o.hash <> n.hash
)""", """statuses AS (
  SELECT path, status FROM diff WHERE status IN ('untracked', 'changed')
  UNION ALL
  SELECT n.path, 'staged' FROM manifest_new n JOIN manifest_old o ON o.path = n.path
)""")


@register("status_merge", _STATUS_SQL + """
SELECT path, arg_min(status, CASE status WHEN 'changed' THEN 0 WHEN 'staged' THEN 1 ELSE 2 END) AS status
FROM statuses GROUP BY path
""")
def status_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    old, new = views.manifest_old(d), views.manifest_new(d)
    diff = mf.manifest_diff(old, new).where(F.col("status").isin("untracked", "changed"))
    staged = new.join(old.select("path"), "path", "left_semi").select("path", F.lit("staged").alias("status"))
    return mf.status_merge(diff.unionByName(staged))


@register("dirty_flag", _STATUS_SQL + """
SELECT count(*) > 0 AS dirty, count(*) FILTER (WHERE status = 'untracked') AS n_untracked,
       count(*) FILTER (WHERE status = 'changed') AS n_changed, count(*) FILTER (WHERE status = 'deleted') AS n_deleted
FROM diff
""")
def dirty_flag(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return mf.dirty_flag(mf.manifest_diff(views.manifest_old(d), views.manifest_new(d)))


@register("set_equal", q.with_(q.MANIFESTS) + """
SELECT a = 0 AND b = 0 AS equal, a AS n_only_a, b AS n_only_b FROM (
  SELECT (SELECT count(*) FROM (SELECT * FROM manifest_old EXCEPT ALL SELECT * FROM manifest_new)) AS a,
         (SELECT count(*) FROM (SELECT * FROM manifest_new EXCEPT ALL SELECT * FROM manifest_old)) AS b
)
""")
def set_equal(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return mf.set_equal(views.manifest_old(d), views.manifest_new(d))


@register("case_convert", """
SELECT p_partkey, p_name,
  array_to_string(list_transform(regexp_extract_all(p_name, '[\\p{L}\\p{N}]+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS pascal,
  array_to_string(list_transform(regexp_extract_all(regexp_replace(p_name, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '[\\p{L}\\p{N}]+'), lambda w: lower(w)), '_') AS snake
FROM part
""")
def case_convert(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return p.select("p_partkey", "p_name", tx.pascal_case(F.col("p_name")).alias("pascal"),
                    tx.snake_case(F.col("p_name")).alias("snake"))


@register("doc_style", """
SELECT doc_id, CASE WHEN contains(text, '-----') THEN 'NumPyDoc'
  WHEN contains(text, 'Args:') OR contains(text, 'Returns:') THEN 'GoogleDoc'
  WHEN contains(text, ':param ') OR contains(text, ':returns:') THEN 'rst' ELSE 'text' END AS style
FROM documents
""")
def doc_style(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", tx.doc_style(F.col("text")).alias("style"))


@register("existing_only", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
""")
def existing_only(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register("top10_cast", """
SELECT c_custkey, c_name, c_acctbal FROM customer
ORDER BY CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) DESC, c_custkey LIMIT 10
""")
def top10_cast(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    key = F.col("c_acctbal").cast("string").cast("double")
    return c.orderBy(key.desc(), "c_custkey").limit(10)
