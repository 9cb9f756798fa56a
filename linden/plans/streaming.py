"""Queries: edit-stream maintenance and streaming compaction (each with a
batch SQL twin over the same edit log)."""

from __future__ import annotations

from linden.plans import sql as q
from linden.plans.common import doc_lines, documents
from linden.plans.records import STATE_TYPE
from linden.plans.registry import register
from linden.sources import views
from linden.sources.tables import table
from linden.streaming import changelog, compact, daily, edits, splices

EDITS_SQL = [q.LINES, q.EDIT_LOG, """known AS (
  SELECT e.doc_id, e.line, e.text, e.ts, e.seq, l.text AS base FROM edit_log e
  JOIN lines l ON l.doc_id = e.doc_id AND l.line = e.line
)"""]


def _run(spark, sf):
    return edits.run_edit_stream(spark, sf, doc_lines(spark, sf))


@register("dirty_lines", q.with_(*EDITS_SQL) + """
SELECT doc_id, line, seq FROM (
  SELECT doc_id, line, seq, text <> coalesce(lag(text) OVER (PARTITION BY doc_id, line ORDER BY ts, seq), base) AS dirty
  FROM known
) WHERE dirty
""")
def dirty_lines(spark, sf):
    return _run(spark, sf).read("dirty")


@register("stream_edit_latest", q.with_(*EDITS_SQL) + """
SELECT doc_id, line, arg_max(text, (ts, seq)) AS text FROM known GROUP BY doc_id, line
""")
def stream_edit_latest(spark, sf):
    return _run(spark, sf).read("lines")


@register("postings_after_edits", q.with_(*EDITS_SQL, """final AS (
  SELECT l.doc_id, l.line, coalesce(k.text, l.text) AS text FROM lines l
  LEFT JOIN (SELECT doc_id, line, arg_max(text, (ts, seq)) AS text FROM known GROUP BY doc_id, line) k
    ON k.doc_id = l.doc_id AND k.line = l.line
)""", q.tokens_over("final", "ftokens")) + """
SELECT doc_id, t, line, count(*) AS n FROM ftokens GROUP BY doc_id, t, line
""")
def postings_after_edits(spark, sf):
    docs = documents(spark, sf)
    return edits.run_edit_stream(spark, sf, views.lines(docs), documents=docs).read("postings")


@register("rejected_edits", q.with_(q.LINES, q.EDIT_LOG) + """
SELECT e.doc_id, e.line, e.seq FROM edit_log e
LEFT JOIN lines l ON l.doc_id = e.doc_id AND l.line = e.line WHERE l.text IS NULL
""")
def rejected_edits(spark, sf):
    return _run(spark, sf).rejected()


SPLICE_SQL = q.with_(q.LINES, """splice_log AS (
  SELECT doc_id, a, a + CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 1 WHEN 'purchase' THEN 3 ELSE 0 END AS b,
         CASE event_type WHEN 'error' THEN []::VARCHAR[]
           WHEN 'signup' THEN [event_type || ':1:' || CAST(seq AS VARCHAR), event_type || ':2:' || CAST(seq AS VARCHAR)]
           ELSE [event_type || ':1:' || CAST(seq AS VARCHAR)] END AS added, ts, seq
  FROM (SELECT user_id AS doc_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) // 4 AS a, event_type, ts, event_id AS seq FROM events)
)""", "base AS (SELECT doc_id, list(text ORDER BY line) AS lines FROM lines GROUP BY doc_id)", """folded AS (
  SELECT doc_id, list_reduce(es, lambda acc, e:
    CASE WHEN e.a IS NULL OR e.a < 0 OR e.b > len(acc.lines) THEN {'lines': acc.lines, 'bad': list_append(acc.bad, e.seq)}
    ELSE {'lines': list_concat(list_concat(acc.lines[1:e.a], e.added), acc.lines[e.b + 1:]), 'bad': acc.bad} END,
    {'lines': lines, 'bad': []::BIGINT[]}) AS r
  FROM (SELECT s.doc_id, any_value(b.lines) AS lines, list({'a': s.a, 'b': s.b, 'added': s.added, 'seq': s.seq} ORDER BY s.ts, s.seq) AS es
        FROM splice_log s JOIN base b ON b.doc_id = s.doc_id GROUP BY s.doc_id)
)""")


@register("splice_stream", SPLICE_SQL + """
SELECT doc_id, CAST(generate_subscripts(r.lines, 1) - 1 AS INTEGER) AS line, unnest(r.lines) AS text FROM folded
""")
def splice_stream(spark, sf):
    base = doc_lines(spark, sf)
    return splices.splices_of_events(spark, sf, base).lines(base)


@register("splice_rejected", SPLICE_SQL + """
SELECT doc_id, unnest(r.bad) AS seq, 'range' AS reason FROM folded
UNION ALL SELECT doc_id, seq, 'document' FROM splice_log s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id)
""")
def splice_rejected(spark, sf):
    return splices.splices_of_events(spark, sf, doc_lines(spark, sf)).rejected()


ARRIVALS_SQL = q.with_("""spans AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events)""", """arrived AS (
  SELECT event_id, user_id, ts, least(3, ((epoch_us(ts) - a) * 4) // (b - a + 1) + CASE WHEN event_id % 40 = 7 THEN 1 ELSE 0 END) AS batch
  FROM events, spans
)""", """marks AS (
  SELECT t.batch, (SELECT max(epoch_ms(ts)) - 3600000 FROM arrived s WHERE s.batch < t.batch) AS mark FROM (SELECT unnest(range(0, 5)) AS batch) t
)""", """sorted_out AS (
  SELECT x.*, coalesce(epoch_ms(x.ts) < m.mark, false) AS late FROM arrived x JOIN marks m ON m.batch = x.batch
)""")


@register("closed_days", ARRIVALS_SQL + """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM sorted_out WHERE NOT late
GROUP BY user_id, CAST(ts AS DATE)
HAVING epoch_ms(CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)) <= (SELECT mark FROM marks WHERE batch = 4)
""")
def closed_days(spark, sf):
    return daily.replay(spark, table(spark, sf, "events")).closed_days()


@register("late_events", ARRIVALS_SQL + """
SELECT user_id, event_id FROM sorted_out WHERE late
""")
def late_events(spark, sf):
    return daily.replay(spark, table(spark, sf, "events")).late()


@register("tree_state", """
SELECT path FROM (
  SELECT 'u' || CAST(user_id AS VARCHAR) || '/' || json_extract_string(props, '$.k') AS path,
         arg_max(CASE event_type WHEN 'signup' THEN 'create' ELSE 'delete' END, (ts, event_id)) AS op
  FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1
) WHERE op = 'create'
""")
def tree_state(spark, sf):
    return changelog.tree_state(changelog.file_events(table(spark, sf, "events")))


RENAMES_SQL = """log AS (
  SELECT root, CASE WHEN moves THEN own ELSE entry END AS path, op, CASE WHEN moves THEN root || '/d' || CAST((k * 7 + 3) % 10 AS VARCHAR)
         WHEN op = 'rename' THEN entry || 'x' END AS new_path, ts, seq
  FROM (SELECT *, op = 'rename' AND k % 2 = 0 AS moves, root || '/d' || CAST(k // 10 AS VARCHAR) AS own,
               root || '/d' || CAST(k // 10 AS VARCHAR) || '/f' || CAST(k AS VARCHAR) AS entry
        FROM (SELECT 'u' || CAST(user_id AS VARCHAR) AS root, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts, event_id AS seq,
                     CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' END AS op
              FROM events))
  WHERE op IS NOT NULL AND k IS NOT NULL
), folded AS (
  SELECT root, list_reduce(es, lambda acc, e: CASE e.op
      WHEN 'create' THEN {'paths': list_distinct(list_append(acc.paths, e.path))}
      WHEN 'delete' THEN {'paths': list_filter(acc.paths, lambda p: p <> e.path AND NOT starts_with(p, e.path || '/'))}
      ELSE {'paths': list_distinct(list_transform(acc.paths, lambda p:
        CASE WHEN p = e.path OR starts_with(p, e.path || '/') THEN e.new_path || substr(p, length(e.path) + 1) ELSE p END))} END,
    {'paths': []::VARCHAR[]}) AS r
  FROM (SELECT root, list({'op': op, 'path': path, 'new_path': new_path} ORDER BY ts, seq) AS es FROM log GROUP BY root)
)"""


@register("tree_renames", q.with_(RENAMES_SQL) + """
SELECT root, unnest(r.paths) AS path FROM folded
""")
def tree_renames(spark, sf):
    return changelog.tree_state_with_renames(changelog.rename_events(table(spark, sf, "events")))


@register("opened_paths", q.with_("""log AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS root, CASE event_type WHEN 'error' THEN [top] ELSE [top, 's' || CAST(k AS VARCHAR), CAST(k % 3 AS VARCHAR)] END AS parts,
         event_type IN ('view', 'click') AS opens, ts, event_id AS seq
  FROM (SELECT *, 'd' || CAST(k // 10 AS VARCHAR) AS top FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
  WHERE event_type <> 'signup' AND k IS NOT NULL
), opened AS (
  SELECT root, ts, seq, parts[1:unnest(range(1, len(parts) + 1))] AS parts FROM log WHERE opens
)""") + """
SELECT o.root, array_to_string(o.parts, '/') AS path, count(*) AS opens FROM opened o
WHERE NOT EXISTS (SELECT 1 FROM log c WHERE NOT c.opens AND c.root = o.root AND c.parts = o.parts[1:len(c.parts)] AND (c.ts, c.seq) > (o.ts, o.seq))
GROUP BY o.root, o.parts
""")
def opened_paths(spark, sf):
    return changelog.opened_paths(changelog.open_events(table(spark, sf, "events")))


@register("stream_compact_states", f"""
SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> '{STATE_TYPE}'
UNION ALL
SELECT arg_max(event_id, (ts, event_id)), user_id, arg_max(event_type, (ts, event_id)), arg_max(value, (ts, event_id))
FROM events WHERE event_type = '{STATE_TYPE}' GROUP BY user_id
""")
def stream_compact_states(spark, sf):
    return compact.compact_states_stream(spark, sf, STATE_TYPE)


@register("stream_coalesce_latest", """
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS batch_start,
       arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
FROM events GROUP BY user_id, time_bucket(INTERVAL 1 HOUR, ts)
""")
def stream_coalesce_latest(spark, sf):
    return compact.coalesce_latest_stream(spark, sf)
