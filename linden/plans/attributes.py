"""Queries: name.attr pairs, attribute inference, learning fold."""

from __future__ import annotations

from linden.operators import attributes as at
from linden.plans import sql as q
from linden.plans.common import code_lines
from linden.plans.registry import register
from linden.session import materialize

PAIRS = f"""src AS (SELECT doc_id, line, text FROM code_lines WHERE contains(text, '.')),
r AS (
  SELECT doc_id, line, text, 1 AS pos, -1 AS k, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS attr FROM src
  UNION ALL
  SELECT doc_id, line, text,
    pos + length(m.pre) + length(m.n) + length(m.b) + length(m.c) + 1 AS pos, k + 1 AS k,
    m.n || CASE WHEN m.b <> '' THEN '[]' WHEN m.c <> '' THEN '()' ELSE '' END AS name,
    m.a || m.p AS attr
  FROM (SELECT doc_id, line, text, pos, k,
          regexp_extract(substr(text, pos), {q.lit(at.ATTR_PATTERN_ANCHORED)}, ['pre', 'n', 'b', 'c', 'a', 'p']) AS m
        FROM r WHERE regexp_matches(substr(text, pos), {q.lit(at.ATTR_PATTERN_ANCHORED)}))
),
pairs AS (SELECT doc_id, line, CAST(k AS INTEGER) AS k, name, attr FROM r WHERE k >= 0)"""

RECURSIVE = "WITH RECURSIVE " + ",\n".join([q.LINES, q.CODE_LINES, PAIRS])


def _pairs(spark, sf):
    return at.attr_pairs(code_lines(spark, sf))


@register("attr_pairs", RECURSIVE + "\nSELECT doc_id, line, k, name, attr FROM pairs")
def attr_pairs(spark, sf):
    return _pairs(spark, sf)


@register("infer_attributes", RECURSIVE + """,
p AS (SELECT DISTINCT doc_id, name, attr FROM pairs),
co AS (SELECT DISTINCT x.doc_id, x.attr, y.attr AS attr2 FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.name = y.name)
SELECT DISTINCT p.doc_id, p.name, co.attr2 AS attr FROM p JOIN co ON p.doc_id = co.doc_id AND p.attr = co.attr
""")
def infer_attributes(spark, sf):
    # The pair table is read three times (both sides of the co-occurrence
    # join and the final join): written once.
    return at.infer_attributes(materialize(_pairs(spark, sf), "attr-pairs"))


@register("type_attr_maps", RECURSIVE + """,
p AS (SELECT DISTINCT doc_id, name, attr FROM pairs)
SELECT doc_id, 'name' AS side, name AS key, count(*) AS n FROM p GROUP BY doc_id, name
UNION ALL
SELECT doc_id, 'attr' AS side, attr AS key, count(*) AS n FROM p GROUP BY doc_id, attr
""")
def type_attr_maps(spark, sf):
    return at.type_attr_maps(_pairs(spark, sf))


@register("learn_attributes")
def learn_attributes(spark, sf):
    return at.learn_attributes(_pairs(spark, sf))
