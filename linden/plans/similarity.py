"""Queries: string similarity over token pairs that occur in the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linden.functions import similarity as sim
from linden.plans import sql as q
from linden.plans.common import code_tokens
from linden.plans.registry import register

# Distinct pairs of neighbouring identifiers on a code line: the pairs are
# produced by the data itself (linear in it), de-duplicated before scoring.
PAIRS_SQL = """pairs AS (
  SELECT DISTINCT a, b FROM (
    SELECT lag(t) OVER w AS a, lag(kind) OVER w AS ka, t AS b, kind AS kb
    FROM ctokens WINDOW w AS (PARTITION BY doc_id, line ORDER BY pos)
  ) WHERE ka = 'NAME' AND kb = 'NAME'
)"""


def _pairs(spark, sf):
    t = code_tokens(spark, sf)
    w = Window.partitionBy("doc_id", "line").orderBy("pos")
    d = t.select(F.lag("t").over(w).alias("a"), F.lag("kind").over(w).alias("ka"), F.col("t").alias("b"),
                 F.col("kind").alias("kb"))
    return d.where((F.col("ka") == "NAME") & (F.col("kb") == "NAME")).select("a", "b").distinct()


@register("fuzzy_ratio", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, PAIRS_SQL) + f"""
SELECT a, b, {sim.ratio_sql('a', 'b')} AS ratio FROM pairs
""")
def fuzzy_ratio(spark, sf):
    p = _pairs(spark, sf)
    return p.select("a", "b", sim.ratio(F.col("a"), F.col("b")).alias("ratio"))


@register("fuzzy_partial", q.with_(q.LINES, q.CODE_LINES, q.CODE_TOKENS, PAIRS_SQL) + f"""
SELECT a, b, {sim.partial_ratio_sql('lower(a)', 'lower(b)')} AS partial_ratio FROM pairs
""")
def fuzzy_partial(spark, sf):
    p = _pairs(spark, sf)
    return p.select("a", "b", sim.partial_ratio(F.lower("a"), F.lower("b")).alias("partial_ratio"))


@register("abbrev_score")
def abbrev_score(spark, sf):
    # Typed texts are all prefixes of the neighbour; each pair is scored once.
    p = _pairs(spark, sf)
    prefixes = F.transform(F.sequence(F.lit(1), F.length("a")), lambda n: F.lower(F.substring("a", F.lit(1), n)))
    return p.select(F.col("b").alias("target"), F.explode(prefixes).alias("typed")).distinct().select(
        "target", "typed", sim.abbreviation_score_udf(F.col("target"), F.col("typed")).alias("score"))
