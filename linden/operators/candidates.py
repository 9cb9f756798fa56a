"""Completion positions, labelled candidate sets and their evaluation.

A *position* is a NAME token of at least two characters that starts with a
letter or digit; the typed prefix is its first character.  Its *candidates*
are the distinct NAME tokens of the same document first seen on an earlier
line and starting with the same character; the label marks the actual token.
Positions whose token is not among its candidates are "not available" and
form no group.

The candidate join is an equi-join on (doc_id, first character) followed by
a filter on first-seen line; AQE splits a crowded key on the larger side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx

# --- fixed values: evaluation ---------------------------------------------------------
UNIT_SCALE = 10000
MIN_SCALE_RANGE = 0.001
KNOWN_INITIAL_BOOST = 0.3


def positions(tokens: DataFrame) -> DataFrame:
    """(doc_id, line, pos, t, p): completion positions with typed prefix p."""
    return tokens.where(
        (F.col("kind") == lx.KIND_NAME) & (F.length("t") >= 2) & F.col("t").rlike(r"^[\p{L}\p{N}]")
    ).select("doc_id", "line", "pos", "t", F.substring("t", 1, 1).alias("p"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(doc_id, c, p, first_line): NAME tokens with their first line."""
    return (
        tokens.where(F.col("kind") == lx.KIND_NAME)
        .groupBy("doc_id", F.col("t").alias("c"))
        .agg(F.min("line").alias("first_line"))
        .withColumn("p", F.substring("c", 1, 1))
    )


def candidates(tokens: DataFrame) -> DataFrame:
    """(doc_id, line, pos, t, c, y): one row per (position, candidate) for
    positions that have their own token among the candidates."""
    vocab = vocabulary(tokens)
    pos = positions(tokens)
    # A group has a positive iff the token itself was seen on an earlier line.
    first = vocab.select("doc_id", F.col("c").alias("t"), F.col("first_line").alias("_t_first"))
    pos = pos.join(first, ["doc_id", "t"]).where(F.col("_t_first") < F.col("line")).drop("_t_first")
    j = pos.join(vocab, ["doc_id", "p"]).where(F.col("first_line") < F.col("line"))
    return j.select("doc_id", "line", "pos", "t", "c", (F.col("c") == F.col("t")).cast("int").alias("y"))


def members(tokens: DataFrame) -> DataFrame:
    """(doc_id, line, pos, name, t): NAME tokens behind ``name.``, in order."""
    w = Window.partitionBy("doc_id", "line").orderBy("pos")
    near = tokens.select("doc_id", "line", "pos", "kind", "t", F.lag("t").over(w).alias("dot"), F.lag("t", 2).over(w).alias("name"), F.lag("kind", 2).over(w).alias("of"))
    return near.where((F.col("kind") == lx.KIND_NAME) & (F.col("dot") == ".") & (F.col("of") == lx.KIND_NAME)).select("doc_id", "line", "pos", "name", "t")


def dot_candidates(tokens: DataFrame) -> DataFrame:
    """(doc_id, line, pos, name, t, c, y): completions offered right behind
    ``name.``, where nothing is typed yet: what the document has used as a
    member of that name on an earlier line.  A member is valid from the line
    behind its first use on, so the state of any line is an interval join on
    the name.  Positions whose own token is not offered form no group."""
    found = members(tokens)
    known = found.groupBy("doc_id", "name", F.col("t").alias("c")).agg((F.min("line") + 1).alias("valid_from"))
    own = known.select("doc_id", "name", F.col("c").alias("t"), F.col("valid_from").alias("own_from"))
    asked = found.join(own, ["doc_id", "name", "t"]).where(F.col("own_from") <= F.col("line")).drop("own_from")
    offered = asked.join(known, ["doc_id", "name"]).where(F.col("valid_from") <= F.col("line"))
    return offered.select("doc_id", "line", "pos", "name", "t", "c", (F.col("c") == F.col("t")).cast("int").alias("y"))


def group_sizes(cands: DataFrame) -> DataFrame:
    return cands.groupBy("doc_id", "line", "pos").agg(
        F.count(F.lit(1)).alias("size"), F.sum("y").alias("n_pos"))


def naive_accuracy(tokens: DataFrame, cands: DataFrame) -> DataFrame:
    """One row: naive accuracy = mean of 1/group size over accepted groups,
    with success / failure counts over all positions."""
    g = group_sizes(cands)
    p = positions(tokens).select("doc_id", "line", "pos").join(g, ["doc_id", "line", "pos"], "left")
    return p.agg(
        F.count_if(F.col("size").isNotNull()).alias("successful"),
        F.count_if(F.col("size").isNull()).alias("failed"),
        F.round(F.avg(1.0 / F.col("size")), 9).alias("naive_accuracy"),
    )


def random_baseline(cands: DataFrame) -> DataFrame:
    """One row: groups, sum of 1/size (expected hits of a random pick), its
    mean, and the number of groups whose labels do not sum to one."""
    g = group_sizes(cands)
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.round(F.sum(1.0 / F.col("size")), 6).alias("expected_hits"),
        F.round(F.avg(1.0 / F.col("size")), 9).alias("random_top1"),
        F.count_if(F.col("n_pos") != 1).alias("bad_groups"),
    )


def top1(scored: DataFrame, score: str = "score") -> DataFrame:
    """(doc_id, line, pos, t, pick, hit): the arg-max candidate per group;
    ties go to the smallest candidate name.  An aggregation (min_by), so no
    group is materialised."""
    key = F.struct((-F.col(score)).alias("s"), F.col("c").alias("c"))
    return scored.groupBy("doc_id", "line", "pos", "t").agg(
        F.min_by("c", key).alias("pick"), F.min_by("y", key).alias("hit"))


def top1_accuracy(scored: DataFrame, score: str = "score") -> DataFrame:
    t = top1(scored, score)
    return t.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("hit").alias("n_correct"),
                 F.round(F.avg("hit"), 9).alias("top1_accuracy"))


def known_initial(scored: DataFrame, score: str = "score") -> DataFrame:
    """Boost scores of candidates whose first character equals the token's."""
    boost = F.when(F.substring("c", 1, 1) == F.substring("t", 1, 1), F.lit(KNOWN_INITIAL_BOOST)).otherwise(F.lit(0.0))
    return scored.withColumn(score, F.col(score) + boost)


def outcome_rollup(tokens: DataFrame, scored: DataFrame, score: str = "score") -> DataFrame:
    """One row: correct / wrong / not available / not required (1-character
    names) with accuracy = c/(c+w) and success = c/(c+w+na)."""
    names = tokens.where((F.col("kind") == lx.KIND_NAME) & F.col("t").rlike(r"^[\p{L}\p{N}]"))
    t = top1(scored, score).select("doc_id", "line", "pos", "hit")
    j = names.select("doc_id", "line", "pos", "t").join(t, ["doc_id", "line", "pos"], "left")
    outcome = (
        F.when(F.length("t") == 1, F.lit("not_required"))
        .when(F.col("hit").isNull(), F.lit("not_available"))
        .when(F.col("hit") == 1, F.lit("correct"))
        .otherwise(F.lit("wrong"))
    )
    r = j.agg(*[F.count_if(outcome == k).alias(k) for k in ("correct", "wrong", "not_available", "not_required")])
    c, w, na = F.col("correct"), F.col("wrong"), F.col("not_available")
    return r.select("*", F.round(F.try_divide(c, c + w), 9).alias("accuracy"),
                    F.round(F.try_divide(c, c + w + na), 9).alias("success"))


def minmax_scale(scored: DataFrame, col: str, out: str) -> DataFrame:
    """Scale ``col`` to 0..10000 within each group when its range is at least
    0.001 (truncated to int); otherwise keep the value."""
    g = scored.groupBy("doc_id", "line", "pos").agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = scored.join(g, ["doc_id", "line", "pos"])
    rng = F.col("_mx") - F.col("_mn")
    scaled = F.when(rng >= MIN_SCALE_RANGE, (F.lit(UNIT_SCALE) * (F.col(col) - F.col("_mn")) / rng).cast("long")) \
        .otherwise(F.col(col).cast("long"))
    return j.withColumn(out, scaled).drop("_mn", "_mx")


def frequency_scored(cands: DataFrame, unigrams: DataFrame) -> DataFrame:
    """Score each candidate by its corpus frequency (0 when unseen)."""
    u = unigrams.select(F.col("t0").alias("c"), F.col("n").alias("_n"))
    return cands.join(u, "c", "left").withColumn("score", F.coalesce(F.col("_n"), F.lit(0)).cast("double")).drop("_n")


def dataset_shape(cands: DataFrame, n_features: int) -> DataFrame:
    return cands.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("doc_id", "line", "pos").alias("n_groups"),
        F.sum("y").alias("n_positive"),
    ).withColumn("n_features", F.lit(n_features))
