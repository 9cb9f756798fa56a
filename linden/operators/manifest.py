"""Manifest comparison: two (path, hash) tables -> file statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: status precedence at load time (lower wins) ---------------------
STATUS_PRIORITY = {"changed": 0, "staged": 1, "untracked": 2}


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): ``untracked`` = only in new, ``deleted`` = only in
    old, ``changed`` = in both with different hashes.  One full outer join
    on path (hash-partitioned on both sides)."""
    j = old.select("path", F.col("hash").alias("old_hash")).join(
        new.select("path", F.col("hash").alias("new_hash")), "path", "full_outer")
    status = (
        F.when(F.col("old_hash").isNull(), F.lit("untracked"))
        .when(F.col("new_hash").isNull(), F.lit("deleted"))
        .when(F.col("old_hash") != F.col("new_hash"), F.lit("changed"))
    )
    return j.select("path", status.alias("status")).where(F.col("status").isNotNull())


def dirty_flag(diff: DataFrame) -> DataFrame:
    """One row: whether anything differs, and counts per status."""
    return diff.agg(
        (F.count(F.lit(1)) > 0).alias("dirty"),
        F.count_if(F.col("status") == "untracked").alias("n_untracked"),
        F.count_if(F.col("status") == "changed").alias("n_changed"),
        F.count_if(F.col("status") == "deleted").alias("n_deleted"),
    )


def status_merge(statuses: DataFrame) -> DataFrame:
    """(path, status) with several statuses per path -> one status per path by
    load-time precedence changed > staged > untracked (an aggregation)."""
    prio = F.create_map(*[x for k, v in STATUS_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return statuses.groupBy("path").agg(F.min_by("status", prio[F.col("status")]).alias("status"))


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal, n_only_a, n_only_b): multiset difference both ways in
    a single aggregation over the tagged union (no join)."""
    cols = a.columns
    x = a.select(*cols, F.lit(1).alias("_s")).unionByName(b.select(*cols, F.lit(-1).alias("_s")))
    d = x.groupBy(*cols).agg(F.sum("_s").alias("_d")).where(F.col("_d") != 0)
    return d.agg(
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("n_only_a"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("n_only_b"),
    ).select(((F.col("n_only_a") == 0) & (F.col("n_only_b") == 0)).alias("equal"), "n_only_a", "n_only_b")
