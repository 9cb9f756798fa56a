"""Corpus building: scan filters, seeded sampling and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: corpus scan ---------------------------------------------------
MIN_SIZE_EXCLUSIVE = 100
MAX_SIZE_EXCLUSIVE = 100_000


def corpus_filter(df: DataFrame, path_col: str = "path", size_col: str = "size",
                  suffix: str | None = None) -> DataFrame:
    """Drop hidden / dunder paths, keep ``suffix`` files (when given) whose
    size is strictly between 100 and 100000.  A pure filter: it is pushed
    into the parquet scan where the columns are stored."""
    p = F.col(path_col)
    cond = (
        (F.col(size_col) > MIN_SIZE_EXCLUSIVE) & (F.col(size_col) < MAX_SIZE_EXCLUSIVE)
        & ~p.contains("/.") & ~p.contains("__")
    )
    if suffix:
        cond = cond & p.endswith(suffix)
    return df.where(cond)


def binary_corpus(spark, root: str, glob: str = "*.py") -> DataFrame:
    """Recursive file scan of a directory tree (path, size, text), filtered
    like ``corpus_filter``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("text"))
    )
    return corpus_filter(files, "path", "size")


def seeded_order(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random order key (md5 of seed and key)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def seeded_split(df: DataFrame, key: str, n_stat: int, n_train: int, n_valid: int,
                 seed: int = 26, pinned: tuple | None = None) -> DataFrame:
    """Sample ``n_stat + n_train + n_valid`` rows without replacement in a
    seeded order, and label them statistic / training / testing.

    The ranking is a global sort on a hash (range-partitioned by Spark), not a
    single-partition window: ``row_number`` over a sorted, zipped index."""
    total = n_stat + n_train + n_valid
    ranked = df.withColumn("_o", seeded_order(F.col(key), seed))
    # Top-`total` by hash: Catalyst turns orderBy+limit into TakeOrderedAndProject
    # (per-partition top-k, then a merge of k rows per partition).
    top = ranked.orderBy("_o", key).limit(total)
    w = Window.orderBy("_o", key)  # over at most `total` rows
    r = top.withColumn("rank", F.row_number().over(w) - 1)
    split = (
        F.when(F.col("rank") < n_stat, F.lit("statistic"))
        .when(F.col("rank") < n_stat + n_train, F.lit("training"))
        .otherwise(F.lit("testing"))
    )
    if n_train == 1 and n_valid == 1 and pinned is not None:
        # The special case keeps the sample for statistics but pins the two
        # other lists to given keys.
        train_key, test_key = pinned
        stat = r.where(F.col("rank") < n_stat).select(key, split.alias("split"))
        pins = df.where(F.col(key).isin(train_key, test_key)).select(
            key, F.when(F.col(key) == train_key, F.lit("training")).otherwise(F.lit("testing")).alias("split"))
        return stat.unionByName(pins)
    return r.select(key, split.alias("split"), "rank")


def write_lists(splits: DataFrame, key: str, path: str) -> None:
    """Write split lists (``key``, split), a folder to each split; only the
    splits that ``splits`` holds are replaced."""
    splits.select(key, "split").write.partitionBy("split").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def load_split(features: DataFrame, path: str, key: str, split: str) -> DataFrame:
    """``features`` of the listed keys of a split, and ``missing``.  A key
    without features is left out, except in the testing split, where it must
    not go unnoticed: it comes with null features and ``missing`` set."""
    listed = features.sparkSession.read.parquet(path).where(F.col("split") == split).select(F.col(key).alias("_listed")).distinct()
    if split != "testing":
        return features.join(listed, F.col(key) == F.col("_listed"), "left_semi").withColumn("missing", F.lit(False))
    known = features.withColumn("missing", F.lit(False))
    rest = [F.col(c) for c in features.columns if c != key]
    return listed.join(known, F.col("_listed") == F.col(key), "left").select(F.col("_listed").alias(key), *rest, F.coalesce("missing", F.lit(True)).alias("missing"))
