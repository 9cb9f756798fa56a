"""Word vocabularies, dictionary lookups and prefix completion.

A dictionary is a table ``(w STRING, f BIGINT)`` of lower-case words and
frequencies.  Lookups are joins; Catalyst/AQE choose broadcast only when the
measured size of a side is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx

# --- fixed values: dictionary ----------------------------------------------------
HEAD_LEN = 3          # words are filed under their first three characters
MIN_DICT_WORD_LEN = 4  # dictionary words must be longer than 3
TOP_PER_PREFIX = 6


def words_of(text: Column) -> Column:
    """Lower-cased letter runs of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(lx.WORD_PATTERN), 0)


def vocabulary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, f): word frequencies; partial aggregation before the shuffle keeps
    frequent words cheap."""
    return (
        df.select(F.explode(words_of(F.col(text_col))).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    )


def prefix_top(dictionary: DataFrame, k: int = TOP_PER_PREFIX) -> DataFrame:
    """(p, w, f, rank): the k most frequent dictionary words (longer than 3)
    under each 3-character head; ties by word.  ``row_number() <= k`` is
    planned as a partial group limit before the shuffle, so a crowded head
    sends at most k rows per task."""
    d = dictionary.where(F.length("w") >= MIN_DICT_WORD_LEN).withColumn("p", F.substring("w", 1, HEAD_LEN))
    w = Window.partitionBy("p").orderBy(F.col("f").desc(), F.col("w"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("p", "w", "f", "rank")


def search_prefix(dictionary: DataFrame, s: str, k: int = TOP_PER_PREFIX) -> DataFrame:
    """Top-k dictionary words starting with ``s`` (at least 3 characters)."""
    d = dictionary.where((F.length("w") >= MIN_DICT_WORD_LEN)
                         & (F.substring("w", 1, HEAD_LEN) == s[:HEAD_LEN])
                         & F.col("w").startswith(s))
    return d.orderBy(F.col("f").desc(), "w").limit(k)


def dictionary_prefixes(dictionary: DataFrame) -> DataFrame:
    """(prefix): every prefix of length >= 3 of every dictionary word longer
    than 3, distinct.  Turns "some dictionary word starts with x" into an
    equi-join on x."""
    d = dictionary.where(F.length("w") >= MIN_DICT_WORD_LEN)
    cuts = F.sequence(F.lit(HEAD_LEN), F.length("w"))
    return (
        d.select(F.explode(F.transform(cuts, lambda n: F.substring(F.col("w"), 1, n))).alias("prefix"))
        .distinct()
    )


def unknown_words(words: DataFrame, dictionary: DataFrame, col: str = "w") -> DataFrame:
    """Rows of ``words`` whose word is not in the dictionary (left anti)."""
    return words.join(dictionary.select(F.col("w").alias(col)), col, "left_anti")


def not_a_prefix(words: DataFrame, dictionary: DataFrame, col: str = "w") -> DataFrame:
    """Rows of ``words`` (at least 3 characters) that start no dictionary word."""
    pre = dictionary_prefixes(dictionary).withColumnRenamed("prefix", col)
    return words.where(F.length(col) >= HEAD_LEN).join(pre, col, "left_anti")


def union_words(*dicts: DataFrame) -> DataFrame:
    out = dicts[0].select("w")
    for d in dicts[1:]:
        out = out.union(d.select("w"))
    return out.distinct()


def intersect_words(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("w").intersect(b.select("w"))


def plural_pairs(vocab: DataFrame) -> DataFrame:
    """(singular, plural) where both ``s`` and ``s || 's'`` are in the
    vocabulary -- the pairs a ``for singular in plural`` rule can use."""
    v = vocab.select("w")
    plural = v.where(F.col("w").endswith("s") & (F.length("w") > 1)).select(
        F.col("w").alias("plural"), F.expr("substring(w, 1, length(w) - 1)").alias("singular"))
    return plural.join(v.withColumnRenamed("w", "singular"), "singular", "left_semi").select("singular", "plural")
