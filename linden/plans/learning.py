"""Queries: ranker training and scoring, supervised quality model, stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linden.operators import features as ft
from linden.operators import learning as lr
from linden.operators import ngrams
from linden.plans import features as fplans
from linden.plans import stats as splans
from linden.plans.common import documents
from linden.plans.registry import register
from linden.session import materialize, release_shuffles, scratch_path, step_tables
from linden.sources.tables import table

META = {"doc_id", "line", "pos", "c", "y", "t", "split"}


def _matrix(spark, sf):
    # corpus statistics come from the training documents alone
    with step_tables(spark, "ranker"):  # training reads the matrix alone
        m = lr.split_by_doc(fplans.feature_matrix_frame(spark, sf, lambda docs: lr.split_by_doc(docs).where("split = 'train'").drop("split")))
        m = materialize(m, "feature-matrix", keep=1)
    release_shuffles(spark)
    return m


def _feature_cols(df):
    return [c for c in df.columns if c not in META]


def _trained(spark, sf):
    m = _matrix(spark, sf)
    cols = _feature_cols(m)
    model = lr.train(m.where(F.col("split") == "train"), cols)
    return m, cols, model


@register("train_ranker")
def train_ranker(spark, sf):
    m, cols, model = _trained(spark, sf)
    scored = lr.score(model, m.where(F.col("split") == "test"), cols, ["doc_id", "line", "pos", "c", "y"])
    return lr.evaluate(scored).withColumn("n_features", F.lit(len(cols)))


@register("score_candidates")
def score_candidates(spark, sf):
    m, cols, model = _trained(spark, sf)
    scored = lr.score(model, m.where(F.col("split") == "test"), cols, ["doc_id", "line", "pos", "c", "y"])
    return scored.select("doc_id", "line", "pos", "c", "y", "score_int")


def doc_features(spark, sf):
    """Per-document corpus features for the supervised quality target."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)).alias("w"))
    wstats = words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.avg(F.length("w")).alias("avg_word_len"),
        F.count_distinct(F.lower("w")).alias("n_distinct"))
    d = docs.select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        (F.size(F.split("text", "\n", -1))).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("upper_ratio"),
        (F.length(F.regexp_replace("text", r"[^\p{N}]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("digit_ratio"),
        (F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("punct_ratio"),
    )
    return d.join(wstats, "doc_id", "left").na.fill(0.0)


QUALITY_FEATURES = ["n_chars", "n_lines", "upper_ratio", "digit_ratio", "punct_ratio", "n_words", "avg_word_len",
                    "n_distinct"]


@register("quality_model")
def quality_model(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    data = lr.split_by_doc(doc_features(spark, sf).join(labels, "doc_id"))
    data = materialize(data, "quality-data")
    model = lr.train(data.where(F.col("split") == "train"), QUALITY_FEATURES, label="quality")
    pred = lr.score(model, data.where(F.col("split") == "test"), QUALITY_FEATURES, ["doc_id", "quality"])
    return pred.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.round(F.avg(((F.col("score") > 0.5).cast("int") == F.col("quality")).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(F.pow(F.col("score") - F.col("quality"), 2)), 6).alias("mse"),
    )


@register("feature_store", fplans.COMPLETION_SQL.replace(
    "SELECT r.doc_id, r.line, r.pos, r.c, r.y,",
    "SELECT r.doc_id, r.line, r.pos, r.c, r.y, sha256(CAST(r.doc_id AS VARCHAR)) AS doc_key, "
    "CASE WHEN substr(md5(CAST(r.doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END AS split,", 1))
def feature_store(spark, sf):
    """Completion features written once per split, keyed by a content hash
    of the document, and read back (train split only needs present keys)."""
    comp = ft.completion_features(fplans.candidate_frame(spark, sf))
    keyed = comp.withColumn("doc_key", F.sha2(F.col("doc_id").cast("string"), 256))
    keyed = lr.split_by_doc(keyed)
    path = scratch_path(spark, f"feature-store-{uuid.uuid4().hex[:12]}")
    keyed.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path)


@register("stats_roundtrip", splans.PRUNE_SQL)
def stats_roundtrip(spark, sf):
    p = ngrams.pruned_statistics(documents(spark, sf), materialize=True)
    base = scratch_path(spark, f"statistics-{uuid.uuid4().hex[:12]}")
    for name, df in p.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    e = F.lit("")
    tri = spark.read.parquet(f"{base}/trigram").select(F.lit("trigram").alias("gram"), "t2", "t1", "t0", "n")
    bi = spark.read.parquet(f"{base}/bigram").select(F.lit("bigram").alias("gram"), e.alias("t2"), "t1", "t0", "n")
    uni = spark.read.parquet(f"{base}/token").select(F.lit("token").alias("gram"), e.alias("t2"), e.alias("t1"), "t0", "n")
    return tri.unionByName(bi).unionByName(uni)
