"""Boosted-tree ranker, group evaluation, feature selection, model I/O.

Training uses MLlib's distributed tree learners on the feature table; the
only driver-side loop is feature selection, which refits a bounded number of
times on a lineage-cut (written) training table.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- fixed values: ranker training ------------------------------------------------------
RANKER_PARAMS = dict(maxIter=100, maxDepth=5, stepSize=0.2, featureSubsetStrategy="0.8", seed=0,
                     lossType="squared")
SCORE_SCALE = 1000
IMPORTANCE_FLOOR = 1e-5
SELECTION_TREES = 120
TEST_HASH_HEADS = ("0", "1", "2")  # md5 first hex digit -> held out (3/16)


def split_by_doc(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deterministic train / test assignment by the md5 of the document key
    (portable across engines, independent of partitioning)."""
    head = F.substring(F.md5(F.col(key).cast("string")), 1, 1)
    return df.withColumn("split", F.when(head.isin(*TEST_HASH_HEADS), F.lit("test")).otherwise(F.lit("train")))


def _safe(features: list[str]) -> list[str]:
    """Positional column names for the assembler (feature names may contain
    characters such as ``.`` that are not plain identifiers)."""
    return [f"f{i}" for i in range(len(features))]


def with_safe_names(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keep],
                     *[F.col(f"`{c}`").cast("double").alias(s) for c, s in zip(features, _safe(features))])


def ranker(features: list[str], label: str = "y", **overrides) -> Pipeline:
    params = dict(RANKER_PARAMS)
    params.update(overrides)
    asm = VectorAssembler(inputCols=_safe(features), outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="margin", **params)
    return Pipeline(stages=[asm, gbt])


def train(df: DataFrame, features: list[str], label: str = "y", **overrides) -> PipelineModel:
    labelled = df.withColumn("_label", F.col(label).cast("double"))
    data = with_safe_names(labelled, features, ["_label"]).withColumnRenamed("_label", label)
    return ranker(features, label, **overrides).fit(data)


def score(model: PipelineModel, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Add ``score`` = raw margin and ``score_int`` = margin x 1000 as int."""
    out = model.transform(with_safe_names(df, features, keep))
    return out.withColumn("score", F.col("margin")).withColumn(
        "score_int", (F.col("margin") * SCORE_SCALE).cast("int")).drop("features", "margin")


def evaluate(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """One row: groups, correct top-1 picks, top-1 accuracy (arg-max score,
    ties to the smallest candidate) and the random baseline mean(1/size).
    One aggregation per group, then one global aggregation."""
    key = F.struct((-F.col(score_col)).alias("s"), F.col("c").alias("c"))
    g = scored.groupBy("doc_id", "line", "pos").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("y", key).alias("hit"))
    return g.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("hit").alias("n_correct"),
        F.round(F.avg("hit"), 9).alias("top1_accuracy"),
        F.round(F.avg(1.0 / F.col("size")), 9).alias("random_top1"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    imp = model.stages[-1].featureImportances
    return {f: float(imp[i]) for i, f in enumerate(features)}


def select_features(train_df: DataFrame, valid_df: DataFrame, features: list[str], label: str = "y",
                    max_rounds: int | None = None, num_trees: int = SELECTION_TREES, seed: int = 0) -> list[str]:
    """Drop features with importance below 1e-5 and refit until none is left;
    then try removing features least-important-first and keep the first
    removal that does not lower validation top-1; start over after it and stop
    when no removal is kept.  ``max_rounds`` can bound the removals kept.

    ``train_df`` / ``valid_df`` should be written tables (lineage cut): every
    refit rescans them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    def fit(cols):
        asm = VectorAssembler(inputCols=_safe(cols), outputCol="features", handleInvalid="keep")
        rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, seed=seed,
                                    probabilityCol="p", rawPredictionCol="raw", predictionCol="pred")
        labelled = train_df.withColumn("_label", F.col(label).cast("double"))
        data = with_safe_names(labelled, cols, ["_label"]).withColumnRenamed("_label", label)
        return Pipeline(stages=[asm, rf]).fit(data)

    def top1(model, cols):
        v = with_safe_names(valid_df, cols, ["doc_id", "line", "pos", "c", "y"])
        s = model.transform(v).withColumn("score", F.get(vector_to_array(F.col("p")), 1))
        return evaluate(s).first()["top1_accuracy"] or 0.0

    cols, rounds = list(features), 0
    while True:
        m = fit(cols)
        imp = m.stages[-1].featureImportances
        keep = [c for i, c in enumerate(cols) if imp[i] >= IMPORTANCE_FLOOR]
        if 0 < len(keep) < len(cols):
            cols = keep
            continue
        if len(cols) < 2 or rounds == max_rounds:
            break
        base, rounds = top1(m, cols), rounds + 1
        for i in sorted(range(len(cols)), key=lambda i: imp[i]):
            trial = cols[:i] + cols[i + 1:]
            if top1(fit(trial), trial) >= base:
                cols = trial
                break
        else:
            break
    return cols
