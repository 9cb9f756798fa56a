"""Quality classifier: held-out accuracy, the density formula, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from linden.llm import quality
from linden.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op1_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_scores_equal_gaussian_densities(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=(60, quality.SIZE)), rng.normal(1, 2, size=(90, quality.SIZE))]
    rows = [(k, own.tolist()) for k in (0, 1) for own in x[k]]
    model = quality.fit(spark.createDataFrame(rows, "label int, stats array<double>").repartition(5), shrinkage=0.2, temper=1.0)
    scale = np.sqrt(sum(len(o) * o.var(0) for o in x) / 150)
    probe = rng.normal(size=(7, quality.SIZE))
    logs = []
    for own in x:
        c = np.cov((own / scale).T, bias=True)
        c = 0.8 * c + 0.2 * np.trace(c) / quality.SIZE * np.eye(quality.SIZE)
        d = (probe - own.mean(0)) / scale
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.score(probe), 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(90 / 60)))))


def test_statistics_of_odd_texts():
    for text in ("", " ", "\n\n", "a", "\U0010ffff", "word " * 50000, "x" * 100000):
        values = quality.statistics(text)
        assert len(values) == quality.SIZE and np.isfinite(values).all()


def test_nulls_repeats_clashing_columns_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 5.0, "s"), (1, None, 5.0, "s"), (None, "text here", 1.0, "t")],
                                 "doc_id long, text string, score double, stats string")
    none = quality.fit(spark.createDataFrame([], "label int, stats array<double>"))
    out = quality.classify(docs, none)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)] * 3
    assert quality.classify(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    stats = quality.vectors(docs)
    kept = quality.examples_of(stats, labels)
    assert kept.count() == 2 * labels.where("quality = 1 and doc_id = 1").where(~quality.held_out("doc_id")).count()
    assert stats.select(F.size("stats")).distinct().collect()[0][0] == quality.SIZE
