"""Files that written steps leave behind."""

import os

from linden.llm import common, repeats
from linden.plans import features, learning
from linden.session import materialize
from pyspark.sql import functions as F


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def shuffled(spark):
    return spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))


def test_written_steps_leave_no_shuffle_files(spark):
    kept = shuffle_files(spark)
    assert common.written(shuffled(spark), "step").count() == 1000
    assert materialize(shuffled(spark), "step").count() == 1000
    left = {f for f in shuffle_files(spark) - kept if f.endswith(".data")}
    assert len(left) <= 2  # those of the counts themselves


def test_intermediate_tables_of_repeats_are_removed(spark, monkeypatch):
    paths = []
    fresh = lambda session, name: paths.append(common.fresh_path(session, name)) or paths[-1]
    monkeypatch.setattr(repeats, "fresh_path", fresh)
    docs = spark.createDataFrame([(1, "abc" * 200), (2, "x" + "abc" * 200)], "doc_id long, text string")
    assert repeats.repeated_spans(docs, 100).count() == 2
    assert len(paths) == 1 and not os.path.exists(paths[0].removeprefix("file:"))


def test_training_keeps_the_matrix_alone(spark, tmp_path):
    """The tables that the feature matrix is made from are gone when training begins."""
    text = "\n".join(f"def load(self, path{k}):\n    loaded = path{k}.load(line{k})" for k in range(4))
    spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(base))
    m = learning._matrix(spark, str(tmp_path))
    found = m.count()
    left = set(os.listdir(base)) - before
    assert found > 0 and len(left) == 1 and left.pop().startswith("feature-matrix-")
    frame = features.feature_matrix_frame(spark, str(tmp_path))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before}
    assert frame.count() == found
    assert left == {"feature-matrix", "candidate-rows", "similarity", "position-context"}
