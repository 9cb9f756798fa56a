"""Ranker, model round trip, feature selection and the feature registry on
a small synthetic-by-rule feature table derived from code lines."""

import pytest
from pyspark.sql import functions as F

from linden.operators import features as ft
from linden.operators import learning as lr
from linden.session import scratch_path


@pytest.fixture(scope="module")
def table(spark):
    # Groups of three candidates; the positive always has the largest "a"
    # and a noisy "b"; "z" is constant (importance 0).
    rows = []
    for g in range(60):
        for k in range(3):
            rows.append((g, 0, 0, f"c{k}", int(k == g % 3), float(k == g % 3) * 5 + k * 0.1, float((g * 7 + k) % 5), 1.0))
    return spark.createDataFrame(rows, "doc_id long, line int, pos int, c string, y int, a double, `b.x` double, z double")


def test_train_score_evaluate(spark, table):
    model = lr.train(table, ["a", "b.x", "z"], maxIter=5)
    scored = lr.score(model, table, ["a", "b.x", "z"], ["doc_id", "line", "pos", "c", "y"])
    r = lr.evaluate(scored).first()
    assert r.n_groups == 60 and r.top1_accuracy == 1.0
    assert abs(r.random_top1 - 1 / 3) < 1e-6


def test_model_round_trip(spark, table):
    model = lr.train(table, ["a", "b.x"], maxIter=3)
    path = scratch_path(spark, "test-model")
    lr.save_model(model, path)
    again = lr.load_model(path)
    keep = ["doc_id", "line", "pos", "c", "y"]
    a = lr.score(model, table, ["a", "b.x"], keep).select("score").collect()
    b = lr.score(again, table, ["a", "b.x"], keep).select("score").collect()
    assert a == b


def test_feature_selection_drops_useless(spark, table):
    kept = lr.select_features(table, table, ["a", "b.x", "z"], max_rounds=1, num_trees=5)
    assert "a" in kept and "z" not in kept


def test_registry_rules():
    reg = ft.FeatureRegistry()
    reg.register("f1")(lambda: F.lit(1))
    reg.register("f2", normalized=True)(lambda: F.lit(2))
    assert list(reg.completion) == ["f1", "f2"] and reg.normalized == ["f2"]
    with pytest.raises(ValueError):
        reg.register("bad", is_context=True, normalized=True)


def test_context_feature_order():
    names = list(ft.REGISTRY.context)
    assert names[:5] == ["blank_line_before", "line_number", "indent", "indent_delta", "at_line_start"]
    assert len(names) == 52


def test_feature_selection_goes_on_until_nothing_changes(spark):
    # Each of six features is mute on its own sixth of the training groups and
    # tells all on the validation groups: any five can go.
    names = [f"a{k}" for k in range(6)]
    schema = "doc_id long, line int, pos int, c string, y int, " + ", ".join(f"{c} double" for c in names)

    def table_of(mute):
        return spark.createDataFrame([(g, 0, 0, f"c{k}", int(k == g % 3), *[float(k == g % 3 and not mute(g, f)) * 5 for f in range(6)])
                                      for g in range(72) for k in range(3)], schema)

    train, valid = table_of(lambda g, f: g % 6 == f), table_of(lambda g, f: False)
    assert len(lr.select_features(train, valid, names, num_trees=10)) == 1


def test_split_lists_are_disjoint_used_and_replaced_one_by_one(spark, tmp_path):
    from linden.operators import corpus
    path = f"{tmp_path}/lists"
    docs = spark.range(40).withColumnRenamed("id", "doc_id")
    corpus.write_lists(corpus.seeded_split(docs, "doc_id", 10, 10, 10), "doc_id", path)
    feats = docs.where("doc_id % 3 > 0").selectExpr("doc_id", "doc_id * 2 AS x")
    listed = {s: {r.doc_id for r in spark.read.parquet(path).where(F.col("split") == s).collect()} for s in ("statistic", "training", "testing")}
    assert [len(v) for v in listed.values()] == [10, 10, 10] and len(set().union(*listed.values())) == 30
    got = {s: {r.doc_id: (r.x, r.missing) for r in corpus.load_split(feats, path, "doc_id", s).collect()} for s in listed}
    for s in ("statistic", "training"):
        assert got[s] == {d: (2 * d, False) for d in listed[s] if d % 3}
    assert got["testing"] == {d: (2 * d, False) if d % 3 else (None, True) for d in listed["testing"]}
    corpus.write_lists(spark.createDataFrame([(39, "testing")], "doc_id long, split string"), "doc_id", path)
    again = {(r.split, r.doc_id) for r in spark.read.parquet(path).collect()}
    assert again == {(s, d) for s in ("statistic", "training") for d in listed[s]} | {("testing", 39)}


def test_held_out_documents_do_not_count(spark):
    from linden.operators import learning as lr
    from linden.operators import ngrams
    docs = lr.split_by_doc(spark.range(60).withColumnRenamed("id", "doc_id")).collect()
    assert {r.split for r in docs} == {"train", "test"}
    lines = spark.createDataFrame([(r.doc_id, k, f"common {r.split}word common") for r in docs for k in range(30)], "doc_id long, line int, text string")
    counted = ngrams.pruned_statistics(lr.split_by_doc(lines).where("split = 'train'").drop("split"))
    tokens = {r.t0 for r in counted["token"].collect()}
    assert "trainword" in tokens and "testword" not in tokens
