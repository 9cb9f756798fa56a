"""The corpus pipeline: each stage on what the one before kept."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_packing import check_pieces, padding
from tests.llm.test_repeats import brute as brute_repeats

from linden.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "packing"]

    def step(k, docs):
        P.STAGES[k][1](spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        return spark.read.parquet(f"{tmp_path}/{k}")

    first = step(0, docs)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    before, after = texts_of(docs), texts_of(first)
    assert first.columns == COLUMNS and set(after.items()) <= set(before.items())
    right = [(r.doc_id in after) == (r.quality == 1) for r in labels.where(quality.held_out("doc_id")).collect()]
    assert sum(right) / len(right) > 0.85

    second = step(1, first)
    rows = sorted(after.items())
    want = {d for d, _, c in brute_groups(rows, words=5) if d == c}
    assert second.columns == COLUMNS and texts_of(second) == {d: t for d, t in rows if d in want}

    third = step(2, second)
    rows = sorted(texts_of(second).items())
    want = {d: k.decode("utf-8", "ignore") if spans else t
            for (d, t), (_, spans, k) in zip(rows, brute_repeats([t for _, t in rows], P.PASSAGE_BYTES), strict=True)}
    assert third.columns == COLUMNS and texts_of(third) == want
    assert third.where(F.length("text") != F.col("n_chars")).count() == 0

    packed = step(3, third).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(packed, want)
    assert padding(packed) < 0.02

    whole = P.run(spark, SMALL).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed)


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "word " * 40000, None, None, 1), (3, "word " * 40000, None, None, 1),
            (None, "a text of its own here", "en", "s", 2), (4, "é" * 300, "fr", "s", 3), (5, "é" * 300 + " tail", "fr", "s", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SMALL)
            found = out.collect()
            if name == "near_duplicates" and docs.count():
                assert sorted((r.doc_id is None, r.doc_id) for r in found) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, None)]
            assert docs.count() or not found


def test_columns_of_any_name_go_through(spark):
    names = ["stats", "kept_id", "score", "predicted", "spans", "kept", "n_bytes", "own_digest", "rest", "odd name.x", "label"]
    texts = ["The river ran by the old mill, and the people of the town came to see it every spring. " * 3, None, "zz " * 30]
    docs = spark.createDataFrame([(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert all(tuple(r)[2:] == rows[r.doc_id][2:] for r in out.collect()), name
