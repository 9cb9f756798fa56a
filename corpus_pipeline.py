"""Training corpus from the documents table: quality, near-duplicates, repeated
passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result as Parquet and hands what it reads back to the
next.  All stages but the last return the columns of ``documents``.

Nulls and edge cases: a null text is an empty one and stays null in what a
stage keeps; null and repeated doc_ids stay rows of their own, but of rows
equal in doc_id and text near_duplicates keeps one; texts of any length are
taken whole; an empty table gives no rows.  Columns beside doc_id and text,
whatever their names, go through all but the last stage as they are, except
that n_chars follows the text where passages are cut.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linden.llm import minhash, packing, quality, repeats
from linden.llm.common import bounded_batches, tokenizer_path, written
from linden.sources.tables import table

QUALITY_THRESHOLD = 0.3
PASSAGE_BYTES = 240  # about fifty short words
CLASS_WORDS, CLASS_PERCENT = 5, 80


def begin(spark: SparkSession) -> None:
    """At the start of a stage: bounded Arrow batches, and a collection of
    garbage on the driver, upon which Spark removes the shuffle files of plans
    that nothing refers to any more, those of earlier stages among them."""
    bounded_batches(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def framed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): other columns in one, so that none can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(None).cast("string").alias("none")]).alias("rest"))


def unframed(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that ``framed`` was given, some of them ``new``."""
    old = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c)
    return rows.select(*[new.get(c, old(c)).alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them,
    does not reject."""
    begin(spark)
    # statistics are computed again for the scores: writing them beside the texts would take another copy of those
    stats = written(quality.vectors(docs.select("doc_id", "text"), drop_text=True), "pipeline-stats")
    model = quality.fit(quality.examples_of(stats, table(spark, sf_dir, "labels")))
    return unframed(quality.classify(framed(docs), model, QUALITY_THRESHOLD).where("predicted = 1"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in five-word shingles; of rows
    with equal doc_id and text one stays."""
    begin(spark)
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), CLASS_WORDS, CLASS_PERCENT)
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = framed(docs).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")))
    return unframed(rows.dropDuplicates(["doc_id", "text"]), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too.  A passage may
    begin or end inside a character; its rest goes with it."""
    begin(spark)
    rows = repeats.remove_repeats(framed(docs), PASSAGE_BYTES, as_text=True)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept"))
    return unframed(rows, docs.columns, text=text, n_chars=F.length(text).cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids, in doc_id order."""
    begin(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("packing", pack_sequences),
]

#: No stage can be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
