"""Streaming forms of output compaction and request coalescing.

Both keep the latest row of a key, which can be taken batch by batch and once
more over the batches' results: every micro-batch writes its own folder with
the batch operator of ``linden.operators.records``, and reading applies the
same operator to all folders.  A batch that runs again replaces its folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linden.operators import records as rec
from linden.session import scratch_path
from linden.streaming.edits import event_stream


def run_per_batch(spark: SparkSession, stream: DataFrame, fn, name: str) -> DataFrame:
    """``fn`` over the whole stream; ``fn`` keeps the columns it is given, and
    gives the same whether rows come at once or as results of parts."""
    root = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/out/batch=-1")
    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return fn(spark.read.schema(stream.schema).parquet(f"{root}/out").select(stream.columns))


def compact_states_stream(spark: SparkSession, sf_dir: str, state_type: str) -> DataFrame:
    s = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "ts")
    fn = lambda b: rec.compact_states(b, "user_id", F.col("event_type") == state_type, "ts", "event_id").select(b.columns)
    return run_per_batch(spark, s, fn, "compact").drop("ts")


def coalesce_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    fn = lambda b: rec.coalesce_latest(b, "user_id", "ts", "event_id").select(b.columns)
    latest = run_per_batch(spark, s, fn, "coalesce")
    return rec.coalesce_latest(latest, "user_id", "ts", "event_id").select("user_id", "batch_start", "event_id", "event_type")
