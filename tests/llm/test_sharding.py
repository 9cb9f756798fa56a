"""Sharding: every row once, exact counts, a whole and even shuffle, edge cases."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from linden.llm import sharding
from linden.llm.queries import QUERIES
from tests.conftest import SMALL


def shards_of(rows, column="doc_id"):
    found = {}
    for r in sorted(rows, key=lambda r: r.slot):
        found.setdefault(r.shard, []).append(r)
    for own in found.values():
        assert [r.slot for r in own] == list(range(len(own)))
    return found


def test_query_whole_table(spark):
    rows = QUERIES["op11_sharding"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    found = shards_of(rows)
    counts = [len(found.get(k, [])) for k in range(24)]
    assert set(found) <= set(range(24)) and max(counts) - min(counts) <= 1
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_seeds_order_and_buckets(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    orders = [[r.doc.doc_id for own in sorted(shards_of(sharding.write_shards(docs, 7, seed=s, bucket_bytes=40_000).collect()).items())
               for r in own[1]] for s in (1, 1, 2)]
    assert sorted(orders[0]) == list(range(5000)) and orders[0] == orders[1] != orders[2]
    # places do not follow ids: neighbours in the input lie a third of the whole apart, as in a random order
    place = {d: i for i, d in enumerate(orders[0])}
    gap = sum(abs(place[i] - place[i + 1]) for i in range(4999)) / 4999 / 5000
    assert 0.31 < gap < 0.36
    b = sharding.shuffled_buckets(docs, 1, 40_000).groupBy("bucket").count().collect()
    assert len(b) == 14 and max(r["count"] for r in b) < 500


def test_one_text_and_id_for_a_third_of_rows_is_spread(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    found = shards_of(sharding.write_shards(docs, 10, bucket_bytes=4_000).collect())
    hot = [sum(r.doc.text == "copy" for r in own) for own in found.values()]
    assert {len(x) for x in found.values()} == {600} and sum(hot) == 2000 and 150 < min(hot) and max(hot) < 250
    b = sharding.shuffled_buckets(docs, 11, 4_000).groupBy("bucket").count().collect()
    assert max(r["count"] for r in b) < 3 * 6000 / len(b)


def test_edges(spark):
    schema = "doc_id long, text string, shard string, slot int, doc string, number int, bucket int"
    rows = [(None, None, "s", 1, "d", 2, 3), (1, "", None, None, None, None, None), (1, "", None, None, None, None, None), (2, "é" * 100_000, "x", 5, "y", 6, 7)]
    got = sharding.write_shards(spark.createDataFrame(rows, schema), 3, bucket_bytes=64).collect()
    assert sorted(map(repr, (tuple(r.doc) for r in got))) == sorted(map(repr, rows))
    assert sorted(Counter(r.shard for r in got).values()) == [1, 1, 2]
    shards_of(got)
    assert sharding.write_shards(spark.createDataFrame([], schema), 3).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = sharding.shuffled_buckets(docs, 1, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
