"""Globally shuffled shards by a two-pass external shuffle, in DataFrame terms.

Pass one scatters: a seeded hash of its row number sends every row to one of
as many buckets as it takes for a bucket to hold about ``bucket_bytes``, one
partition to a bucket.  Pass two puts a bucket's rows into a row-number order
(what the network did to them is forgotten), shuffles them by Spark's seeded
Fisher-Yates ``shuffle`` and writes the bucket.  Buckets in a row are the
global order; it is cut into shards of equal row counts, one apart at most
(law ``rows``), so no property of a row decides where it lands.  A document
id, a source or one text (a group of equal texts) that holds a third of all
rows is spread over all buckets and shards like any other rows.

A task holds one bucket.  Offsets take one narrow row per bucket; texts cross
the network once and are written twice (buckets, shards).  Buckets should grow
with the executors' memory: 1 GB each makes 100,000 of 100 TB.

``docs`` should be read from a table, as row numbers must come out the same
when a lost task is run again.

Nulls and edge cases: a null text counts no bytes; nulls in any column, equal
rows and null ids stay as they are; a text longer than a bucket is a bucket's
largest row; an empty table gives no rows; a document stays whole in column
``doc``, so its columns clash with none of the shards'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.llm.common import fresh_path, written

LAW = "rows"
ROW_BYTES = 8


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text and a fixed amount for its row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def shuffled_buckets(docs: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """(bucket, place, doc): rows scattered over buckets and shuffled there."""
    total = docs.agg(F.coalesce(F.sum(size_of(F.col("text"))), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    rows = docs.select(F.struct("*").alias("doc")).withColumn("number", F.monotonically_increasing_id())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(buckets)).cast("int"))
    whole = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(F.struct("number", "doc")).alias("own"))
    order = F.shuffle(F.transform(F.sort_array("own"), lambda r: r.doc), seed)
    return whole.select("bucket", F.posexplode(order).alias("place", "doc"))


def write_shards(docs: DataFrame, shards: int, folder: str | None = None, seed: int = 11, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Write ``docs`` (text and any other columns) in a global random order to
    ``folder``, a sub-folder to each of ``shards`` shards, and return what was
    written: (doc, slot, shard), slots counting up from 0 in each shard."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "shards")
    rows = written(shuffled_buckets(docs, seed, bucket_bytes), "shuffled-buckets")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("filled"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = written(counts.select("bucket", F.coalesce(F.sum("filled").over(before), F.lit(0)).alias("start"),
                                   F.sum("filled").over(every).alias("total")), "bucket-starts")
    # the first ``extra`` shards hold one row more than the others
    at, small = F.col("start") + F.col("place"), F.floor(F.col("total") / shards)
    extra = F.col("total") % shards
    edge = extra * (small + 1)
    large = at < edge
    shard = F.when(large, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    slot = F.when(large, at % (small + 1)).otherwise((at - edge) % F.greatest(small, F.lit(1)))
    placed = rows.join(starts, "bucket").select("doc", slot.cast("long").alias("slot"), shard.cast("int").alias("shard"))
    placed.write.partitionBy("shard").parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder)
