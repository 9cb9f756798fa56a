"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles.  Two small collections of
``side`` band hashes each (``rows`` minhashes to a band) are computed once;
every pair of a band from the first and one from the second makes a table
key, so side * side tables cost only 2 * side * rows minhashes.  Two sets of
similarity s share a key with probability (1 - (1 - s^rows)^side)^2: 0.9996
at s = 0.8 with the defaults, 0.99998 at 0.85.

Documents with equal sets are one node.  Keys are resolved without pairing
all members of a bucket:

1. every member is compared with its bucket's centre (a star), the member
   that meets most others in all its buckets;
2. links found so far make components; only buckets that still have several
   go on, and only pairs across components;
3. the core of such a family is what more than half of its members have.  If
   two members share no shingle beside the core, they share no more than the
   smaller of what each has of it.  So the pairs left to compare are those for
   which that number is enough, and those that meet in a shingle outside the
   core.  A member must share at least what the core leaves open, so with the
   rarest shingles first all but its last ones are enough to meet a partner.
   No other pair can be a link, so none is missed; most of a family's pairs
   are never made.

Before full sets travel, sizes and a sketch of four bits per minhash rule out
pairs that merely share a passage (see ``most_differing``).  Links are decided
on the full sets.  Nothing is capped.

Nulls and edge cases: a text that is null or without words has an empty set
and links with nothing; fewer words than a shingle are one shingle; rows that
repeat a doc_id are documents of their own, and equal rows are copies; a null
doc_id never becomes a component_id unless all ids of a component are null;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.llm.common import written
from linden.llm.components import components

SEED = 0x5EED


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_WORDS = WordHashes()
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(f"word {k}".encode(), digest_size=8).digest(), "big") | 1 for k in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E6C63D0676A9A99)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and white space x20 x09-x0D
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own))
    n = min(words, len(own))
    total = np.full(len(own) - n + 1, np.uint64(n * 0x9E3779B97F4A7C15 & 2**64 - 1))
    for k in range(n):
        total = mix(total + h[k:len(own) - n + 1 + k] * _FACTORS[k])
    return np.unique(total)


def minhashes(own: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of the set under multiplicative hashes."""
    least = np.full(count, np.uint64(2**64 - 1))
    for k in range(0, len(own), 2048):
        least = np.minimum(least, (own[None, k:k + 2048] * _multipliers(count)).min(axis=1))
    return least


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """Band hashes of ``rows`` minhashes each, as signed longs."""
    least = least.reshape(-1, rows)
    total = np.arange(len(least), dtype=np.uint64)
    for k in range(rows):
        total = mix(total + least[:, k] * _FACTORS[32 + k])
    return total.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each minhash, sixteen to a signed long."""
    bits = mix(least) >> np.uint64(60)
    bits = np.concatenate([bits, np.zeros(-len(bits) % 16, np.uint64)]).reshape(-1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


_MULTIPLIERS: dict[int, np.ndarray] = {}


def _multipliers(n: int) -> np.ndarray:
    if n not in _MULTIPLIERS:
        _MULTIPLIERS[n] = np.random.default_rng(SEED).integers(0, 1 << 63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    return _MULTIPLIERS[n]


def differing(a: Column, b: Column, longs: int) -> Column:
    """Number of minhashes whose bits differ in two sketches."""
    total = F.lit(0)
    for k in range(longs):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def signatures(docs: DataFrame, words: int, side: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, first, second, sketch): size and digest of
    each document's set, its two collections of band hashes, its sketch."""
    import pyarrow as pa

    count = 2 * side * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, one, two, small = [], [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), words)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                least = minhashes(own, count)
                both = bands(least, rows).tolist()
                one.append(both[:side])
                two.append(both[side:])
                small.append(sketch(least).tolist())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(one, longs), pa.array(two, longs), pa.array(small, longs)],
                ["doc_id", "n_shingles", "set_id", "first", "second", "sketch"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, n_shingles long, set_id binary, first array<long>, second array<long>, sketch array<long>")


def sets_of(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(node, own): the shingle sets of ``needed`` (node, doc_id, set_id)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for node, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(text, words).tobytes()
                if hashlib.blake2b(own, digest_size=16).digest() == digest:
                    nodes.append(node)
                    found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], ["node", "own"])

    ids = needed.select(F.col("doc_id").alias("needed_id"), "node", "set_id")
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("needed_id"))) \
        .select("node", "set_id", "text")
    return rows.mapInArrow(run, "node long, own binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def elements(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(centre, node, shingle): the shingles of each (centre, node)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("own")]
            edges = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("centre"), batch.column("node"), pa.ListArray.from_arrays(edges, flat)],
                                             ["centre", "node", "shingles"])

    rows = members.join(sets, "node").select("centre", "node", "own")
    return rows.mapInArrow(run, "centre long, node long, shingles array<long>").select("centre", "node", F.explode("shingles").alias("shingle"))


def most_differing(count: int, percent: int) -> int:
    """Differing minhashes beyond which a pair is not compared: 6.5 standard
    deviations above what a pair just at the threshold has, a chance of some
    1e-10, far below that of sharing no table."""
    s = percent / 100 + (1 - percent / 100) / 16
    return min(count, int(np.ceil(count * (1 - s) + 6.5 * np.sqrt(count * s * (1 - s)))))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, side: int = 12, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``
    (doc_id, text); documents are linked at a Jaccard similarity of
    ``percent`` hundredths or more."""
    base = written(signatures(docs, words, side, rows), "signatures")
    nodes = base.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("first").alias("first"), F.first("second").alias("second"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")  # numbered once, when written

    table = F.posexplode(F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.xxhash64(a, b)))))
    members = nodes.select("node", table.alias("table", "pair")).select("node", F.xxhash64("table", "pair").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("filled")).where("filled > 1")
    shared = written(members.join(buckets, "key"), "buckets")
    # nodes that meet many others come first as centres: the original of a family of copies does
    weights = shared.groupBy("node").agg(F.sum("filled").alias("weight"))
    weights = written(weights.join(nodes, "node").select("node", "doc_id", "set_id", F.struct("weight", "node", "n_shingles", "sketch").alias("own")), "weights")
    shared = written(shared.select("key", "node").join(weights, "node").select("key", "own"), "buckets")

    sets = written(sets_of(docs, weights.select("node", "doc_id", "set_id"), words), "shingle-sets")

    most = most_differing(2 * side * rows, percent)

    def pairs(rows_of: DataFrame, left: str, right: str) -> DataFrame:
        a, b = F.col(left), F.col(right)
        alike = (a.n_shingles * 100 >= b.n_shingles * percent) & (b.n_shingles * 100 >= a.n_shingles * percent)
        alike &= differing(a.sketch, b.sketch, -(-2 * side * rows // 16)) <= most
        return rows_of.where(alike & (a.node != b.node)).select(
            F.greatest(f"{left}.node", f"{right}.node").alias("a"), F.least(f"{left}.node", f"{right}.node").alias("b")).distinct()

    centres = shared.groupBy("key").agg(F.max("own").alias("centre"))
    starred = shared.join(centres, "key")
    links = written(verified(pairs(starred, "own", "centre"), sets, percent), "links")

    # buckets whose members are not one component yet
    roots = written(components(links), "roots")
    placed = starred.join(roots, F.col("own.node") == F.col("node"), "left") \
        .select("key", "own", F.col("centre.node").alias("centre"), F.coalesce("root", "own.node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    placed = written(placed.join(mixed, "key"), "mixed-buckets")
    # what most members of a family have is its core; beside it few share anything
    family = placed.select("centre", F.col("own.node").alias("node"), "own", "root").distinct()
    shingle = written(elements(family.select("centre", "node"), sets), "family-shingles")
    sizes = family.groupBy("centre").agg(F.count("*").alias("members"))
    counts = shingle.groupBy("centre", "shingle").agg(F.count("*").alias("having")).where("having > 1").join(sizes, "centre") \
        .select("centre", "shingle", "having", (F.col("having") * 2 > F.col("members")).alias("core"))
    shingle = written(shingle.join(counts, ["centre", "shingle"]), "shared-shingles")
    shared = shingle.where("core").groupBy("centre", "node").agg(F.count("*").alias("shared"))
    family = written(family.join(shared, ["centre", "node"], "left").fillna(0, ["shared"]), "families")
    x = family.select("centre", F.col("node").alias("x_node"), F.col("own").alias("x"), F.col("root").alias("x_root"), F.col("shared").alias("x_shared"))
    y = family.select("centre", F.col("node").alias("y_node"), F.col("own").alias("y"), F.col("root").alias("y_root"), F.col("shared").alias("y_shared"))
    # without a common shingle beside the core, two members share no more than each has of it
    bound = F.least("x_shared", "y_shared")
    fit = x.join(y, "centre").where("x_node > y_node and x_root <> y_root").where(
        bound * 100 >= (F.col("x.n_shingles") + F.col("y.n_shingles") - bound) * percent)
    # of the shingles beside the core a partner must share what the core leaves open; with the rarest ones first,
    # two such sets meet within all but that many (less one) of their shingles
    most_open = F.floor((F.col("own.n_shingles") * percent + 99) / 100) - F.col("shared")
    rare = shingle.where("not core").join(family.select("centre", "node", "root", F.greatest(most_open, F.lit(1)).alias("needed")), ["centre", "node"])
    own = Window.partitionBy("centre", "node")
    rare = rare.withColumns({"nth": F.row_number().over(own.orderBy("having", "shingle")), "of": F.count("*").over(own)}) \
        .where("nth <= of - needed + 1").select("centre", "shingle", "node", "root")
    rare = written(rare, "rare-shingles")
    mixed = rare.groupBy("centre", "shingle") \
        .agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("centre", "shingle")
    rare = written(rare.drop("root").join(mixed, ["centre", "shingle"]), "mixed-shingles")
    meet = rare.withColumnRenamed("node", "x_node").join(x, ["centre", "x_node"]).join(
        rare.withColumnRenamed("node", "y_node").join(y, ["centre", "y_node"]), ["centre", "shingle"]).where("x_node > y_node and x_root <> y_root")
    found = pairs(fit, "x", "y").union(pairs(meet, "x", "y")).distinct()
    links = links.union(verified(found, sets, percent))
    roots = written(components(links), "roots")

    placed = nodes.select("set_id", "node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = placed.select("set_id", "root").join(least, "root").select("set_id", "component_id")
    empty = base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = base.where("n_shingles > 0").select("doc_id", "n_shingles", "set_id").join(found, "set_id")
    return full.select("doc_id", "n_shingles", "component_id").union(empty) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
