"""Removal of repeated byte strings by samples chosen by content and digests.

A byte is removed if some string of ``length`` bytes that covers it also
starts elsewhere.  That is a question about the first ``length`` bytes of
suffixes: which of them equal the first bytes of another suffix, their
neighbour in sorted order.  As in a difference-cover suffix sort, only sampled
suffixes are named first and the remaining ones follow from them:

1. *Sample.*  The cover is chosen by content: of each window of ``length``
   bytes, the position of its smallest ``gram``-byte hash (the leftmost).
   Equal windows have their sample at the same shift, which is the property a
   difference cover modulo v provides; so every pair of equal windows is seen
   from a sampled position.  Samples whose gram is unique drop out.
2. *Names of sampled triples.*  Around a sample, the starts it stands for
   are taken in blocks; each block is named by a triple: the bytes before the
   core, the core that all its windows share, and the bytes after it.  A
   repeated triple settles the whole block, a unique core rules it out.
3. *Recursion.*  Blocks whose core repeats while the triple doesn't are named
   again one level down, each start by its own ``length`` bytes.
4. *Remaining suffixes.*  Starts inherit what their block's name settled.
5. *Adjacent prefixes.*  Equal names are brought together and two different
   places among them mean a repeat (a minimum and a maximum per name, which
   aggregate before the shuffle, instead of a sorted scan).

A sort of every byte's suffix would by estimate shuffle the input some forty times over;
this shuffles narrow rows of sampled positions, and texts only where something
in them repeats.  Names of step 1 and of cores only select; the names that
decide are 128-bit digests of the bytes.  Equal documents are represented once
and removed whole.  Rows of a very frequent name stay where they are.

Nulls and edge cases: a null text is empty; texts shorter than ``length``
never repeat; matches never cross documents; a long text is walked in
segments; rows that repeat a doc_id are documents of their own; an empty
table gives no rows; input columns named as a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from linden.llm.common import bounded_batches, fresh_path, remove_folder, written

GRAM = 128
BLOCK = 16
FREQUENT = 4096  # a name that more than one row in so many has is frequent
BITS = 1 << 25
WORDS = 16  # longs to a row of the broadcast bits
SEGMENT = 1 << 22
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LOW = np.uint64((1 << 23) - 1)  # SEGMENT plus a window fits into 23 bits


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS) < 2 or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, v, np.uint64)])) for v in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: list[np.ndarray] = []


def samples(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions of a text: gram names, positions, and the first and
    last start of the windows that each stands for."""
    found = [_samples(data[b:b + SEGMENT + length - 1], b, length, gram) for b in range(0, max(len(data) - length + 1, 0), SEGMENT)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _samples(data: bytes, begin: int, length: int, gram: int):
    raw = np.frombuffer(data, np.uint8)
    n, span = len(raw), length - gram + 1
    power, inverse = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n])])
    names = (sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1]
    names ^= names >> np.uint64(29)
    names *= np.uint64(0xBF58476D1CE4E5B9)
    names ^= names >> np.uint64(32)
    # smallest hash of each window, the leftmost on ties: hash above, place below
    keys = (names & ~LOW) | np.arange(len(names), dtype=np.uint64)
    windows = n - length + 1
    rows = -(-len(keys) // span)
    grid = np.concatenate([keys, np.full(rows * span - len(keys), np.uint64(2**64 - 1))]).reshape(rows, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:windows], left[span - 1:span - 1 + windows])
    change = np.flatnonzero(np.diff(least)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [windows]]) - 1
    at = (least[first] & LOW).astype(np.int64)
    return names[at].view(np.int64), at + begin, first + begin, last + begin


def digest_of(text: Column | str) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _short_name(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rows.append((hashlib.sha256(data).digest()[:16], len(data), *samples(data, length, gram)[:2]))
            digest, size, *lists = zip(*rows, strict=True) if rows else [()] * 4
            arrays = [pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), *arrays],
                                             ["doc_id", "digest", "n_bytes", "names", "at"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, digest binary, n_bytes long, names array<long>, at array<long>")


def _blocks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Triples of the blocks of starts around the candidate samples, those at
    one of the ``spots`` of a text."""
    import pyarrow as pa

    fields = ["digest", "first", "last", "core", "triple"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, spots in zip(*(batch.column(c) for c in ("digest", "text", "spots")), strict=True):
                data, digest, out = text.as_py().encode("utf-8", "surrogatepass"), digest.as_py(), []
                _, *places = samples(data, length, gram)
                wanted = np.isin(places[0], spots.values.to_numpy())
                for at, lo, hi in zip(*(x[wanted].tolist() for x in places), strict=True):
                    near, far = at - hi, at - lo
                    for j in range(near // BLOCK, far // BLOCK + 1):
                        place = at - j * BLOCK
                        first, last = at - min(far, j * BLOCK + BLOCK - 1), at - max(near, j * BLOCK)
                        core = data[place:place + length - BLOCK + 1]
                        out.append((digest, first, last, _short_name(b"%d %b" % (j, core)), _name(data[first:last + length])))
                if out:
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], fields)

    return texts.mapInArrow(run, "digest binary, first long, last long, core long, triple binary")


def _starts(texts: DataFrame, length: int) -> DataFrame:
    """(digest, first, name) of every start in ``ranges``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text, ranges in zip(*(batch.column(c) for c in ("digest", "text", "ranges")), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                starts = [s for r in ranges.as_py() for s in range(r["first"], r["last"] + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest.as_py()] * len(starts), pa.binary()), pa.array(starts, pa.int64()),
                     pa.array([_name(data[s:s + length]) for s in starts], pa.binary())], ["digest", "first", "name"])

    return texts.mapInArrow(run, "digest binary, first long, name binary")


def _place(at: str) -> Column:
    """A long for a place in a text: the places of one text have different ones."""
    return F.xxhash64("digest").bitwiseXOR(F.col(at))


def _repeated(rows: DataFrame, name: str, at: str) -> DataFrame:
    """(name, n): names that stand at two different places or more, and their number of rows."""
    return rows.groupBy(name).agg(F.min(_place(at)).alias("least"), F.max(_place(at)).alias("most"), F.count("*").alias("n")) \
        .where("least <> most").select(name, "n")


def _named(rows: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """``rows`` joined with the written table ``names`` (``name`` once each, n,
    ...).  Of the names those that have more than one row in ``FREQUENT``, no
    more than that many, are broadcast, so that no task gets all rows of one."""
    most = (names.agg(F.sum("n")).first()[0] or 0) // FREQUENT
    frequent = names.where(F.col("n") > most).drop("n")
    marked = rows.join(F.broadcast(frequent.withColumn("frequent", F.lit(True))), name, "left")
    added = [c for c in names.columns if c not in (name, "n")]
    rare = marked.where("frequent is null").drop("frequent", *added).join(names.where(F.col("n") <= most).drop("n"), name)
    return marked.where("frequent").drop("frequent").unionByName(rare)


def _among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: true where ``key`` is one of the longs in the
    one column of ``keys``, and seldom elsewhere.  One bit for each in an array
    of 4 MB, whatever the table, which meets the rows by a broadcast: neither
    their texts nor a second Python worker beside the task's own are needed."""
    low, bit = F.expr(f"(`{keys.columns[0]}` >> 6) & {WORDS - 1}"), F.expr(f"shiftleft(1L, cast(`{keys.columns[0]}` & 63 as int))")
    row = lambda key: F.shiftright(key.bitwiseAND(BITS - 1), 6 + WORDS.bit_length() - 1)
    bits = keys.groupBy(row(F.col(keys.columns[0])).alias("bits_row")) \
        .agg(F.array(*[F.coalesce(F.bit_or(F.when(low == k, bit)), F.lit(0)) for k in range(WORDS)]).alias("bits"))
    found = rows.withColumn("bits_key", key)
    found = found.join(F.broadcast(bits), row(F.col("bits_key")) == F.col("bits_row"), "left")
    word = F.expr(f"get(bits, cast((bits_key >> 6) & {WORDS - 1} as int))")
    maybe = F.expr("shiftright(bits_word, cast(bits_key & 63 as int)) & 1") == 1
    return found.withColumn("bits_word", word).withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("bits_key", "bits_row", "bits", "bits_word")


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = GRAM) -> DataFrame:
    """(digest, spans) of the distinct texts with something to remove; spans:
    ascending, disjoint (first, end) byte ranges."""
    spark = docs.sparkSession
    gram = min(gram, max(length // 2, 1))
    folder = fresh_path(spark, "repeats")
    base = written(_sampled(docs, length, gram), "sampled", folder)
    texts = base.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep_id"), F.first("n_bytes").alias("n_bytes"))
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)) \
        .select("digest", F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - length).alias("last"))

    samples_of = base.select("digest", F.explode(F.arrays_zip("names", "at")).alias("s")).select("digest", "s.*")
    names = written(_repeated(samples_of, "names", "at"), "names", folder)
    # a hash of the digest is enough to find the texts again: were two the same, one gave the other candidates
    spots = _named(samples_of.select(F.xxhash64("digest").alias("key"), "names", "at"), names, "names")
    spots = written(spots.groupBy("key").agg(F.collect_set("at").alias("spots")), "spots", folder)
    wanted = spots.join(texts.select("digest", "rep_id", F.xxhash64("digest").alias("key")), "key").select(F.col("digest").alias("wanted"), "rep_id", "spots")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest_of("text"))
    own = _among(own, F.xxhash64("digest"), spots.select("key")).where("maybe")
    own = own.join(wanted, (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    own = written(own.select("digest", "text", "spots"), "candidate-texts", folder)

    blocks = written(_blocks(own, length, gram), "blocks", folder)
    # equal triples have equal cores, so a core repeats if one of its triples does or if it has two of them
    triples = blocks.groupBy("core", "triple").agg(F.min(_place("first")).alias("place"), F.max(_place("first")).alias("most"), F.count("*").alias("n"))
    triples = written(triples.select("core", "triple", "place", (F.col("place") != F.col("most")).alias("same"), "n"), "triples", folder)
    open_cores = triples.groupBy("core").agg(F.count("*").alias("n"), F.bool_and("same").alias("settled")).where("n > 1 and not settled").select("core", "n")
    open_cores = written(open_cores, "cores", folder)
    again = _named(triples.select("core", "triple", "place"), open_cores, "core").select("triple", "place")
    names = triples.where("same").select("triple", F.lit(None).cast("long").alias("place"), "same", "n").union(
        again.select("triple", "place", F.lit(False), F.lit(0).cast("long")))
    names = names.groupBy("triple").agg(F.max("place").alias("place"), F.max("same").alias("same"), F.greatest(F.max("n"), F.lit(1)).alias("n"))
    named = _named(blocks.select("digest", "first", "last", "triple"), written(names, "named", folder), "triple")
    # of the settled triples one place each is enough for others to compare with
    named = written(named.select("digest", "first", "last", "same", F.coalesce(_place("first") == F.col("place"), F.lit(False)).alias("again"))
                    .where("same or again"), "named-blocks", folder)
    settled = named.where("same").select("digest", "first", "last")
    again = named.where("again").groupBy("digest").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    starts = written(_starts(own.join(again, "digest").select("digest", "text", "ranges"), length), "starts", folder)
    single = _named(starts, written(_repeated(starts, "name", "first"), "single", folder), "name") \
        .select("digest", "first", F.col("first").alias("last"))
    ranges = whole.union(settled).union(single).distinct().groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    spans = written(_merge(ranges, length), "spans")
    remove_folder(spark, folder)
    return spans


def _merge(ranges: DataFrame, length: int) -> DataFrame:
    """Covered byte ranges from sorted ranges of starts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for ranges in batch.column(1):
                spans: list[list[int]] = []
                for r in ranges.as_py():
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["last"] + length)
                    else:
                        spans.append([r["first"], r["last"] + length])
                out.append([{"first": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["digest", "spans"])

    return ranges.select("digest", "ranges").mapInArrow(run, "digest binary, spans array<struct<first: long, end: long>>")


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_bytes, ``spans`` (removed byte
    ranges) and ``kept``: the bytes that remain or, ``as_text``, their text
    without the characters that a span cuts through."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    added = ["n_bytes", "spans", "kept"]
    rest = [c for c in docs.columns if c not in added]
    spans = repeated_spans(docs, length, gram).withColumnRenamed("digest", "span_digest")
    rows = docs.select(F.struct(*rest).alias("row"), digest_of("text").alias("own_digest"))
    rows = _among(rows, F.xxhash64("own_digest"), spans.select(F.xxhash64("span_digest").alias("key")))
    cut = rows.where("maybe").join(spans, F.col("own_digest") == F.col("span_digest"), "left")
    rows = cut.select("row", "spans").unionByName(rows.where("not maybe").select("row"), allowMissingColumns=True)
    rows = rows.select(*[F.col("row").getField(c).alias(c) for c in rest], "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, cut, kept = [], [], []
            for text, spans in zip(batch.column(rest.index("text")), batch.column(len(rest)), strict=True):
                data, spans, at = (text.as_py() or "").encode("utf-8", "surrogatepass"), spans.as_py() or [], 0
                parts = []
                for s in spans:
                    parts.append(data[at:s["first"]])
                    at = s["end"]
                sizes.append(len(data))
                cut.append(spans)
                own = b"".join([*parts, data[at:]])
                kept.append(own.decode("utf-8", "ignore") if as_text else own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(cut, kind), pa.array(kept, pa.string() if as_text else pa.binary())],
                                             [*rest, *added])

    span = StructType([StructField("first", LongType()), StructField("end", LongType())])
    more = [StructField("n_bytes", LongType()), StructField("spans", ArrayType(span)), StructField("kept", StringType() if as_text else BinaryType())]
    return rows.mapInArrow(run, StructType([*[f for f in rows.schema if f.name != "spans"], *more]))
