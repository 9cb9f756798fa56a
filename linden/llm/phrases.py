"""Phrase collocations by the stripes pattern.

Words are runs without blanks or tabs of lower-cased (A-Z) text, cut at the
punctuation of ``BREAKS``; phrases lie inside such pieces.  The *stripe* of a
word counts the words that follow it, and for each of those the words that
follow both (the end of a piece counts as a word).  It holds everything that
is asked of a corpus:

* its inner entries count the three-word phrases,
* an inner counter's sum counts the two-word phrase, the whole sum the word,
* an inner counter's largest entry tells whether a longer phrase subsumes the
  two-word phrase.

Tasks gather the stripes of about ``TOKENS`` words at a time with array sorts,
so a common word leaves a task as one row, whatever follows it there.  A row
packs its counters into four byte strings (words end in a newline; numbers
take a byte, larger ones are split).  Rows are dealt by word, sorted, and
merged element by element in a pass that holds one stripe.  The stripes of
words that hold a large share of the corpus are cut by the hash of the second
word into as many slices as there are shuffle partitions, and dealt apart.
Which words those are is read off a sample; like that of a range partitioner
it decides where rows go and no result.

Nulls and edge cases: a null text is empty, a null lang is ``und``; texts are
taken whole, however long (they are read in slices, phrases across the cuts
included); repeated rows count as often as they occur; ties are ranked by
phrase; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.llm.common import written

BREAKS = b".,;:!?\n\x0b\x0c\r"
TOKENS = 2_000_000
WORDS = 1 << 20  # a state's vocabulary stays below 2^21, three codes to a long
PIECE = 1 << 20
ROWS = 50_000
ENTRIES = 500_000
MOST = 255  # of a byte
SAMPLE = 64  # one text in so many, for the words whose stripes are sliced
HEAVY = 4096
END = ""  # as second or third word: the piece ends
STRIPE = "lang string, first string, slice int, seconds binary, spans binary, thirds binary, counts binary"
MERGED = "lang string, first string, second string, total long, nexts array<string>, counts array<long>"

_TABLE = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Codes(dict):
    """Numbers words in the order they are met; 0 is no word, 1 a piece's end."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def cut(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` in slices of about ``size`` bytes that end at a blank."""
    begin = 0
    while begin < len(data):
        end = len(data) if begin + size >= len(data) else data.find(b" ", begin + size)
        end = len(data) if end < 0 else end
        yield data[begin:end]
        begin = end


class Gatherer:
    """Words of one language since the last flush."""

    def __init__(self):
        self.codes, self.parts, self.size = Codes(), [], 0

    def add(self, data: bytes) -> None:
        words = data.replace(b"\n", b" \n ").split(b" ")
        own = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        own = own[own != 0]
        self.parts.append(own)
        self.size += len(own)

    def stripes(self, last: bool):
        """(words, first, second, next, count) of the phrases gathered, in
        order; forgets them but for two words that may go on."""
        words = list(self.codes)
        row = np.concatenate([*self.parts, np.ones(2 if last else 0, np.int64)])
        base = len(words)
        a, b, c = row[:-2], row[1:-1], row[2:]
        starts = a != 1
        a, b = a[starts], b[starts]
        c = np.where(b == 1, 1, c[starts])
        keys, counts = np.unique((a * base + b) * base + c, return_counts=True)
        tail = [words[k] for k in row[-2:]]
        self.__init__()
        self.parts.append(np.array([self.codes[w] for w in tail], np.int64))
        return words, keys // base // base, keys // base % base, keys % base, counts


def split_large(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and parts of ``MOST`` at most that add up to the values."""
    times = -(-values // MOST)
    at = np.repeat(np.arange(len(values)), times)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return at, np.minimum(MOST, values[at] - nth * MOST)


def packed(data, edges: np.ndarray):
    """Byte strings ``data[edges[i]:edges[i + 1]]`` as an Arrow column."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def rows_of(lang: str, gathered, heavy: frozenset, slices: int) -> Iterator:
    """Arrow batches of ``STRIPE`` rows."""
    import pyarrow as pa

    words, first, second, third, counts = gathered
    if not len(first):
        return
    lines = pa.array([(w if k > 1 else b"") + b"\n" for k, w in enumerate(words)], pa.binary())
    part = np.zeros(len(first), np.int32)
    wide = np.fromiter((w in heavy for w in words), bool, len(words))[first]
    if wide.any():
        hashed = np.zeros(len(words), np.int32)
        used = np.unique(second[wide])
        hashed[used] = [zlib.crc32(words[k]) % slices + 1 for k in used]
        part[wide] = hashed[second[wide]]
        order = np.lexsort((part, first))  # stable: second words stay in order
        first, second, third, counts, part = (x[order] for x in (first, second, third, counts, part))
    at, counts = split_large(counts)
    first, second, third, part = first[at], second[at], third[at], part[at]
    row = np.diff(first * (slices + 1) + part, prepend=-1) != 0
    run = row | (np.diff(second, prepend=-1) != 0)
    runs = np.flatnonzero(run)
    own, spans = split_large(np.diff(np.append(runs, len(run))))
    begin = np.append(np.flatnonzero(row), len(row))
    for k in range(0, len(begin) - 1, ROWS):
        edges = begin[k:k + ROWS + 1]
        entries = slice(edges[0], edges[-1])
        lo, hi = np.searchsorted(runs[own], [edges[0], edges[-1]])
        heads = lines.take(pa.array(second[runs[own[lo:hi]]]))
        tails = lines.take(pa.array(third[entries]))
        run_edges = np.searchsorted(runs[own[lo:hi]], edges)
        offsets = lambda a: np.frombuffer(a.buffers()[1], np.int32, len(a) + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(edges) - 1), pa.string()), pa.array([words[x].decode("utf-8", "surrogateescape") for x in first[edges[:-1]]], pa.string()),
             pa.array(part[edges[:-1]]),
             packed(heads.buffers()[2], offsets(heads)[run_edges]), packed(spans[lo:hi].astype(np.uint8), run_edges),
             packed(tails.buffers()[2], offsets(tails)[edges - edges[0]]), packed(counts[entries].astype(np.uint8), edges - edges[0])],
            ["lang", "first", "slice", "seconds", "spans", "thirds", "counts"])


def stripes(docs: DataFrame, heavy: frozenset, slices: int) -> DataFrame:
    """``STRIPE`` rows of ``docs`` (lang, text), several to a word."""

    def run(batches: Iterator) -> Iterator:
        own: dict[str, Gatherer] = {}

        def flush(last: bool) -> Iterator:
            for lang, g in own.items():
                if g.size:
                    yield from rows_of(lang, g.stripes(last), heavy, slices)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogateescape").translate(_TABLE)
                g = own.setdefault(lang, Gatherer())
                for piece in cut(data):
                    g.add(piece)
                    if sum(x.size for x in own.values()) > TOKENS or len(g.codes) > WORDS:
                        yield from flush(False)
                g.parts.append(np.ones(1, np.int64))  # the text ends
        yield from flush(True)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, STRIPE)


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow column of byte strings, and the strings' edges."""
    edges = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[edges[0]:edges[-1]], edges - edges[0]


def words_in(column) -> tuple:
    """The newline-ended words of byte strings: their codes, the distinct
    words, and how many each string holds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data, edges = bytes_of(column)
    ends = np.append(0, np.flatnonzero(data == 10) + 1)
    coded = pc.dictionary_encode(packed(np.ascontiguousarray(data), ends))
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, np.diff(np.searchsorted(ends, edges))


class Merger:
    """Adds up sorted ``STRIPE`` rows; yields ``MERGED`` rows: pairs that occur
    ``least`` times with the triples that do, and (second null) word totals."""

    def __init__(self, least: int):
        self.least, self.held, self.size, self.wanted = least, [], 0, ENTRIES

    def add(self, batch) -> Iterator:
        self.held.append(batch)
        self.size += batch.num_rows + len(bytes_of(batch.column(6))[0])
        if self.size > self.wanted:
            yield from self.emit(False)

    def emit(self, last: bool) -> Iterator:
        """Everything but the last stripe, which may go on."""
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(self.held).combine_chunks()
        col = [c.chunk(0) for c in table.columns]
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for c in col[:3]:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        n = len(heads) if last else len(heads) - 1
        code2, seconds, n2 = words_in(col[3])
        code3, thirds, n3 = words_in(col[5])
        own = np.repeat(np.arange(len(code2)), bytes_of(col[4])[0])  # the run of each entry
        pair = np.repeat(group, n2) * len(seconds) + code2
        keys = pair[own] * len(thirds) + code3
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], self.counts(col, n3)[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, sums = keys[starts], np.add.reduceat(values, starts)
        pair, third = keys // len(thirds), keys % len(thirds)
        owner = pair // len(seconds)
        done = owner < n
        lang, first = (col[k].take(pa.array(heads[:n])) for k in (0, 1))
        if n:
            yield from self.out(lang, first, pair[done], third[done], sums[done], seconds, thirds)
        self.held, self.size, self.wanted = [], 0, ENTRIES
        if not last:  # the stripe that may go on, merged, its sums as a column of their own
            rest = ~done
            runs = np.flatnonzero(np.diff(pair[rest], prepend=-1))
            at, spans = split_large(np.diff(np.append(runs, rest.sum())))
            heads2 = seconds.take(pa.array(pair[rest][runs][at] % len(seconds)))
            tails = thirds.take(pa.array(third[rest]))
            one = lambda a: packed(a.buffers()[2], np.array([0, np.frombuffer(a.buffers()[1], np.int32)[len(a)]]))
            blank = np.zeros(len(tails), np.uint8)
            self.held = [pa.RecordBatch.from_arrays(
                [*[c.slice(int(heads[-1]), 1) for c in col[:3]], one(heads2), packed(spans.astype(np.uint8), np.array([0, len(spans)])),
                 one(tails), packed(blank, np.array([0, len(blank)]))], table.column_names)]
            self.carried = sums[rest]
            self.wanted = max(ENTRIES, 2 * len(tails))

    carried = np.zeros(0, np.int64)

    def counts(self, col, n3: np.ndarray) -> np.ndarray:
        values = bytes_of(col[6])[0].astype(np.int64)
        if len(self.carried):  # the first row is what was carried over
            values[:len(self.carried)] = self.carried
            self.carried = np.zeros(0, np.int64)
        return values

    def out(self, lang, first, pair, third, sums, seconds, thirds) -> Iterator:
        import pyarrow as pa

        runs = np.flatnonzero(np.diff(pair, prepend=-1))
        totals = np.add.reduceat(sums, runs)
        owner, code = pair[runs] // len(seconds), pair[runs] % len(seconds)
        text = lambda words, at: [w[:-1].decode("utf-8", "surrogateescape") for w in words.take(pa.array(at)).to_pylist()]
        second = seconds.index(b"\n").as_py()
        pick = (totals >= self.least) & (code != second)
        lengths = np.diff(np.append(runs, len(pair)))
        keep = np.repeat(pick, lengths) & (sums >= self.least) & (third != thirds.index(b"\n").as_py())
        inner = np.add.reduceat(keep.astype(np.int64), runs)[pick]
        offsets = pa.array(np.append(0, np.cumsum(inner)), pa.int32())
        chosen = pa.array(owner[pick])
        yield pa.RecordBatch.from_arrays(
            [lang.take(chosen), first.take(chosen), pa.array(text(seconds, code[pick]), pa.string()), pa.array(totals[pick]),
             pa.ListArray.from_arrays(offsets, pa.array(text(thirds, third[keep]), pa.string())), pa.ListArray.from_arrays(offsets, pa.array(sums[keep]))],
            ["lang", "first", "second", "total", "nexts", "counts"])
        k = len(lang)
        whole = np.bincount(owner, totals, k).astype(np.int64) if totals.sum() < 1 << 52 else np.array(
            [totals[owner == i].sum() for i in range(k)], np.int64)
        none = pa.array(np.zeros(k + 1), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [lang, first, pa.nulls(k, pa.string()), pa.array(whole), pa.ListArray.from_arrays(none, pa.array([], pa.string())),
             pa.ListArray.from_arrays(none, pa.array([], pa.int64()))], ["lang", "first", "second", "total", "nexts", "counts"])


def merge(batches: Iterator, least: int) -> Iterator:
    merger = Merger(least)
    for batch in batches:
        if batch.num_rows:
            yield from merger.add(batch)
    if merger.held:
        yield from merger.emit(True)


def heavy_words(docs: DataFrame, slices: int) -> frozenset:
    """At most ``HEAVY`` words that hold a large share of a sample."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.translate("text", letters, letters.lower()).alias("text"))
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t.,;:!?\n\x0B\f\r]+"), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    most = counts.orderBy(F.desc("n"), "w").limit(HEAVY).collect()
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1) if most else 1
    return frozenset(r.w.encode() for r in most if r.n * 2 * slices >= total)


def counts_of(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, first, f) of all words; (lang, first, second, f, extended) of
    pairs and (lang, first, second, third, f) of triples that occur ``least``
    times; ``extended`` is the largest count of a triple that goes on a pair."""
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["lang", "first", "slice"]
    rows = stripes(docs, heavy_words(docs, slices), slices).repartition(*key).sortWithinPartitions(*key)
    merged = written(rows.mapInArrow(lambda batches: merge(batches, least), MERGED), "stripes")
    words = merged.where("second is null").groupBy("lang", "first").agg(F.sum("total").alias("f"))
    pairs = merged.where("second is not null").select("lang", "first", "second", F.col("total").alias("f"), F.array_max("counts").alias("extended"))
    triples = merged.where("second is not null").select("lang", "first", "second", F.explode(F.arrays_zip("nexts", "counts")).alias("e")) \
        .select("lang", "first", "second", F.col("e.nexts").alias("third"), F.col("e.counts").alias("f"))
    return words, pairs, triples


def collocations(docs: DataFrame, least: int = 10, subsumed: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by their weakest cut: (lang, rank,
    phrase, a, l, r, n, score).  A phrase goes if a longer one that holds it
    occurs ``subsumed`` hundredths as often or more."""
    words, pairs, triples = (written(x, name) for x, name in zip(counts_of(docs, least), ("words", "pairs", "triples"), strict=True))

    def f(table: DataFrame, names: list[str], out: str) -> DataFrame:
        renamed = table.select("lang", *[F.col(old).alias(new) for old, new in zip(table.columns[1:1 + len(names)], names, strict=True)],
                               F.col("f").alias(out))
        return renamed

    def score(left: str, right: str) -> Column:
        whole = "cast(a as decimal(19, 0))"
        return F.expr(f"(cast(1000000 as decimal(7, 0)) * {whole} * {whole}) div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0)))")

    two = pairs.withColumnRenamed("f", "a").join(f(words, ["first"], "l"), ["lang", "first"]).join(f(words, ["second"], "r"), ["lang", "second"])
    before = triples.groupBy("lang", F.col("second").alias("first"), F.col("third").alias("second")).agg(F.max("f").alias("preceded"))
    longer = F.greatest("extended", "preceded")  # of those that are not null
    two = two.join(before, ["lang", "first", "second"], "left").where(longer.isNull() | (100 * longer < subsumed * F.col("a")))
    two = two.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", score("l", "r").alias("score"))
    three = triples.withColumnRenamed("f", "a").join(f(pairs, ["first", "second"], "l2"), ["lang", "first", "second"]) \
        .join(f(pairs, ["second", "third"], "r1"), ["lang", "second", "third"]) \
        .join(f(words, ["first"], "l1"), ["lang", "first"]).join(f(words, ["third"], "r2"), ["lang", "third"])
    three = three.withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    one = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", F.when(one, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(one, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.union(three).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
