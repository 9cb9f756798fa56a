"""Document fingerprints by Order MinHash, as column expressions.

A text is a row of tokens (runs of non-blank characters, long runs cut every
``TOKEN`` characters, so text without blanks has tokens too).  Its k-mers,
``K`` tokens each, are numbered by occurrence; a hash of k-mer and number
puts them into ``BINS`` bins and orders them there.  Of each bin the ``PICK``
smallest are selected, put back into text order, and hashed as a tuple.  The
fingerprint lists one tuple hash per bin, eight hexadecimal digits or dots
for an empty bin.  Two texts share a tuple only if they agree on the selected
k-mers and on their order, so likeness falls with edits that Jaccard
similarity of plain sets does not see.

Occurrences are numbered without comparing pairs: k-mer hashes and positions
are packed into longs and sorted; the sorted row is written as a string with
a 1 where a new k-mer begins and cut there, and each piece counts up.  The
work of a text grows with its length times its logarithm, within one row, and
no row of tokens is ever shuffled.

Nulls and edge cases: a null text is an empty one; empty and blank texts have
an empty fingerprint (all dots), and two of those are alike (1.0); fewer
tokens than a k-mer are one k-mer; texts of any length are taken whole; a null
doc_id comes after all others, and rows that repeat a doc_id stay rows of
their own, ordered by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.llm.common import written

TOKEN = 16
K = 3
BINS = 64
PICK = 2
PLACES = 30  # low bits of a packed long hold the position
DIGITS = 8
EMPTY = "." * DIGITS


def _pack(h: Column, i: Column) -> Column:
    """The hash's upper bits above, the position below."""
    return F.shiftleft(F.shiftright(h, PLACES), PLACES).bitwiseOR(i.cast("long"))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACES) - 1))


def _bin(packed: Column) -> Column:
    """Bin of a packed long; bins rise with the (signed) longs."""
    return F.shiftright(packed, 65 - BINS.bit_length()) + BINS // 2


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the fingerprint of column ``text`` in column ``out``.
    Scratch columns carry a prefix of ``out`` and are dropped."""
    col = {n: f"__{out}_{n}" for n in ("tokens", "kmers", "sorted", "runs", "numbers", "order", "picked", "tuples")}
    tokens, kmers, packed, runs, numbers, order, picked, tuples = (F.col(c) for c in col.values())

    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"\S{{1,{TOKEN}}}"), F.lit(0))
    rows = rows.withColumn(col["tokens"], F.transform(words, lambda t: F.xxhash64(t)))
    parts = [lambda h, i: h, *[lambda h, i, k=k: F.get(tokens, i + k) for k in range(1, K)]]
    # a short text is one k-mer; the last K - 1 starts of a longer one are none
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - K + 1, F.least(F.size(tokens), F.lit(1))))
    rows = rows.withColumn(col["kmers"], F.transform(starts, lambda h, i: F.xxhash64(*[p(h, i) for p in parts])))
    rows = rows.withColumn(col["sorted"], F.sort_array(F.transform(kmers, _pack)))
    # "1" where a sorted k-mer differs from the one before, else "0"
    flags = F.array_join(F.transform(packed, lambda p, i: F.when(
        F.get(kmers, _place(p).cast("int")) == F.get(kmers, _place(F.get(packed, i - 1)).cast("int")), "0").otherwise("1")), "")
    rows = rows.withColumn(col["runs"], F.split(flags, "(?<=.)(?=1)"))
    rows = rows.withColumn(col["numbers"], F.flatten(F.transform(runs, lambda r: F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))))))
    # the order of numbered k-mers: bin in the uppermost bits
    # (a column named once inside a lambda would be computed anew for each element)
    numbered = F.zip_with(packed, numbers, lambda p, n: _pack(F.xxhash64(F.get(kmers, _place(p).cast("int")), n), _place(p)))
    rows = rows.withColumn(col["order"], F.sort_array(numbered))
    least = F.filter(order, lambda p, i: F.coalesce(_bin(F.get(order, i - PICK)) != _bin(p), F.lit(True)))
    rows = rows.withColumn(col["picked"], least)

    def tuple_of(p: Column, i: Column) -> Column:
        own = F.filter(F.slice(picked, i + 1, PICK), lambda q: _bin(q) == _bin(p))
        places = F.array_sort(F.transform(own, lambda q: F.struct(_place(q).alias("place"), F.shiftright(q, PLACES).alias("hash"))))
        value = F.xxhash64(F.transform(places, lambda s: s.hash))
        first = F.coalesce(_bin(F.get(picked, i - 1)) != _bin(p), F.lit(True))
        return F.when(first, F.struct(_bin(p).cast("int").alias("bin"), F.lower(F.right(F.hex(value), F.lit(DIGITS))).alias("digits")))

    rows = rows.withColumn(col["tuples"], F.filter(F.transform(picked, tuple_of), lambda t: t.isNotNull()))
    filled = F.transform(tuples, lambda t, i: F.concat(
        F.repeat(F.lit(EMPTY), t.bin - F.coalesce(F.get(tuples, i - 1).bin, F.lit(-1)) - 1), F.lpad(t.digits, DIGITS, "0")))
    return rows.withColumn(out, F.rpad(F.array_join(filled, ""), BINS * DIGITS, ".")).drop(*col.values())


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either fingerprint fills;
    two empty fingerprints are alike."""
    cut = lambda f: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(f, i * DIGITS + 1, F.lit(DIGITS)))
    both = F.zip_with(cut(a), cut(b), lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise((x == y).cast("int")))
    counts = F.aggregate(both, F.struct(F.lit(0).alias("same"), F.lit(0).alias("filled")), lambda s, v: F.struct(
        (s.same + F.coalesce(v, F.lit(0))).alias("same"), (s.filled + v.isNotNull().cast("int")).alias("filled")))
    return F.when(F.length(F.replace(F.concat(a, b), F.lit("."))) == 0, F.lit(1.0)).otherwise(
        F.transform(F.array(counts), lambda s: F.try_divide(s.same, s.filled))[0])


#: Documents of neighbouring ids that a window holds at a time.
BLOCK = 32
WIDE = 1024


def followers(blocks: DataFrame) -> DataFrame:
    """(from_block, to_block): of each number in ``blocks`` (distinct longs) the
    next lower one, of the lowest the highest.  Numbers look within ``WIDE``
    neighbours; the lowest of such a group takes the highest of the next group,
    which is the same question for the groups' own numbers.  One task orders no
    more than ``WIDE`` rows, however the numbers are spread."""
    groups = blocks.withColumn("wide", F.floor(F.col("block") / WIDE))
    tops = written(groups.groupBy("wide").agg(F.max("block").alias("top")), "block-groups")
    if tops.count() <= WIDE:
        order = Window.orderBy(F.desc("wide"))
        every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        upper = tops.select(F.col("wide").alias("from_block"), F.coalesce(F.lead("wide").over(order), F.first("wide").over(every)).alias("to_block"))
    else:
        upper = followers(tops.select(F.col("wide").alias("block")))
    upper = upper.join(tops, F.col("to_block") == F.col("wide")).select(F.col("from_block").alias("own_wide"), F.col("top").alias("next_top"))
    inner = Window.partitionBy("wide").orderBy(F.desc("block"))
    return groups.withColumn("after", F.lead("block").over(inner)).join(upper, F.col("wide") == F.col("own_wide")) \
        .select(F.col("block").alias("from_block"), F.coalesce("after", "next_top").alias("to_block"))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, text_hash, next_id, next_hash, next_text): each
    document with the one that follows in descending doc_id order (then by
    descending text, null ids last), the first after the last.  text_hash
    tells rows that repeat a doc_id apart, next_hash is the following row's;
    next_text holds no more than the edit takes.  Windows span blocks of
    neighbouring ids; only the last document of a block looks further, through
    the blocks' numbers (``followers``), so no task orders the table."""
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-(1 << 62)))  # null ids: the last block
    rows = rows.withColumn("block", block)
    own = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    heads = rows.withColumn("leads", F.row_number().over(own)).where("leads = 1") \
        .select(F.col("block").alias("head_block"), F.col("doc_id").alias("head_id"), F.col("text").alias("head_text"), F.col("text_hash").alias("head_hash"))
    ids = followers(docs.select(block.alias("block")).distinct())
    heads = heads.join(ids, F.col("to_block") == F.col("head_block")).select("from_block", "head_id", "head_text", "head_hash")
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "own_next": F.lead("doc_id").over(own), "follows": F.lead(F.lit(True)).over(own),
                             "own_text": F.lead("text").over(own), "own_hash": F.lead("text_hash").over(own)})
    rows = rows.join(heads, (F.col("block") == F.col("from_block")) & F.col("follows").isNull(), "left")
    return rows.select("doc_id", "n_chars", "text", "text_hash",
                       F.when(F.col("follows"), F.col("own_next")).otherwise(F.col("head_id")).alias("next_id"),
                       F.when(F.col("follows"), F.col("own_hash")).otherwise(F.col("head_hash")).alias("next_hash"),
                       F.substring(F.when(F.col("follows"), F.col("own_text")).otherwise(F.col("head_text")), F.lit(1), half).alias("next_text"))


def edited(rows: DataFrame) -> DataFrame:
    """Rows with ``edited_text``: the last half of the code points replaced by
    the first as many (or all) of the next document."""
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    return rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), keep), "next_text"))
