"""Token, bigram and trigram statistics over a corpus.

The statistics stream is the document's tokens of kind STRING/OP/NAME and at
most 30 characters; skipped tokens do not advance the window, and there is no
marker at line breaks.  ``''`` stands for "before the first token".

The operators take lines (doc_id, line, text) or whole documents (doc_id,
text).  Plan shape over documents: the stream is an array of the document and
its n-grams are shifted slices of it, so nothing is shuffled before the counts;
documents with a repeated id or a very long text go line by line.  Over lines,
tokens stay in per-line arrays (no token-level shuffle); the two
tokens carried into a line from earlier lines come from a two-row window
inside blocks of lines plus a per-block summary, so no task holds a whole
document.  The counts of one kind are one aggregation (partial aggregation
happens before the shuffle); where all three are wanted, bigram and unigram
counts roll up from the written trigram table, because every token
occurrence yields exactly one trigram, one bigram and one unigram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions.similarity import bound
from linden.operators.sequence import shift_lines
from linden.sources.views import line_tokens, lines, whole_documents


def _keep_for_stats(t: Column) -> Column:
    # STRING, OP or NAME (not COMMENT / NUMBER), at most 30 characters.
    return (~t.startswith("#")) & (~t.rlike(r"^\p{N}")) & (F.length(t) <= lx.STAT_MAX_LEN)


def stat_token_arrays(lines_df: DataFrame) -> DataFrame:
    """(doc_id, line, ft ARRAY<STRUCT<pos INT, t STRING>>) -- statistic tokens
    of each line with their position among all tokens of the line."""
    toks = line_tokens(F.col("text"))
    indexed = F.transform(toks, lambda x, i: F.struct(i.alias("pos"), x.alias("t")))
    ft = F.filter(indexed, lambda s: _keep_for_stats(s["t"]))
    return lines_df.select("doc_id", "line", ft.alias("ft"))


def _last_two(arr: Column) -> Column:
    """The last two elements of an array (all of it when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - 1, F.lit(1)), 2)


def with_carry(arrays: DataFrame, block: int = 2048) -> DataFrame:
    """Non-empty lines with c1, c2: the last and second-last statistic tokens
    before the line in the whole-document stream (null when there are none).

    Each non-empty line holds at least one token, so the two tokens before a
    line come from the two previous non-empty lines: a window frame of two
    rows inside blocks of ``block`` lines, plus -- for the first rows of a
    block -- the last two tokens of the two previous blocks (a window over
    one summary row per block).  One shuffle of the line rows; no task sees
    more than one block."""
    toks = F.transform("ft", lambda s: s["t"])
    ne = arrays.where(F.size("ft") > 0).select(
        "doc_id", "line", "ft", _last_two(toks).alias("lt"),
        F.floor(F.col("line") / block).alias("_blk"))
    w_in = Window.partitionBy("doc_id", "_blk").orderBy("line").rowsBetween(-2, -1)
    ne = ne.withColumn("_p_in", F.flatten(F.collect_list("lt").over(w_in)))
    rows = F.sort_array(F.collect_list(F.struct("line", "lt")))
    summary = ne.groupBy("doc_id", "_blk").agg(_last_two(rows).alias("_tail"))
    summary = summary.select("doc_id", "_blk", F.flatten(F.transform("_tail", lambda x: x["lt"])).alias("_tail"))
    w_b = Window.partitionBy("doc_id").orderBy("_blk").rowsBetween(-2, -1)
    carry = summary.select("doc_id", "_blk", F.flatten(F.collect_list("_tail").over(w_b)).alias("_cin")) \
        .where(F.size("_cin") > 0)
    d = ne.join(carry, ["doc_id", "_blk"], "left")
    before = F.concat(F.coalesce(F.col("_cin"), F.array().cast("array<string>")), F.col("_p_in"))
    n = F.size(before)
    return d.select("doc_id", "line", "ft", F.get(before, n - 1).alias("c1"), F.get(before, n - 2).alias("c2"))


def _of_documents(documents: DataFrame, whole, by_line) -> DataFrame:
    """``whole`` of the documents that fit an array and ``by_line`` of the lines of the others."""
    arrays, rest = whole_documents(documents)
    return whole(arrays) if rest is None else whole(arrays).unionByName(by_line(lines(rest)))


def _document_ngrams(documents: DataFrame) -> DataFrame:
    toks = F.flatten(F.transform(F.split("text", "\n", -1), lambda s, i: F.filter(
        F.transform(line_tokens(s), lambda x, k: F.struct(i.alias("line"), k.alias("pos"), x.alias("t"))),
        lambda x: _keep_for_stats(x["t"]))))
    d = documents.select("doc_id", toks.alias("ft")).select("doc_id", "ft", F.transform("ft", lambda x: x["t"]).alias("t0"))
    n, start = F.size("t0"), F.array(F.lit(""), F.lit(""))
    d = d.select("doc_id", "ft", F.slice(F.concat(start, "t0"), 1, n).alias("t2"), F.slice(F.concat(start, "t0"), 2, n).alias("t1"))
    return d.select("doc_id", F.explode(F.arrays_zip("ft", "t2", "t1")).alias("g")).select(
        "doc_id", "g.ft.line", "g.ft.pos", "g.t2", "g.t1", F.col("g.ft.t").alias("t0"))


def ngram_rows(lines_df: DataFrame, block: int = 2048) -> DataFrame:
    """(doc_id, line, pos, t2, t1, t0): one row per statistic token.

    The context arrays are shifted slices zipped together, so the work per
    line is linear in its token count."""
    if "line" not in lines_df.columns:
        return _of_documents(lines_df, _document_ngrams, lambda rest: ngram_rows(rest, block))
    d = with_carry(stat_token_arrays(lines_df), block)
    d = d.select(
        "doc_id", "line",
        F.transform("ft", lambda s: s["pos"]).alias("pos"),
        F.transform("ft", lambda s: s["t"]).alias("t0"),
        F.array(F.coalesce(F.col("c2"), F.lit("")), F.coalesce(F.col("c1"), F.lit(""))).alias("_head"),
    )
    d = d.select(
        "doc_id", "line", "pos", "t0",
        F.concat("_head", "t0").alias("_ctx"),
    ).select(
        "doc_id", "line", "pos", "t0",
        F.slice("_ctx", 1, F.size("t0")).alias("t2"),
        F.slice("_ctx", 2, F.size("t0")).alias("t1"),
    )
    return (
        d.where(F.size("t0") > 0)
        .select("doc_id", "line", F.explode(F.arrays_zip("pos", "t2", "t1", "t0")).alias("g"))
        .select("doc_id", "line", "g.pos", "g.t2", "g.t1", "g.t0")
    )


def trigram_counts(lines_df: DataFrame) -> DataFrame:
    return ngram_rows(lines_df).groupBy("t2", "t1", "t0").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(lines_df: DataFrame, trigrams: DataFrame | None = None) -> DataFrame:
    if trigrams is None:
        return ngram_rows(lines_df).groupBy("t1", "t0").agg(F.count(F.lit(1)).alias("n"))
    return trigrams.groupBy("t1", "t0").agg(F.sum("n").alias("n"))


def token_counts(lines_df: DataFrame, trigrams: DataFrame | None = None) -> DataFrame:
    if trigrams is None:  # a token's count needs no context: narrow up to the one aggregation
        t = F.explode(F.filter(line_tokens(F.col("text")), _keep_for_stats))
        return lines_df.select(F.explode(F.split("text", "\n", -1)).alias("text")).select(t.alias("t0")).groupBy("t0").agg(F.count(F.lit(1)).alias("n"))
    return trigrams.groupBy("t0").agg(F.sum("n").alias("n"))


def unigram_counts(tokens: DataFrame) -> DataFrame:
    """(t0, n) straight from a token table: every statistic token is one
    unigram, so no context is needed."""
    keep = (F.col("kind").isin(*lx.STAT_KINDS)) & (F.length("t") <= lx.STAT_MAX_LEN)
    return tokens.where(keep).groupBy(F.col("t").alias("t0")).agg(F.count(F.lit(1)).alias("n"))


def prune(counts: DataFrame, ratio: float) -> DataFrame:
    """Keep rows with ``n > max(n) * ratio`` (strict).  The maximum is a
    scalar subquery: one extra aggregation job, no join."""
    top = counts.select(F.max("n")).scalar()
    return counts.where(F.col("n") > top * F.lit(ratio))


def all_statistics(lines_df: DataFrame) -> dict[str, DataFrame]:
    tri = trigram_counts(lines_df)
    return {
        "token": token_counts(lines_df, tri),
        "bigram": bigram_counts(lines_df, tri),
        "trigram": tri,
    }


def pruned_statistics(lines_df: DataFrame, materialize: bool = False) -> dict[str, DataFrame]:
    """Pruned token / bigram / trigram tables.  With ``materialize`` the
    trigram counts are written once and the three tables (and the three
    maxima) are derived from the written table."""
    if materialize:
        from linden.session import materialize as write_once
        tri = write_once(trigram_counts(lines_df), "trigram-counts")
        s = {"token": token_counts(lines_df, tri), "bigram": bigram_counts(lines_df, tri), "trigram": tri}
    else:
        s = all_statistics(lines_df)
    return {
        "token": prune(s["token"], lx.PRUNE_RATIO_TOKEN),
        "bigram": prune(s["bigram"], lx.PRUNE_RATIO_BIGRAM),
        "trigram": prune(s["trigram"], lx.PRUNE_RATIO_TRIGRAM),
    }


def token_context(lines_df: DataFrame) -> DataFrame:
    """(doc_id, line, pos, t0, t1, t2, t3) for every token, where the stream
    seen by a line is [second-last and last token of the previous line, '',
    tokens of the line].  "Previous line" is exactly ``line - 1`` (an empty
    previous line contributes ''), so it is an equi-join, not a scan; within a
    whole document it is the array's element before, without a join."""
    if "line" not in lines_df.columns:
        return _of_documents(lines_df, lambda docs: _context_rows(_line_arrays(docs).select(
            "doc_id", F.posexplode("_lines").alias("line", "_l")).select("doc_id", "line", "_l.t0", "_l.prev_t0")), token_context)
    d = lines_df.select("doc_id", "line", line_tokens(F.col("text")).alias("t0"))
    return _context_rows(shift_lines(d, ["t0"]))


def _line_arrays(documents: DataFrame) -> DataFrame:
    """(doc_id, _lines): the tokens of each line of a document and of the line before."""
    d = documents.select("doc_id", F.transform(F.split("text", "\n", -1), line_tokens).alias("t0"))
    before = F.slice(F.concat(F.array(F.array().cast("array<string>")), "t0"), 1, F.size("t0"))
    return d.select("doc_id", "t0", before.alias("prev_t0")).select("doc_id", F.arrays_zip("t0", "prev_t0").alias("_lines"))


def context_arrays(documents: DataFrame) -> DataFrame:
    """(doc_id, ctx ARRAY<STRUCT<line, pos, t0, t1, t2, t3>>): ``token_context`` of whole documents."""
    return documents.select("doc_id", F.transform(F.split("text", "\n", -1), line_tokens).alias("t0")).select("doc_id", contexts(F.col("t0")).alias("ctx"))


def contexts(toks: Column) -> Column:
    """ARRAY<STRUCT<line, pos, t0, t1, t2, t3>> of the tokens ARRAY<ARRAY<STRING>> of a document's lines."""
    last = lambda prev, k: F.coalesce(F.get(prev, F.size(prev) - k), F.lit(""))
    none = F.array().cast("array<string>")
    stream = lambda lines: F.transform(lines, lambda ts, i: bound(F.coalesce(F.get(lines, i - 1), none), lambda prev: F.struct(
        ts.alias("t0"), F.concat(F.array(last(prev, 2), last(prev, 1), F.lit("")), ts).alias("c"))))
    return F.flatten(F.transform(bound(toks, stream), lambda x, i: F.transform(x["t0"], lambda t, k: F.struct(
        i.alias("line"), k.alias("pos"), t.alias("t0"), F.get(x["c"], k + 2).alias("t1"), F.get(x["c"], k + 1).alias("t2"),
        F.get(x["c"], k).alias("t3")))))


def _context_rows(d: DataFrame) -> DataFrame:
    prev = F.coalesce(F.col("prev_t0"), F.array().cast("array<string>"))
    pn = F.size(prev)
    head = F.array(
        F.coalesce(F.get(prev, pn - 2), F.lit("")),
        F.coalesce(F.get(prev, pn - 1), F.lit("")),
        F.lit(""),
    )
    d = d.where(F.size("t0") > 0).select(
        "doc_id", "line", "t0", F.concat(head, F.col("t0")).alias("_ctx"))
    n = F.size("t0")
    d = d.select(
        "doc_id", "line", "t0",
        F.sequence(F.lit(0), n - 1).alias("pos"),
        F.slice("_ctx", 3, n).alias("t1"),
        F.slice("_ctx", 2, n).alias("t2"),
        F.slice("_ctx", 1, n).alias("t3"),
    )
    return (
        d.select("doc_id", "line", F.explode(F.arrays_zip("pos", "t0", "t1", "t2", "t3")).alias("r"))
        .select("doc_id", "line", "r.pos", "r.t0", "r.t1", "r.t2", "r.t3")
    )
