"""Order-dependent look-backs within a document, without one task per document.

A plain ``Window.partitionBy(doc_id).orderBy(line)`` sends every line of a
document to one task.  If one document holds a large share of the corpus that
task becomes the whole job.  ``carry_last`` answers "the last non-null value
strictly before this row" in two bounded levels instead:

1. rows are cut into blocks of ``block`` consecutive lines; inside a block the
   look-back is a window over ``(doc_id, block)`` -- at most ``block`` rows;
2. each block reduces to one summary row (its last non-null value); the carry
   into a block is a window over those summaries -- ``lines / block`` rows
   per document;
3. the carry is joined back on ``(doc_id, block)``.

Both windows and the join spread a hot document over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions.similarity import bound

DEFAULT_BLOCK = 2048


def carry_last(df: DataFrame, value: Column, out: str, *, key="doc_id",
               order: str = "line", block: int = DEFAULT_BLOCK,
               inclusive: bool = False, block_col: Column | None = None) -> DataFrame:
    """Add column ``out`` = last non-null ``value`` over rows with a smaller
    ``order`` (``<=`` when ``inclusive``) in the same ``key`` (a column name
    or a list of names).

    ``order`` must be unique within ``key``: one integral column, or a list
    of columns compared in order (then ``block_col`` is required).
    ``block_col`` overrides the block id (it must be non-decreasing in
    ``order``), e.g. ``floor(line / 2048)`` when ``order`` packs (line, pos),
    or a time bucket for event streams.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    if len(orders) > 1 and block_col is None:
        raise ValueError("block_col is required with a composite order")
    blk = "_cl_blk"
    val = "_cl_val"
    bcol = block_col if block_col is not None else F.floor(F.col(orders[0]) / block)
    d = df.withColumn(blk, bcol).withColumn(val, value)
    end = 0 if inclusive else -1
    w_in = Window.partitionBy(*keys, blk).orderBy(*orders).rowsBetween(Window.unboundedPreceding, end)
    d = d.withColumn("_cl_local", F.last(val, ignorenulls=True).over(w_in))

    # The block summary is read from the windowed rows, which are already
    # hash-partitioned by (key, block): no extra shuffle for the groupBy.
    summary = (
        d.groupBy(*keys, blk)
        .agg(F.max_by(F.col(val), F.when(F.col(val).isNotNull(), F.struct(*orders))).alias("_cl_blast"))
    )
    w_b = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, blk, F.last("_cl_blast", ignorenulls=True).over(w_b).alias("_cl_in"))
    # Only blocks that receive a value from an earlier block need the join;
    # for keys that live in one block this side is empty, so the join back
    # is cheap (AQE broadcasts it when small) instead of a second full shuffle.
    carry = carry.where(F.col("_cl_in").isNotNull())
    return (
        d.join(carry, [*keys, blk], "left")
        .withColumn(out, F.coalesce(F.col("_cl_local"), F.col("_cl_in")))
        .drop(blk, val, "_cl_local", "_cl_in")
    )


def carry_next(df: DataFrame, value: Column, out: str, *, key="doc_id",
               order: str = "line", block: int = DEFAULT_BLOCK,
               inclusive: bool = False) -> DataFrame:
    """Mirror of ``carry_last``: first non-null ``value`` over later rows."""
    neg = "_cn_neg"
    d = df.withColumn(neg, -F.col(order))
    d = carry_last(d, value, out, key=key, order=neg, block=block, inclusive=inclusive)
    return d.drop(neg)


def shift_lines(df: DataFrame, cols: list[str], by: int = 1, *, key: str = "doc_id",
                order: str = "line", prefix: str = "prev_") -> DataFrame:
    """Attach columns of the row ``by`` lines earlier (exact offset, not the
    last existing one) by an equi-join on ``(key, order)``.  Unique join keys
    hash evenly, so a large document is spread over all tasks."""
    src = df.select(
        F.col(key), (F.col(order) + by).alias(order),
        *[F.col(c).alias(prefix + c) for c in cols],
    )
    return df.join(src, [key, order], "left")


def last_before(marks: Column, n: Column) -> Column:
    """Array of ``n`` elements: at each index the last of the ascending indices
    ``marks`` before it, -1 where there is none."""
    return bound(F.struct(marks.alias("m"), n.alias("n")), lambda x: F.concat(
        F.array_repeat(F.lit(-1), F.coalesce(F.get(x["m"], 0) + 1, x["n"])),
        F.flatten(F.transform(x["m"], lambda a, k: F.array_repeat(a, F.coalesce(F.get(x["m"], k + 1), x["n"] - 1) - a)))))


def line_pos_order(line: str = "line", pos: str = "pos") -> Column:
    """One integral order key for (line, pos) pairs."""
    return F.col(line).cast("long") * F.lit(1 << 31) + F.col(pos).cast("long")
