"""Derived relations over the driver tables.

``lines``       (doc_id, line, text)            one row per line, 0-based
``tokens``      (doc_id, line, pos, kind, t)    one row per token of a line
``code_lines``  (doc_id, line, text)            code-shaped lines, two to a line
``edit_log``    (doc_id, line, text, ts, seq)   edits replayed from ``events``
``manifest_old`` / ``manifest_new`` (path, hash)

All are narrow transformations of one scan (explode / regex), so they add no
shuffle; downstream operators decide the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions.similarity import bound


def lines(documents: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Split each document on ``\\n``; trailing empty lines are kept."""
    return documents.select(
        F.col(key).alias("doc_id"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "text"),
    )


# --- fixed values: documents handled as one array ----------------------------------------
WHOLE_CHARS = 1 << 20
BROADCAST_IDS = 1_000_000


def whole_documents(documents: DataFrame, limit: int = WHOLE_CHARS, most_lines: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``documents`` (doc_id, text) in two parts: those whose id comes once and
    whose text has at most ``limit`` characters (and ``most_lines`` lines), and
    the others (None if there are none).  What looks back within a document is an array expression over
    the first, without a shuffle, and a blocked look-back over the lines of
    the others.  One job over the ids and lengths decides."""
    docs = documents.where(F.col("text").isNotNull())
    long = F.length("text") > limit
    if most_lines is not None:
        long = long | (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) >= most_lines)
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(long).alias("long")).where(
        F.col("doc_id").isNull() | (F.col("n") > 1) | F.col("long")).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_odd"))
    n = odd.count()
    if n == 0:
        return docs, None
    marked = docs.join(F.broadcast(odd) if n <= BROADCAST_IDS else odd, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return marked.where("_odd is null").select("doc_id", "text"), marked.where("_odd").select("doc_id", "text")


def token_kind(t: Column) -> Column:
    """Kind of a token produced by ``TOKEN_PATTERN`` (decided by its first
    character; a lone quote is an operator)."""
    return (
        F.when(t.startswith("#"), F.lit(lx.KIND_COMMENT))
        .when((F.length(t) >= 2) & (t.startswith('"') | t.startswith("'")), F.lit(lx.KIND_STRING))
        .when(t.rlike(r"^\p{N}"), F.lit(lx.KIND_NUMBER))
        .when(t.rlike(r"^[\p{L}_]"), F.lit(lx.KIND_NAME))
        .otherwise(F.lit(lx.KIND_OP))
    )


def line_tokens(text: Column) -> Column:
    """Array of token strings of one line."""
    return F.regexp_extract_all(text, F.lit(lx.TOKEN_PATTERN), 0)


def tokens(lines_df: DataFrame) -> DataFrame:
    return (
        lines_df.select(
            "doc_id", "line",
            F.posexplode(line_tokens(F.col("text"))).alias("pos", "t"),
        )
        .withColumn("kind", token_kind(F.col("t")))
        .select("doc_id", "line", "pos", "kind", "t")
    )


def _word(ws: Column, i: int) -> Column:
    return F.coalesce(F.get(ws, i), F.lit("x"))


# --- fixed values: words that the code line of ``line % 8`` uses, its indentation ------
CODE_WORDS = (1, 2, 4, 3, 0, 3, 2, 3)
CODE_INDENT = (0, 4, 8, 8, 8, 0, 0, 4)


def code_lines(lines_df: DataFrame) -> DataFrame:
    """Two code-shaped lines for each line, with all its lower-cased words:
    at ``2 * line`` a code line chosen by ``line % 8`` from the first words
    (up to four), at ``2 * line + 1`` the other words as a comment, or an empty
    line if there are none."""
    df = lines_df.select("doc_id", "line", _words(F.col("text")).alias("_ws"))
    code, comment = _code_pair(F.col("line"), F.col("_ws"))
    both = F.array(F.struct((F.col("line") * 2).alias("line"), code.alias("text")), F.struct((F.col("line") * 2 + 1).alias("line"), comment.alias("text")))
    return df.select("doc_id", F.explode(both).alias("_l")).select("doc_id", "_l.line", "_l.text")


def code_line_arrays(documents: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, codes ARRAY<STRING>, ``kept``): the ``code_lines`` of each
    document, line ``i`` at index ``i``."""
    pair = lambda text, i: bound(_words(text), lambda ws: F.array(*_code_pair(i, ws)))
    return documents.select("doc_id", F.flatten(F.transform(F.split("text", "\n", -1), pair)).alias("codes"), *kept)


def code_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the ``code_lines`` of each document as one text."""
    return code_line_arrays(documents).select("doc_id", F.array_join("codes", "\n").alias("text"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(lx.WORD_PATTERN), 0)


def _code_pair(line: Column, ws: Column) -> tuple[Column, Column]:
    """Code line and comment of a line's words."""
    w1, w2, w3, w4 = (_word(ws, i) for i in range(4))
    m = line % 8
    text = (
        F.when(m == 0, F.concat(F.lit("class "), F.upper(F.substring(w1, 1, 1)), F.substring(w1, 2, 1 << 30), F.lit(":")))
        .when(m == 1, F.concat(F.lit("    def "), w1, F.lit("(self, "), w2, F.lit("=1):")))
        .when(m == 2, F.concat(F.lit("        "), w1, F.lit("_"), w2, F.lit(" = "), w3, F.lit("."), w4, F.lit("("), w2, F.lit(")")))
        .when(m == 3, F.concat(F.lit("        # "), w1, F.lit(" "), w2, F.lit(" "), w3))
        .when(m == 4, F.lit(""))
        .when(m == 5, F.concat(F.lit("from "), w1, F.lit(" import "), w2, F.lit(", "), w3))
        .when(m == 6, F.concat(F.lit("for "), w1, F.lit(" in "), w2, F.lit("s:")))
        .otherwise(F.concat(F.lit("    "), w1, F.lit("1 = "), w2, F.lit("[0]."), w3))
    )
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), m + 1)
    used = of(CODE_WORDS)
    rest = F.slice(ws, used + 1, F.greatest(F.size(ws) - used, F.lit(0)))
    comment = F.when(F.size(ws) > used, F.concat(F.repeat(F.lit(" "), of(CODE_INDENT)), F.lit("# "), F.array_join(rest, " "))).otherwise("")
    return text, comment


def edit_log(events: DataFrame) -> DataFrame:
    """Edits replayed from ``events``: user -> document, ``props.k`` -> line,
    event type -> new text."""
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.get_json_object("props", "$.k").try_cast("int").alias("line"),
        F.col("event_type").alias("text"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
    )


def manifest_old(documents: DataFrame) -> DataFrame:
    """One path per document; those that are gone later are under ``old/``."""
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, "old/").otherwise(""), F.col("doc_id").cast("string"))
    return documents.select(path.alias("path"), F.md5(F.col("text")).alias("hash"))


def manifest_new(documents: DataFrame) -> DataFrame:
    """One path per document; those not there before are under ``new/``, and
    the text of every fifth has grown."""
    path = F.concat(F.when(F.col("doc_id") % 7 == 0, "new/").otherwise(""), F.col("doc_id").cast("string"))
    suffix = F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.lit(""))
    return documents.select(path.alias("path"), F.md5(F.concat(F.col("text"), suffix)).alias("hash"))
