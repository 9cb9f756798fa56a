"""Regex search, replace and roll-ups over line tables.

A match is ``(doc_id, line, start, end, match)`` with 0-based character
offsets.  Offsets come from the pieces between matches (``split``) and the
matches themselves (``regexp_extract_all``): start of match i is the running
length of everything before it, summed by a window over one line only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx

# Characters escaped when a search text is used literally.
_REGEX_SPECIAL = re.compile(r"([.*+?^${}()|\[\]\\/-])")


def escape_regex(text: str) -> str:
    """Escape regex metacharacters of a literal search text."""
    return _REGEX_SPECIAL.sub(r"\\\1", text)


_ASCII_WORD = "[0-9A-Za-z_]"


def _is_word_char(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def build_pattern(text: str, regex: bool = False, whole_word: bool = False,
                  case_sensitive: bool = True, dialect: str = "java") -> str:
    """Pattern literal for a find request: escaped unless ``regex``, wrapped
    in word boundaries when ``whole_word``, ``(?i)`` when case-insensitive.

    Word boundaries follow the ASCII definition of a word character.  Java's
    ``\\b`` also counts non-ASCII letters, so for ``dialect="java"`` the
    boundary is spelled out with look-arounds on the literal's first and last
    character; ``dialect="re2"`` keeps ``\\b`` (already ASCII there)."""
    p = text if regex else escape_regex(text)
    if whole_word:
        if dialect == "re2" or regex or not text:
            p = rf"\b{p}\b"
        else:
            head = f"(?<!{_ASCII_WORD})" if _is_word_char(text[0]) else f"(?<={_ASCII_WORD})"
            tail = f"(?!{_ASCII_WORD})" if _is_word_char(text[-1]) else f"(?={_ASCII_WORD})"
            p = head + p + tail
    if not case_sensitive:
        p = "(?i)" + p
    return p


def search_limit(text: str) -> int:
    return lx.SEARCH_LIMIT_SHORT if len(text) == 1 else lx.SEARCH_LIMIT


def escape_regex_col(c: Column) -> Column:
    """Column form of ``escape_regex``."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\/-])", r"\\$1")


def find_matches(lines: DataFrame, pattern: str, with_index: bool = False) -> DataFrame:
    """(doc_id, line, start, end, match) for every match of ``pattern``
    (plus ``i``, the match number within the line, when ``with_index``)."""
    pat = F.lit(pattern)
    hit = lines.where(F.col("text").rlike(pattern))  # cheap prefilter
    d = hit.select(
        "doc_id", "line",
        F.regexp_extract_all("text", pat, 0).alias("m"),
        F.split("text", pattern, -1).alias("_gaps"),
    )
    d = d.select("doc_id", "line", "m", F.slice("_gaps", 1, F.size("m")).alias("gap"))
    d = d.select(
        "doc_id", "line",
        F.posexplode(F.arrays_zip("m", "gap")).alias("i", "z"),
    ).select("doc_id", "line", "i", F.col("z.m").alias("match"), F.length(F.col("z.gap")).alias("_g"))
    w = Window.partitionBy("doc_id", "line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.col("_g") + F.length("match")).over(w)
    d = d.withColumn("start", (run - F.length("match")).cast("int"))
    cols = ["doc_id", "line", "start", (F.col("start") + F.length("match")).alias("end"), "match"]
    if with_index:
        cols.append(F.col("i").cast("int").alias("i"))
    return d.select(*cols)


def highlight(text: Column, start: Column, end: Column) -> Column:
    """Wrap ``text[start:end]`` (0-based, end exclusive) in ``<em>`` tags."""
    return F.concat(
        text.substr(F.lit(1), start),
        F.lit("<em>"), text.substr(start + 1, end - start),
        F.lit("</em>"), text.substr(end + 1, F.lit(1 << 30)),
    )


def search_rollup(matches: DataFrame, limit: int) -> DataFrame:
    """One row (n_files, n_matches, overflow): files are visited in doc_id
    order and the scan stops after the file whose matches push the total over
    ``limit``.  Every matching file has at least one match, so at most
    ``limit + 1`` files can be visited: a distributed top-(limit+1) bounds the
    ordered running sum."""
    per_file = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    first = per_file.orderBy("doc_id").limit(limit + 1)
    w = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    visited = first.withColumn("_before", F.coalesce(F.sum("k").over(w), F.lit(0))).where(
        F.col("_before") <= limit)
    return visited.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_matches"),
    ).withColumn("overflow", F.col("n_matches") > limit)


def replace_all(lines: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """(doc_id, line, text, n): rewritten lines that had at least one
    substitution, with the substitution count.  Write the result to a new
    path; the source is never modified in place."""
    n = F.regexp_count("text", F.lit(pattern))
    return (
        lines.where(F.col("text").rlike(pattern))
        .select("doc_id", "line", F.regexp_replace("text", pattern, replacement).alias("text"), n.alias("n"))
    )


def keyword_filter(names: DataFrame, col: str, keywords: str, limit: int | None = None) -> DataFrame:
    """Rows whose lower-cased ``col`` contains every whitespace-separated
    keyword (lower-cased); paths under ``__pycache__`` are skipped."""
    kws = [k.lower() for k in keywords.split()]
    arr = F.array(*[F.lit(k) for k in kws]) if kws else F.array().cast("array<string>")
    low = F.lower(F.col(col))
    out = names.where(F.forall(arr, lambda k: low.contains(k)) & ~F.col(col).contains("__pycache__"))
    if limit is not None:
        out = out.orderBy(col).limit(limit)
    return out
