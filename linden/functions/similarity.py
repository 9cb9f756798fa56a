"""String similarity as JVM-side expressions, plus one Arrow-batched helper.

``ratio`` and ``partial_ratio`` rest on a bit-parallel longest common
subsequence written with ``aggregate``: interpreted, but in the JVM with no
Python worker, and one addition per character.  Callers must block pairs
(equi-join on a cheap key) before scoring.
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: abbreviation scoring --------------------------------------------------
ABBREV_EQUAL = 1000
ABBREV_MATCH_LOWER = 5
ABBREV_MATCH_UPPER = 10
ABBREV_SKIP = -1
ABBREV_UNMATCHED = -200
ABBREV_MIN = -9999
ABBREV_FIRST_CHAR_EXACT = 100
ABBREV_MAX_INPUT = 31


def chars(s: Column) -> Column:
    return F.split(s, "", -1)


WORD_BITS = 62  # characters that fit a long with a bit to spare for the carry


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: an expression that is
    written inside a lambda is computed again for each of its elements."""
    return F.transform(F.array(value), body)[0]


def _places(letters: Column, c: Column) -> Column:
    """A long with a bit for each place of ``c`` in ``letters``, given last letter first."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: s + s + (x == c).cast("long"))


def _lcs_of_places(places: Column, n: Column, full: Column) -> Column:
    """LCS length of a text of ``n`` letters (``full``: a bit for each) and one
    whose letters stand at ``places`` in it: one addition takes a letter."""
    def step(v: Column, p: Column) -> Column:
        return bound(v.bitwiseAND(p), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(full))

    return n - F.bit_count(F.aggregate(places, full, step))


def _full(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1


def _lcs_bits(a: Column, b: Column) -> Column:
    """LCS length, ``a`` of 1 to ``WORD_BITS`` characters: a long holds a bit
    per character of ``a``."""
    parts = F.struct(F.reverse(chars(a)).alias("a"), chars(b).alias("b"), F.length(a).alias("n"), _full(F.length(a)).alias("full"))
    return bound(parts, lambda x: _lcs_of_places(F.transform(x["b"], lambda c: _places(x["a"], c)), x["n"], x["full"]))


def _lcs_table(a: Column, b: Column) -> Column:
    """LCS length of strings of any length, a row of the table at a time."""
    def table(x: Column) -> Column:
        cb, n = x["b"], x["n"]

        def next_row(prev, ca):
            return F.aggregate(
                F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                F.array(F.lit(0)),
                lambda cur, j: F.when(j > n, cur).otherwise(
                    F.concat(cur, F.array(
                        F.when(ca == F.get(cb, j - 1), F.get(prev, j - 1) + 1)
                        .otherwise(F.greatest(F.get(prev, j), F.get(cur, j - 1)))))),
            )

        return F.get(F.aggregate(chars(a), F.array_repeat(F.lit(0), n + 1), next_row), n)

    return bound(F.struct(chars(b).alias("b"), F.size(chars(b)).alias("n")), table)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0))
        .when(F.length(a) <= WORD_BITS, _lcs_bits(a, b))
        .when(F.length(b) <= WORD_BITS, _lcs_bits(b, a))
        .otherwise(_lcs_table(a, b))
    )


def ratio(a: Column, b: Column) -> Column:
    """0..100 similarity: round-half-even(200 * LCS / (len a + len b)); 0 when
    either side is empty."""
    total = F.length(a) + F.length(b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(
        F.bround(F.lit(200.0) * lcs_length(a, b) / total, 0).cast("int"))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ``ratio`` between the shorter string and every window of the
    longer one with the same length."""
    a_first = F.length(a) <= F.length(b)
    pair = F.struct(F.when(a_first, a).otherwise(b).alias("short"), F.when(a_first, b).otherwise(a).alias("long"))
    return bound(pair, lambda x: F.when(F.length(x["short"]) == 0, F.lit(0))
                 .when(F.length(x["short"]) <= WORD_BITS, _partial_bits(x["short"], x["long"]))
                 .otherwise(_partial_table(x["short"], x["long"])))


def _windows(short: Column, long_: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(long_) - F.length(short) + 1, F.lit(1)))


def _partial_bits(short: Column, long_: Column) -> Column:
    """The places of the longer string's letters in the shorter one are found
    once; a window is a slice of them."""
    letters = F.struct(F.reverse(chars(short)).alias("short"), chars(long_).alias("long"))
    places = bound(letters, lambda x: F.transform(x["long"], lambda c: _places(x["short"], c)))
    parts = F.struct(places.alias("places"), F.length(short).alias("n"), _full(F.length(short)).alias("full"))
    best = bound(parts, lambda x: F.array_max(F.transform(
        _windows(short, long_), lambda i: _lcs_of_places(F.slice(x["places"], i, x["n"]), x["n"], x["full"]))))
    return F.bround(F.lit(200.0) * best / (F.length(short) * 2), 0).cast("int")


def _partial_table(short: Column, long_: Column) -> Column:
    return F.array_max(F.transform(_windows(short, long_), lambda i: ratio(short, F.substring(long_, i, F.length(short)))))


# --- SQL twins (DuckDB dialect) -------------------------------------------------------------

def lcs_sql(a: str, b: str) -> str:
    cb = f"string_split({b}, '')"
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce(string_split({a}, ''), "
            f"lambda prev, ca: list_reduce(range(1, len({cb}) + 1), lambda cur, j: list_append(cur, "
            f"CASE WHEN ca = {cb}[j] THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]), "
            f"list_transform(range(0, len({cb}) + 1), lambda x: 0))[-1] END)")


def ratio_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE "
            f"CAST(round_even(200.0 * {lcs_sql(a, b)} / (length({a}) + length({b})), 0) AS INTEGER) END)")


def partial_ratio_sql(a: str, b: str) -> str:
    short = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)"
    long_ = f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    win = f"substr({long_}, i, length({short}))"
    return (f"(CASE WHEN length({short}) = 0 THEN 0 ELSE list_max(list_transform("
            f"range(1, greatest(length({long_}) - length({short}) + 1, 1) + 1), lambda i: {ratio_sql(short, win)})) END)")


# --- abbreviation score (Arrow-batched helper) ------------------------------------------------

NOWHERE = float("-inf")


def _gains(target: str, typed: str) -> list[list[float]]:
    """What each typed character is worth on each target position.  A letter
    that starts a word (an upper-case letter in a mixed-case target, or one
    behind an underscore) is worth more than one inside a word."""
    shout = target == target.upper()
    behind = ["", *target]
    rows = []
    for letter in typed:
        big = letter.upper()
        rows.append([
            NOWHERE if c.upper() != big else
            ABBREV_MATCH_UPPER if b == "_" or (c == big and not shout) else ABBREV_MATCH_LOWER
            for c, b in zip(target, behind)])
    if rows and rows[0] and rows[0][0] != NOWHERE:
        rows[0][0] = ABBREV_FIRST_CHAR_EXACT if typed[0] == target[0] else ABBREV_MATCH_UPPER
    return rows


def abbreviation_score(target: str, typed: str) -> int:
    """Fuzzy score of ``typed`` as an abbreviation of ``target``.

    ``row[j]`` is the best score of the letters so far with ``j`` characters of
    the target skipped; the next letter lands on the character behind both.
    Skipping on from a smaller ``j`` costs one skip however far it goes, which
    a running maximum provides.  A letter that lands beyond the target's end
    costs a fixed amount, but without any skip it has no place.  In the end all
    but one of the target's characters count as skipped.  Letters that match
    without a skip are added up even behind one that has no place."""
    if typed == target:
        return ABBREV_EQUAL
    n = len(target)
    if n == 0:
        return ABBREV_MIN
    row = [0.0, *[float(ABBREV_SKIP)] * (n - 1)]
    for i, worth in enumerate(_gains(target, typed[:ABBREV_MAX_INPUT])):
        here = [*worth[i:], *[float(ABBREV_UNMATCHED)] * min(i, n)]
        if i >= n:
            here[0] = NOWHERE
        landed = [max(row[0], ABBREV_MIN) + here[0], *(v + w for v, w in zip(row[1:], here[1:]))]
        row = [max(v, skipped + ABBREV_SKIP) for v, skipped in zip(landed, [NOWHERE, *accumulate(landed, max)])]
    return int(max(row[-1], ABBREV_MIN))


@F.pandas_udf(T.IntegerType())
def abbreviation_score_udf(target: pd.Series, typed: pd.Series) -> pd.Series:
    return pd.Series([abbreviation_score(t, s) for t, s in zip(target, typed)], dtype="int32")
