"""Column-level text helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linden.functions import lexicon as lx

# --- fixed values: word split for case conversion ------------------------------------
CASE_WORD_PATTERN = r"[\p{L}\p{N}]+"


def case_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CASE_WORD_PATTERN), 0)


def pascal_case(c: Column) -> Column:
    """``small ring`` -> ``SmallRing`` (each word capitalised, rest lower)."""
    return F.array_join(
        F.transform(case_words(c), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))),
        "")


def camel_case(c: Column) -> Column:
    """``small ring`` -> ``smallRing``."""
    p = pascal_case(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


def snake_case(c: Column) -> Column:
    """``small ring`` / ``SmallRing`` -> ``small_ring``."""
    spaced = F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.array_join(F.transform(case_words(spaced), lambda w: F.lower(w)), "_")


def convert_case(c: Column, class_context: Column) -> Column:
    """PascalCase in a class context or when the input starts upper-case,
    otherwise snake_case."""
    starts_upper = F.substring(c, 1, 1).rlike(r"^\p{Lu}$")
    return F.when(class_context | starts_upper, pascal_case(c)).otherwise(snake_case(c))


def doc_style(doc: Column) -> Column:
    """Docstring style, first match wins."""
    return (
        F.when(doc.contains("-----"), F.lit(lx.DOC_STYLE_NUMPY))
        .when(doc.contains("Args:") | doc.contains("Returns:"), F.lit(lx.DOC_STYLE_GOOGLE))
        .when(doc.contains(":param ") | doc.contains(":returns:"), F.lit(lx.DOC_STYLE_RST))
        .otherwise(F.lit(lx.DOC_STYLE_TEXT))
    )


def is_upper(c: Column) -> Column:
    """Python ``str.isupper``: has a cased character and no lower-case one."""
    return (c == F.upper(c)) & (c != F.lower(c))


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def is_initial_upper(c: Column) -> Column:
    return F.substring(c, 1, 1).rlike(r"^\p{Lu}$")
