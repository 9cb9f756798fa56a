"""Line-structure operators over code-shaped line tables (doc_id, line, text).

Look-backs within a document use ``sequence.carry_last`` / ``shift_lines``
(bounded groups, equi-joins); everything else is per-row expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions.similarity import bound
from linden.operators.sequence import carry_last, carry_next, shift_lines

# --- fixed values: code structure ---------------------------------------------------
INDENT_UNIT = 4
OUTLINE_PATTERN = r"^([ \t]*)(async[ \t]+)?(def|class)[ \t]+([\p{L}_][\p{L}\p{N}_]*)"
IMPORT_LINE_PATTERN = r"^\s*(from|import)\s"
IDENT = r"[\p{L}\p{N}_][\p{L}\p{N}_]*"


def indent_of(text: Column) -> Column:
    """Number of leading whitespace characters."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(" \t")))


def is_blank(text: Column) -> Column:
    return F.trim(text, F.lit(" \t")) == ""


def outline(lines: DataFrame, pattern: str = OUTLINE_PATTERN, unit: int = INDENT_UNIT) -> DataFrame:
    """(doc_id, line, indent, level, kind, name) for def / class / async def
    lines; level = indent / unit."""
    pat = F.lit(pattern)
    d = lines.where(F.col("text").rlike(pattern)).select(
        "doc_id", "line",
        F.length(F.regexp_extract("text", pattern, 1)).alias("indent"),
        F.regexp_extract("text", pattern, 2).alias("_async"),
        F.regexp_extract("text", pattern, 3).alias("_kw"),
        F.regexp_extract("text", pattern, 4).alias("name"),
    )
    kind = F.when(F.col("_async") != "", F.lit("async")).otherwise(F.col("_kw"))
    return d.select("doc_id", "line", "indent", (F.col("indent") / F.lit(unit)).alias("level"),
                    kind.alias("kind"), "name")


def outline_parent(items: DataFrame, levels: list[float]) -> DataFrame:
    """Add parent_line / parent_name / parent_kind: the nearest previous item
    of the same document with a smaller level; ``is_method`` when the parent
    is a class.  One blocked look-back per distinct level (levels come from
    indentation, so there are few); exact for every level present."""
    d = items
    parent = None
    for k in sorted(set(levels)):
        col = f"_p{str(k).replace('.', '_')}"
        val = F.when(F.col("level") < F.lit(k), F.struct(F.col("line").alias("line"), F.col("name").alias("name"),
                                                           F.col("kind").alias("kind")))
        d = carry_last(d, val, col)
        pick = F.when(F.col("level") == F.lit(k), F.col(col))
        parent = pick if parent is None else F.coalesce(parent, pick)
    if parent is None:
        parent = F.lit(None).cast("struct<line:int,name:string,kind:string>")
    d = d.withColumn("_parent", parent)
    d = d.select(*items.columns, F.col("_parent.line").alias("parent_line"),
                 F.col("_parent.name").alias("parent_name"), F.col("_parent.kind").alias("parent_kind"))
    return d.withColumn("is_method", F.coalesce(F.col("parent_kind") == "class", F.lit(False)))


def enclosing_item(lines: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, line, item_line, item_name): the last outline item at or
    before each line (``item.line <= line < next.line``)."""
    j = lines.select("doc_id", "line").join(
        items.select("doc_id", "line", F.struct("line", "name").alias("_it")), ["doc_id", "line"], "left")
    j = carry_last(j, F.col("_it"), "_enc", inclusive=True)
    return j.select("doc_id", "line", F.col("_enc.line").alias("item_line"), F.col("_enc.name").alias("item_name"))


def class_without_init(items_with_parent: DataFrame) -> DataFrame:
    """Classes that have no ``__init__`` method among their children."""
    classes = items_with_parent.where(F.col("kind") == "class").select("doc_id", "line", "name")
    inits = items_with_parent.where((F.col("name") == "__init__") & (F.col("parent_kind") == "class")).select(
        "doc_id", F.col("parent_line").alias("line"))
    return classes.join(inits, ["doc_id", "line"], "left_anti")


def indent_delta(lines: DataFrame) -> DataFrame:
    """(doc_id, line, indent, indent_delta): indent minus the indent of the last
    earlier non-empty line (whitespace-only lines count as non-empty)."""
    d = lines.withColumn("indent", indent_of(F.col("text")))
    d = carry_last(d, F.when(F.col("text") != "", F.col("indent")), "_prev_indent")
    return d.select("doc_id", "line", "indent",
                    (F.col("indent") - F.coalesce(F.col("_prev_indent"), F.lit(0))).alias("indent_delta"))


def blank_before(lines: DataFrame) -> DataFrame:
    """(doc_id, line, blank_line_before): consecutive blank lines directly
    above the line; line 0 is never counted."""
    d = carry_last(lines, F.when(~is_blank(F.col("text")) & (F.col("line") >= 1), F.col("line")), "_last_nb")
    n = F.when(F.col("line") <= 1, F.lit(0)).otherwise(F.col("line") - 1 - F.coalesce(F.col("_last_nb"), F.lit(0)))
    return d.select("doc_id", "line", n.alias("blank_line_before"))


def prev_line_end(lines: DataFrame) -> DataFrame:
    """(doc_id, line, last_line_ends_with_<c> ...) for the 8 fixed chars."""
    d = shift_lines(lines.select("doc_id", "line", "text"), ["text"])
    last = F.substring(F.col("prev_text"), -1, 1)
    cols = [
        F.when((F.col("line") >= 1) & (F.coalesce(F.length("prev_text"), F.lit(0)) > 0) & (last == c), 1)
        .otherwise(0).alias(f"last_line_ends_with_{c}")
        for c in lx.LINE_END_CHARS
    ]
    return d.select("doc_id", "line", *cols)


def detect_indent(lines: DataFrame) -> DataFrame:
    """(doc_id, indent_unit, n): the most frequent non-zero absolute indent
    delta per document (ties -> smaller unit)."""
    d = indent_delta(lines).where(F.col("indent_delta") != 0)
    c = d.groupBy("doc_id", F.abs("indent_delta").alias("indent_unit")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), F.col("indent_unit"))
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def imports(lines: DataFrame) -> DataFrame:
    """(doc_id, line, module): modules named by ``import`` / ``from .. import``
    lines; ``as`` aliases cut, brackets dropped, relative imports skipped."""
    d = lines.where(F.col("text").rlike(IMPORT_LINE_PATTERN))
    return d.select("doc_id", "line", F.explode(import_modules(F.col("text"))).alias("m")).select("doc_id", "line", "m.i", "m.module")


def import_modules(t: Column) -> Column:
    """ARRAY<STRUCT<i, module>>: the modules that an import line names."""
    from_part = F.regexp_extract(t, r"^\s*from\s+(\S+)\s+import\s", 1)
    after = F.regexp_extract(t, r"import\s+(.*)$", 1)
    after = F.regexp_replace(F.split(after, " as ", 2).getItem(0), r"[()]", "")
    parts = F.transform(F.split(after, ","), lambda m, i: F.struct(i.alias("i"), F.trim(m).alias("m")))

    def of(prefix):
        named = F.filter(parts, lambda x: (x["m"] != "") & ~x["m"].startswith(".") & ~prefix.startswith("."))
        return F.transform(named, lambda x: F.struct(
            x["i"].alias("i"), F.when(prefix != "", F.concat(prefix, F.lit("."), x["m"])).otherwise(x["m"]).alias("module")))

    return bound(from_part, of)


def references(code_tokens_by_line: DataFrame) -> DataFrame:
    """(doc_id, t, n_def, n_assign, n_use): NAME occurrences classified as
    definition (after ``def``/``class``), assignment (before ``=``) or usage."""
    d = code_tokens_by_line
    toks = F.col("toks")
    occ = F.transform(
        toks,
        lambda x, i: F.struct(
            x.alias("t"),
            F.when(F.get(toks, i - 1).isin("def", "class"), F.lit("definition"))
            .when(F.get(toks, i + 1) == "=", F.lit("assignment"))
            .otherwise(F.lit("usage")).alias("role"),
        ),
    )
    names = F.filter(occ, lambda s: s["t"].rlike(r"^[\p{L}_]") & ~s["t"].isin(*lx.PY_KEYWORDS))
    e = d.select("doc_id", F.explode(names).alias("o")).select("doc_id", "o.t", "o.role")
    return e.groupBy("doc_id", "t").agg(
        F.count_if(F.col("role") == "definition").alias("n_def"),
        F.count_if(F.col("role") == "assignment").alias("n_assign"),
        F.count_if(F.col("role") == "usage").alias("n_use"),
    )


def cells(lines: DataFrame) -> DataFrame:
    """(doc_id, line, cell_start): a new cell starts after a blank line that
    directly follows a statement line (non-blank, not a comment) when the
    next non-blank line starts at column 0."""
    t = F.col("text")
    d = shift_lines(lines.select("doc_id", "line", "text"), ["text"])
    stmt_prev = F.col("prev_text").isNotNull() & ~is_blank(F.col("prev_text")) & \
        ~F.ltrim(F.col("prev_text")).startswith("#")
    d = carry_next(d, F.when(~is_blank(t), indent_of(t) == 0), "_next_col0")
    cut_after = is_blank(t) & stmt_prev & F.coalesce(F.col("_next_col0"), F.lit(False))
    d = d.withColumn("_cut", cut_after)
    # A cut after line b starts a cell at b + 1.
    starts = d.where("_cut").select("doc_id", (F.col("line") + 1).alias("line"), F.lit(True).alias("_start"))
    j = d.select("doc_id", "line").join(starts, ["doc_id", "line"], "left")
    j = carry_last(j, F.when(F.col("_start"), F.col("line")), "_cs", inclusive=True)
    return j.select("doc_id", "line", F.coalesce(F.col("_cs"), F.lit(0)).alias("cell_start"))
