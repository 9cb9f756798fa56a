"""Block-level text operators: signatures, dedent, sections, reflow, first
tokens, lint ordering.  Per-row work uses array expressions; look-backs
within a document use the blocked carry or exact-offset joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions.similarity import bound
from linden.operators import code
from linden.operators.sequence import carry_last
from linden.sources import views

# --- fixed values ----------------------------------------------------------------------
OPENING = "([{"
CLOSING = ")]}"
SKIPPED_FIRST_PARAM = "self"
DEF_LINE = r"^\s*(async\s+)?def\s"
PARAM_NAME_HEAD = r"^[^\s,=:]*"  # a name ends before whitespace , = :
HEADING_SPLIT = r"<h[1-6][^>]*>"
HEADING_TEXT = r"^(.*?)</h[1-6]>"
ROLE_PATTERN = r"[\p{L}\p{N}_]*:[\p{L}\p{N}_]+:`"
WRAP_RATIO = 0.7
DOCTEST_PREFIX = ">>>"
FIRST_NAME_LOOKBACK = (2, 3, 4, 5, 6)


def _param_parts(text: Column) -> Column:
    """Raw top-level items inside the first bracket pair of ``text``."""
    init = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"),
                    F.lit(False).alias("done"))

    def step(acc, ch):
        d, cur, parts, done = acc["d"], acc["cur"], acc["parts"], acc["done"]
        is_open = F.lit(OPENING).contains(ch)
        is_close = F.lit(CLOSING).contains(ch)
        return (
            F.when(done, acc)
            .when(is_open & (d == 0), F.struct(F.lit(1).alias("d"), cur.alias("cur"), parts.alias("parts"), done.alias("done")))
            .when(is_open, F.struct((d + 1).alias("d"), F.concat(cur, ch).alias("cur"), parts.alias("parts"), done.alias("done")))
            .when(is_close & (d == 1), F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"),
                                                F.concat(parts, F.array(cur)).alias("parts"), F.lit(True).alias("done")))
            .when(is_close & (d > 1), F.struct((d - 1).alias("d"), F.concat(cur, ch).alias("cur"), parts.alias("parts"), done.alias("done")))
            .when((ch == ",") & (d == 1), F.struct(d.alias("d"), F.lit("").alias("cur"),
                                                   F.concat(parts, F.array(cur)).alias("parts"), done.alias("done")))
            .when(d >= 1, F.struct(d.alias("d"), F.concat(cur, ch).alias("cur"), parts.alias("parts"), done.alias("done")))
            .otherwise(acc)
        )

    return F.aggregate(F.split(text, "", -1), init, step, lambda acc: acc["parts"])


def signature_params(lines: DataFrame) -> DataFrame:
    """(doc_id, line, i, param) for ``def`` lines: top-level items of the
    first bracket pair; a leading ``self,`` is skipped; the name ends before
    whitespace / ``,`` / ``=`` / ``:`` and ``*`` is removed."""
    d = lines.where(F.col("text").rlike(DEF_LINE)).select("doc_id", "line", F.explode(parameters(F.col("text"))).alias("p"))
    return d.select("doc_id", "line", "p.i", "p.param")


def parameters(text: Column) -> Column:
    """ARRAY<STRUCT<i, param>>: the parameters of a ``def`` line."""
    def of(raw):
        skip_self = (F.get(raw, 0) == SKIPPED_FIRST_PARAM) & (F.size(raw) > 1)
        parts = F.transform(F.when(skip_self, F.slice(raw, 2, 1 << 20)).otherwise(raw), lambda p, i: F.struct(i.alias("i"), F.trim(p).alias("p")))
        return F.transform(F.filter(parts, lambda x: x["p"] != ""), lambda x: F.struct(x["i"].alias("i"), name(x["p"]).alias("param")))

    def name(p):
        head = F.regexp_extract(p, PARAM_NAME_HEAD, 0)
        return F.regexp_replace(F.when(head == "", p).otherwise(head), r"\*", "")

    return bound(_param_parts(text), of)


def dedent_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, item_line, line, text): the body of every outline item,
    dedented by the indent of its first line, ending at the first shallower
    non-blank line (blank lines kept); a body whose first line has no indent
    is kept as is.  Bodies end at the next outline item."""
    items = code.outline(lines).select("doc_id", "line", F.lit(True).alias("_item"))
    d = lines.select("doc_id", "line", "text").join(items, ["doc_id", "line"], "left")
    d = carry_last(d, F.when(F.col("_item"), F.col("line")), "item_line")
    d = d.where(F.col("item_line").isNotNull() & F.col("_item").isNull())
    first = lines.select("doc_id", (F.col("line") - 1).alias("item_line"),
                         code.indent_of(F.col("text")).alias("amount"))
    d = d.join(first, ["doc_id", "item_line"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)))
    ind = code.indent_of(F.col("text"))
    stop = (~code.is_blank(F.col("text"))) & (ind < F.col("amount"))
    d = carry_last(d, F.when(stop, F.col("line")), "_stop", key=["doc_id", "item_line"], inclusive=True)
    d = d.where(F.col("_stop").isNull())
    return d.select("doc_id", "item_line", "line", _dedented().alias("text"))


def dedent_arrays(docs: DataFrame) -> DataFrame:
    """``dedent_blocks`` of documents (doc_id, codes): an item's body is the
    slice of its document's lines up to the next item, nothing is shuffled."""
    items = F.transform("codes", lambda x, i: F.when(x.rlike(code.OUTLINE_PATTERN), i))
    d = docs.select("doc_id", "codes", F.filter(items, lambda i: i.isNotNull()).alias("items"))
    bodies = F.transform("items", lambda a, j: F.struct(
        a.alias("item_line"), F.slice("codes", a + 2, F.coalesce(F.get(F.col("items"), j + 1), F.size("codes")) - a - 1).alias("body")))
    d = d.select("doc_id", F.explode(bodies).alias("b")).select("doc_id", "b.*")
    d = d.withColumn("amount", F.coalesce(code.indent_of(F.get("body", 0)), F.lit(0)))
    stops = F.transform("body", lambda x: ~code.is_blank(x) & (code.indent_of(x) < F.col("amount")))
    d = d.withColumn("_stop", F.array_position(stops, True).cast("int"))
    kept = F.when(F.col("_stop") == 0, F.col("body")).otherwise(F.slice("body", 1, F.greatest(F.col("_stop") - 1, F.lit(0))))
    d = d.select("doc_id", "item_line", "amount", F.posexplode(kept).alias("_i", "text"))
    return d.select("doc_id", "item_line", (F.col("item_line") + 1 + F.col("_i")).alias("line"), _dedented().alias("text"))


def _dedented() -> Column:
    return F.when(code.is_blank(F.col("text")) | (F.col("amount") == 0), F.col("text")).otherwise(
        F.substring("text", F.col("amount") + 1, 1 << 30))


def dedent_code(documents: DataFrame) -> DataFrame:
    """``dedent_blocks`` of the code lines of documents (doc_id, text)."""
    whole, rest = views.whole_documents(documents)
    found = dedent_arrays(views.code_line_arrays(whole))
    return found if rest is None else found.unionByName(dedent_blocks(views.code_lines(views.lines(rest))))


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, section_no, heading, n_chars, n_links, n_roles): a page cut
    at heading tags; section 0 is the text before the first heading."""
    d = pages.select("page_id", F.posexplode(F.split("html", HEADING_SPLIT, -1)).alias("section_no", "body"))
    return d.select(
        "page_id", "section_no",
        F.regexp_extract("body", HEADING_TEXT, 1).alias("heading"),
        F.length("body").alias("n_chars"),
        F.size(F.regexp_extract_all("body", F.lit("<a "), 0)).alias("n_links"),
        F.size(F.regexp_extract_all("body", F.lit(ROLE_PATTERN), 0)).alias("n_roles"),
    )


def reflow(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, para, text): lines (trimmed) that look wrapped -- at least 70%
    of the widest line minus one, and overflowing with the next line's first
    word -- are joined with the following lines; ``>>>`` lines are never
    joined onto.  One document per row: array expressions, no shuffle."""
    lines = F.transform(F.split(F.col(text), r"\r?\n", -1), lambda x: F.trim(x))
    d = docs.select(key, lines.alias("ls"))
    width = F.array_max(F.transform("ls", lambda x: F.length(x))) - 1
    n = F.size("ls")

    def wrapped(x, i):
        nxt = F.get(F.col("ls"), i + 1)
        sp = F.instr(nxt, " ") - 1
        word = F.when(sp < 0, F.length(nxt)).otherwise(sp)
        return (i < n - 1) & (F.length(x) >= width * F.lit(WRAP_RATIO)) & \
            (F.length(x) + word >= width) & ~F.coalesce(nxt.startswith(DOCTEST_PREFIX), F.lit(False))

    flags = F.transform("ls", lambda x, i: F.struct(x.alias("l"), wrapped(x, i).alias("w")))
    init = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("tmp"))
    paras = F.aggregate(
        flags, init,
        lambda acc, f: F.when(f["w"], F.struct(acc["out"].alias("out"), F.concat(acc["tmp"], F.array(f["l"])).alias("tmp")))
        .otherwise(F.struct(F.concat(acc["out"], F.array(F.array_join(F.concat(acc["tmp"], F.array(f["l"])), " "))).alias("out"),
                            F.array().cast("array<string>").alias("tmp"))),
        lambda acc: acc["out"],
    )
    return d.select(key, F.posexplode(paras).alias("para", "text"))


def first_tokens(tokens: DataFrame) -> DataFrame:
    """(doc_id, line, first_token, last_line_first_token, first_name_2 ..
    first_name_6): first NAME/STRING token of the line and of line-1, and the
    first NAME token of lines line-2 .. line-6 (exact offsets: equi-joins)."""
    ns = tokens.where(F.col("kind").isin(lx.KIND_NAME, lx.KIND_STRING)).groupBy("doc_id", "line").agg(
        F.min_by("t", "pos").alias("first_token"))
    nm = tokens.where(F.col("kind") == lx.KIND_NAME).groupBy("doc_id", "line").agg(
        F.min_by("t", "pos").alias("first_name"))
    lines = tokens.select("doc_id", "line").distinct()
    d = lines.join(ns, ["doc_id", "line"], "left")
    prev = ns.select("doc_id", (F.col("line") + 1).alias("line"), F.col("first_token").alias("last_line_first_token"))
    d = d.join(prev, ["doc_id", "line"], "left")
    for k in FIRST_NAME_LOOKBACK:
        d = d.join(nm.select("doc_id", (F.col("line") + k).alias("line"), F.col("first_name").alias(f"first_name_{k}")),
                   ["doc_id", "line"], "left")
    return d


def lint_rows(events: DataFrame) -> DataFrame:
    """Lint-like rows replayed from ``events``: (doc_id, line, col, seq, msg)."""
    return events.select(
        F.col("user_id").alias("doc_id"),
        F.get_json_object("props", "$.k").try_cast("int").alias("line"),
        F.floor("value").try_cast("int").alias("col"),
        F.col("event_id").alias("seq"),
        F.concat(F.col("event_type"), F.lit("\n"), F.col("props")).alias("msg"),
    )


def lint_order(lints: DataFrame) -> DataFrame:
    """Lints sorted by (doc, line, column, seq) with the message split at its
    first newline when that newline is not the first character.  The sort is
    a range-partitioned global sort."""
    i = F.instr("msg", "\n") - 1
    title = F.when(i > 0, F.substring("msg", F.lit(1), i)).otherwise(F.col("msg"))
    detail = F.when(i > 0, F.substring("msg", i + 2, 1 << 30)).otherwise(F.lit(""))
    return lints.select("doc_id", "line", "col", "seq", title.alias("title"), detail.alias("detail")) \
        .orderBy("doc_id", "line", "col", "seq")
