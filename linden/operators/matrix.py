"""Completion positions and candidates of whole documents, with all that their
features are computed from, without a shuffle.

A document is one row.  Its names, sorted with where they occur and what they
are declared as, stand in runs; the runs with the same first letter are what a
position of that letter chooses from.  A position takes its lines, its context
and those names along, and a candidate is an element of them.  Documents with
a repeated or null id, a very long text or very many lines take the joins of
``features`` instead: within a document the work of a name grows with the
square of its occurrences, which ``MOST_LINES`` bounds.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions.similarity import bound
from linden.operators import blocks, code
from linden.operators import features as ft
from linden.operators.ngrams import contexts
from linden.operators.sequence import last_before
from linden.sources import views

MOST_LINES = 1 << 14
NAME = r"^[\p{L}_]"
POSITION = r"^[\p{L}\p{N}]"
OCCURS, DECLARED, ASSIGNED = 0, 1, 2

# columns of a position that its candidates carry
POSITION_COLUMNS = ("doc_id", "line", "pos", "t", "t1", "t2", "t3")
CONTEXT_INPUTS = ("head", "prev_text", "blank_line_before", "indent", "indent_delta", "call")


def _entry(c: Column, tag: int, line: Column, pos: Column | None = None, *ts: Column) -> Column:
    ts = (*ts, *[F.lit(None).cast("string")] * (3 - len(ts)))
    return F.struct(c.alias("c"), F.lit(tag).alias("tag"), line.cast("int").alias("line"), (F.lit(0) if pos is None else pos).alias("pos"),
                    *[t.alias(f"t{k}") for k, t in enumerate(ts, 1)])


def _if(condition: Column, entries: Column) -> Column:
    return F.when(condition, entries).otherwise(F.array().cast(ENTRIES))


ENTRIES = "array<struct<c:string,tag:int,line:int,pos:int,t1:string,t2:string,t3:string>>"


def _declarations(s: Column, line: Column) -> Column:
    """What a line declares: names with their rank, and the type of a literal."""
    of = lambda rank: lambda c: _entry(c, DECLARED, F.lit(rank))
    part = lambda k: F.regexp_extract(s, code.OUTLINE_PATTERN, k)
    is_class = (part(2) == "") & (part(3) == "class")
    assigned = F.regexp_extract(s, ft.LITERAL_ASSIGN, 1)
    return F.concat(
        _if(s.rlike(code.OUTLINE_PATTERN), F.array(_entry(part(4), DECLARED, F.when(is_class, F.lit(1)).otherwise(F.lit(2))))),
        _if(s.rlike(code.IMPORT_LINE_PATTERN), F.transform(code.import_modules(s), lambda m: of(3)(F.element_at(F.split(m["module"], r"\."), -1)))),
        _if(s.rlike(blocks.DEF_LINE), F.transform(ft.parameter_names(s), of(4))),
        _if(s.rlike(ft.LITERAL_ASSIGN), F.array(of(5)(assigned), _entry(assigned, ASSIGNED, line, None, ft.literal_type(s)))))


def _runs(rows: str, key) -> Column:
    """Slices of the array column ``rows`` with equal ``key``, which are adjacent."""
    a = F.col(rows)
    starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(a, i - 1))), i)), lambda i: i.isNotNull())
    return bound(starts, lambda at: F.transform(at, lambda b, k: F.slice(a, b + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - b)))


def _name(run: Column) -> Column:
    """A name of a document: where it occurs, its best rank, the type of the last literal assigned to it."""
    of = lambda tag: F.filter(run, lambda x: x["tag"] == tag)
    occurs = F.transform(of(OCCURS), lambda x: F.struct(*[x[k].alias(k) for k in ("line", "pos", "t1", "t2", "t3")]))
    return F.struct(F.get(run, 0)["c"].alias("c"), F.get(of(DECLARED), 0)["line"].alias("rank"),
                    bound(of(ASSIGNED), lambda x: F.get(x, F.size(x) - 1)["t1"]).alias("dtype"), occurs.alias("at"))


def _names(docs: DataFrame) -> DataFrame:
    """(doc_id, codes, toks, groups): the names of a document (sorted by name),
    an array for each first letter."""
    d = docs.select("doc_id", "codes", F.transform("codes", views.line_tokens).alias("toks"))
    occurs = F.transform(F.filter(contexts(F.col("toks")), lambda x: x["t0"].rlike(NAME)),
                         lambda x: _entry(x["t0"], OCCURS, x["line"], x["pos"], x["t1"], x["t2"], x["t3"]))
    declared = F.flatten(F.transform("codes", _declarations))
    d = d.select("doc_id", "codes", "toks", F.sort_array(F.concat(occurs, declared)).alias("_e"))
    names = F.filter(F.transform(_runs("_e", lambda x: x["c"]), _name), lambda n: F.size(n["at"]) > 0)
    d = d.select("doc_id", "codes", "toks", names.alias("_n"))
    return d.select("doc_id", "codes", "toks", _runs("_n", lambda n: F.substring(n["c"], 1, 1)).alias("groups"))


def _start(text: Column, toks: Column, pos: Column) -> Column:
    """0-based start of token ``pos``: only white space stands between tokens."""
    init = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(acc, t):
        return bound(F.call_function("locate", t, text, acc["end"] + 1) - 1, lambda at: F.struct(at.alias("start"), (at + F.length(t)).alias("end")))

    return F.aggregate(F.slice(toks, 1, pos + 1), init, step, lambda acc: acc["start"])


def _line_values(docs: DataFrame) -> DataFrame:
    """Adds what positions take from lines: the non-empty line before each
    (``_ne``), the last one that is not blank (``_nb``), each line's first name
    (``_first``), the functions that are defined (``_defs``) and the lines in
    lower case (``_low``)."""
    n = F.size("codes")
    kept = lambda x: F.filter(x, lambda i: i.isNotNull())
    ne = kept(F.transform("codes", lambda s, i: F.when(s != "", i)))
    nb = kept(F.transform("codes", lambda s, i: F.when(~code.is_blank(s) & (i >= 1), i)))
    first = F.transform("toks", lambda ts: F.lower(F.get(F.filter(ts, lambda t: t.rlike(NAME)), 0)))
    kind = lambda s: F.when(F.regexp_extract(s, code.OUTLINE_PATTERN, 2) != "", F.lit("async")).otherwise(F.regexp_extract(s, code.OUTLINE_PATTERN, 3))
    params = lambda s: F.when(s.rlike(blocks.DEF_LINE), blocks.parameters(s)).otherwise(F.array().cast("array<struct<i:int,param:string>>"))
    defs = F.filter(F.transform("codes", lambda s: F.when(s.rlike(code.OUTLINE_PATTERN) & (kind(s) != "class"), F.struct(
        F.regexp_extract(s, code.OUTLINE_PATTERN, 4).alias("name"), params(s).alias("plist")))), lambda x: x.isNotNull())
    return docs.select("*", F.transform("codes", F.lower).alias("_low"), last_before(ne, n).alias("_ne"), last_before(nb, n).alias("_nb"), first.alias("_first"), defs.alias("_defs"))


def _marked(ts: Column) -> Column:
    """The NAME and STRING tokens of a line's tokens, with their places."""
    kinds = (lx.KIND_NAME, lx.KIND_STRING)
    return F.filter(F.transform(ts, lambda t, k: F.struct(t.alias("t"), k.alias("pos"))), lambda x: views.token_kind(x["t"]).isin(*kinds))


def positions(docs: DataFrame) -> DataFrame:
    """A row for each completion position of the documents (doc_id, codes) whose
    own token was seen on an earlier line, with the document's names of its
    first letter, the lines above it and what its features are computed from."""
    d = _line_values(_names(docs))

    def of_name(names, n):
        is_position = (F.length(n["c"]) >= 2) & n["c"].rlike(POSITION)
        seen = F.when(is_position, F.filter(n["at"], lambda o: o["line"] > F.get(n["at"], 0)["line"])).otherwise(F.slice(n["at"], 1, 0))
        return F.transform(seen, lambda o: F.struct(n["c"].alias("t"), o.alias("o"), names.alias("names"), *at_line(o["line"])))

    def at_line(line):
        above = F.greatest(line - (lx.MAX_SCAN_LINES - 1), F.lit(1))
        get = lambda c, i: F.get(F.col(c), i)
        return (
            get("codes", line).alias("text"), get("codes", line - 1).alias("prev_text"), get("toks", line).alias("toks"), get("toks", line - 1).alias("prev_toks"),
            *[F.array_join(F.reverse(F.slice(c, above + 1, F.greatest(line - above, F.lit(0)))), "\n").alias(out) for c, out in (("codes", "prev"), ("_low", "prev_lower"))],
            get("_nb", line).alias("nb"),
            get("codes", get("_ne", line)).alias("before"), F.array(*[get("_first", line - k) for k in ft.LINES_ABOVE]).alias("above"))

    found = F.flatten(F.transform("groups", lambda names: F.flatten(F.transform(names, lambda n: of_name(names, n)))))
    p = d.select("doc_id", "_defs", F.explode(found).alias("p")).select("doc_id", "_defs", "p.o.*", "p.*").drop("o")
    p = p.withColumn("head", F.substring("text", F.lit(1), _start(F.col("text"), F.col("toks"), F.col("pos")) + 1))
    opened = F.instr("head", "(") > 0
    p = p.withColumn("call", F.when(opened, ft.enclosing_call(F.col("head"))).otherwise(F.lit("")))
    indent = code.indent_of(F.col("text"))
    blank = F.when(F.col("line") <= 1, F.lit(0)).otherwise(F.col("line") - 1 - F.greatest("nb", F.lit(0)))
    p = p.withColumn("line_all", _marked(F.col("toks"))).withColumn("prev_marked", _marked(F.col("prev_toks")))
    return p.select(
        "doc_id", "line", "pos", "t", "t1", "t2", "t3", "head", F.substring("prev_text", -1, 1).alias("prev_text"), "names", "prev", "prev_lower",
        blank.alias("blank_line_before"), indent.alias("indent"), (indent - F.coalesce(code.indent_of(F.col("before")), F.lit(0))).alias("indent_delta"), "call",
        F.get("line_all", 0).alias("line_first"), "line_all", F.get("prev_marked", 0)["t"].alias("prev_first"),
        F.when(F.size("prev_marked") > 0, F.transform("prev_marked", lambda x: x["t"])).alias("prev_all"),
        F.filter("above", lambda x: x.isNotNull()).alias("names_above"), F.when(opened, ft.active_argument(F.col("head"))).alias("arg"),
        F.when(F.col("call") != "", F.get(F.filter("_defs", lambda x: x["name"] == F.col("call")), 0)["plist"]).alias("plist"))


def _distance(occurs: Column, keys: tuple[str, ...]) -> Column:
    """Lines back to the last of ``occurs`` whose tokens ``keys`` are those of the position."""
    def here(o):
        return reduce(and_, [o[k] == F.col(k) for k in keys])

    last = F.array_max(F.transform(F.filter(occurs, here), lambda o: o["line"]))
    return F.coalesce(F.col("line") - last, F.lit(lx.NOT_FOUND)).cast("int")


def candidates(positions: DataFrame, matrix: bool = False) -> DataFrame:
    """A row for each candidate of each position: what ``features.candidate_rows``
    gives and, with ``matrix``, what the context and similarity features are
    computed from."""
    return offered_rows(positions, _offered(), matrix)


def position_context(positions: DataFrame) -> DataFrame:
    """Positions with their candidates (``offered``) instead of the document's
    names and the lines above: what a matrix needs of them, narrow enough to write."""
    return positions.select(*POSITION_COLUMNS, *CONTEXT_INPUTS, *ft.SIMILARITY_INPUTS, _offered().alias("offered"))


def offered_rows(positions: DataFrame, offered: Column, matrix: bool = False) -> DataFrame:
    more = (*CONTEXT_INPUTS, *ft.SIMILARITY_INPUTS) if matrix else ()
    d = positions.select(*POSITION_COLUMNS, *more, F.explode(offered).alias("n")).select(*POSITION_COLUMNS, *more, "n.*")
    return d.withColumn("y", (F.col("c") == F.col("t")).cast("int")).withColumn("ctype", ft.candidate_type(F.col("c"), F.col("rank"))).drop("rank")


def _offered() -> Column:
    """The candidates of a position."""
    line = F.col("line")

    def nth(texts: str, c: Column, head: Column) -> Column:
        # the lines above stand in one text, the nearest first: the first hit is in as many lines' distance as line ends are before it
        above = bound(F.substring(F.col(texts), F.lit(1), F.instr(texts, c)), lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1)
        return F.when(line == 0, F.lit(lx.NOT_FOUND)).when(head.contains(c), F.lit(0)).when(F.col(texts).contains(c), above).otherwise(F.lit(lx.NOT_FOUND))

    def of_name(n, before):
        far = lambda when, *keys: F.when(when, _distance(before, keys)).otherwise(F.lit(lx.NOT_FOUND))
        return F.struct(
            n["c"].alias("c"), n["rank"].alias("rank"), n["dtype"].alias("dtype"), nth("prev", n["c"], F.col("head")).alias("contains_in_nth_line"),
            bound(F.lower(n["c"]), lambda c: nth("prev_lower", c, F.lower("head"))).alias("contains_in_nth_line_lower"),
            far(F.lit(True), "t1").alias("t1_match"), far(F.col("t2") != "", "t2").alias("t2_match"), far(F.col("t3") != "", "t3").alias("t3_match"),
            far(F.col("t2") != "", "t2", "t1").alias("trigram_match"))

    earlier = lambda n: F.filter(n["at"], lambda o: o["line"] < line)
    return F.transform(F.filter("names", lambda n: F.get(n["at"], 0)["line"] < line), lambda n: bound(earlier(n), lambda before: of_name(n, before)))
