"""Context features (per completion position) and completion features (per
candidate), registered in column order like the reference's feature table.

The cursor sits after the first character of the token being completed, so
the *head* of a position is its line up to and including that character.
Context features are computed once per position and joined to every
candidate of the position (``group_id``) -- never recomputed per candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.functions import text as tx
from linden.functions import similarity as sim
from linden.operators import code
from linden.operators.lookup import BROADCAST_ROWS
from linden.operators.sequence import carry_last, shift_lines
from linden.operators.search import find_matches
from linden.session import materialize, release_shuffles
from linden.sources.views import token_kind

GROUP = ["doc_id", "line", "pos"]

# --- fixed values: context features ----------------------------------------------------
HEAD_PATTERNS = (
    ("for", r"^\s*for\s.*"),
    ("while", r"^\s*while\s.*"),
    ("with", r"^\s*with\s.*"),
    ("if", r"^\s*(if|elif)\s.*"),
    ("except", r"^\s*except\s.*"),
    ("not", r".*\snot\s.*"),
)
# --- fixed values: completion features ---------------------------------------------------
CANDIDATE_TYPES = ("class", "function", "instance", "keyword", "module", "param", "statement")
DATA_TYPES = ("str", "int", "float", "bool", "bytes", "list", "dict", "tuple")
NAME_PATTERNS = (
    ("regex_is", r"^(is|are|IS|ARE).*"),
    ("regex_has", r"^(has|have|HAS|HAVE).*"),
    ("regex_error", r".*Error$"),
    ("regex_starts_with__", r"^_.*"),
    ("regex_starts_with___", r"^__.*"),
)
# An assignment statement "name = value" (not "==").
LITERAL_ASSIGN = r"^\s*([\p{L}_][\p{L}\p{N}_]*)\s*=\s*([^=\s].*)$"
PARAM_NAME = r"([\p{L}_][\p{L}\p{N}_]*)\s*(?:=|,|:|$)"
CALL_NAME = r"([\p{L}_][\p{L}\p{N}_]*)\s*$"


# ---------------------------------------------------------------------------------------
# registry: name -> Column builder, in registration order (= column order)

class FeatureRegistry:
    """Feature generators (name -> Column builder) and context preprocessors
    (DataFrame -> DataFrame stages applied before the generators).  A
    normalised feature is scaled per group after generation; context features
    cannot be normalised (they are constant within a group)."""

    def __init__(self):
        self.context: dict[str, Callable[[], Column]] = {}
        self.completion: dict[str, Callable[[], Column]] = {}
        self.normalized: list[str] = []
        self.preprocessors: list[Callable[[DataFrame], DataFrame]] = []

    def register(self, name: str, is_context: bool = False, normalized: bool = False):
        if is_context and normalized:
            raise ValueError("context features cannot be normalized")
        target = self.context if is_context else self.completion

        def deco(fn):
            target[name] = fn
            if normalized:
                self.normalized.append(name)
            return fn
        return deco

    def preprocessor(self, fn: Callable[[DataFrame], DataFrame]):
        self.preprocessors.append(fn)
        return fn

    def prepare(self, df: DataFrame) -> DataFrame:
        for fn in self.preprocessors:
            df = fn(df)
        return df

    def context_feature(self, name: str):
        def deco(fn):
            self.context[name] = fn
            return fn
        return deco

    def completion_feature(self, name: str):
        def deco(fn):
            self.completion[name] = fn
            return fn
        return deco


REGISTRY = FeatureRegistry()


# ---------------------------------------------------------------------------------------
# positions with their head

def token_starts(lines: DataFrame) -> DataFrame:
    """(doc_id, line, pos, start, t): 0-based start offset of every token."""
    m = find_matches(lines, lx.TOKEN_PATTERN, with_index=True)
    return m.select("doc_id", "line", F.col("i").alias("pos"), "start", F.col("match").alias("t"))


def enclosing_call(head: Column) -> Column:
    """Name before the innermost unclosed ``(`` of ``head`` ('' if none)."""
    chars = F.split(head, "", -1)
    stack = F.aggregate(
        F.transform(chars, lambda ch, i: F.struct(ch.alias("c"), i.alias("i"))),
        F.array().cast("array<int>"),
        lambda acc, x: F.when(x["c"] == "(", F.concat(acc, F.array(x["i"])))
        .when((x["c"] == ")") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(acc),
    )
    open_at = F.get(stack, F.size(stack) - 1)
    before = F.substring(head, F.lit(1), open_at)
    name = F.regexp_extract(before, CALL_NAME, 1)
    return F.when(open_at.isNull(), F.lit("")).otherwise(name)


def positions_with_context(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions joined with their line, head, previous line and the W3/W4
    look-backs; one row per position."""
    starts = token_starts(lines.join(positions.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_semi"))
    p = positions.join(starts.select("doc_id", "line", "pos", "start"), GROUP)
    per_line = code.blank_before(lines).join(code.indent_delta(lines), ["doc_id", "line"])
    per_line = per_line.join(shift_lines(lines.select("doc_id", "line", "text"), ["text"]), ["doc_id", "line"])
    d = p.join(per_line, ["doc_id", "line"])
    return d.withColumn("head", F.substring("text", F.lit(1), F.col("start") + 1)) \
        .withColumn("call", enclosing_call(F.col("head")))


# ---------------------------------------------------------------------------------------
# context features (52)

REGISTRY.context_feature("blank_line_before")(lambda: F.col("blank_line_before"))
REGISTRY.context_feature("line_number")(lambda: F.col("line"))
REGISTRY.context_feature("indent")(lambda: F.col("indent"))
REGISTRY.context_feature("indent_delta")(lambda: F.col("indent_delta"))
REGISTRY.context_feature("at_line_start")(
    lambda: F.when(F.ltrim(F.col("head")) == "", F.lit(1)).otherwise(F.lit(0)))
for _c in lx.LEFT_CHARS:
    REGISTRY.context_feature(f"left_char_is_{_c}")(
        lambda c=_c: F.when(F.instr(F.col("head"), c) > 0, F.lit(1)).otherwise(F.lit(0)))
for _c in lx.LINE_END_CHARS:
    REGISTRY.context_feature(f"last_line_ends_with_{_c}")(
        lambda c=_c: F.when((F.col("line") >= 1) & (F.coalesce(F.length("prev_text"), F.lit(0)) > 0)
                            & (F.substring("prev_text", -1, 1) == c), F.lit(1)).otherwise(F.lit(0)))
for _f in lx.IN_FUNCTION_FEATURES:
    REGISTRY.context_feature(f"in_function_{_f}")(
        lambda f=_f: (F.col("call") == f).cast("int"))
for _n, _rx in HEAD_PATTERNS:
    REGISTRY.context_feature(_n)(lambda rx=_rx: F.col("head").rlike(rx).cast("int"))


def context_features(ctx: DataFrame) -> DataFrame:
    cols = [fn().alias(name) for name, fn in REGISTRY.context.items()]
    return ctx.select(*GROUP, *cols)


# ---------------------------------------------------------------------------------------
# per-document name classes

def name_classes(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, c, ctype, dtype): candidate type by precedence keyword >
    class > function > module > param > statement > instance, and the data
    type of the last literal assignment to the name."""
    outline = code.outline(lines)
    defs = outline.select("doc_id", F.col("name").alias("c"),
                          F.when(F.col("kind") == "class", F.lit(1)).otherwise(F.lit(2)).alias("rank"))
    mods = code.imports(lines).select("doc_id", F.element_at(F.split("module", r"\."), -1).alias("c"),
                                      F.lit(3).alias("rank"))
    params = lines.where(F.col("text").rlike(r"^\s*(async\s+)?def\s")).select(
        "doc_id", F.explode(parameter_names(F.col("text"))).alias("c"), F.lit(4).alias("rank"))
    assigns = lines.where(F.col("text").rlike(LITERAL_ASSIGN)).select(
        "doc_id", F.regexp_extract("text", LITERAL_ASSIGN, 1).alias("c"), F.lit(5).alias("rank"))
    ranks = defs.unionByName(mods).unionByName(params).unionByName(assigns).groupBy("doc_id", "c").agg(
        F.min("rank").alias("rank"))
    names = tokens.where(F.col("kind") == lx.KIND_NAME).select("doc_id", F.col("t").alias("c")).distinct()
    d = names.join(ranks, ["doc_id", "c"], "left")
    lits = lines.where(F.col("text").rlike(LITERAL_ASSIGN)).select(
        "doc_id", F.regexp_extract("text", LITERAL_ASSIGN, 1).alias("c"), "line", literal_type(F.col("text")).alias("dtype"))
    last_lit = lits.groupBy("doc_id", "c").agg(F.max_by("dtype", "line").alias("dtype"))
    return d.join(last_lit, ["doc_id", "c"], "left").select("doc_id", "c", candidate_type(F.col("c"), F.col("rank")).alias("ctype"), "dtype")


def parameter_names(text: Column) -> Column:
    """Names in the brackets of a ``def`` line."""
    return F.regexp_extract_all(F.regexp_extract(text, r"\((.*)\)", 1), F.lit(PARAM_NAME), 1)


def candidate_type(c: Column, rank: Column) -> Column:
    kw = F.array(*[F.lit(k) for k in lx.PY_KEYWORDS])
    return (
        F.when(F.array_contains(kw, c), F.lit("keyword"))
        .when(rank == 1, F.lit("class")).when(rank == 2, F.lit("function"))
        .when(rank == 3, F.lit("module")).when(rank == 4, F.lit("param"))
        .when(rank == 5, F.lit("statement")).otherwise(F.lit("instance"))
    )


def literal_type(text: Column) -> Column:
    """Type of the literal that an assignment line assigns."""
    lit = F.trim(F.regexp_extract(text, LITERAL_ASSIGN, 2))
    return (
        F.when(lit.rlike(r"^[bB]['\"]"), F.lit("bytes"))
        .when(lit.rlike(r"^['\"]"), F.lit("str"))
        .when(lit.rlike(r"^(True|False)$"), F.lit("bool"))
        .when(lit.rlike(r"^\d+$"), F.lit("int"))
        .when(lit.rlike(r"^\d+\.\d*$"), F.lit("float"))
        .when(lit.startswith("["), F.lit("list"))
        .when(lit.startswith("{"), F.lit("dict"))
        .when(lit.startswith("("), F.lit("tuple"))
    )


# ---------------------------------------------------------------------------------------
# look-backs for candidates

def line_blocks(lines: DataFrame, k: int = lx.MAX_SCAN_LINES - 1, block: int = 64) -> DataFrame:
    """(doc_id, _b, lines ARRAY<STRUCT<line, text>>): the lines of each block of
    ``block`` lines in order, led by the last k lines of the block before, so
    every line has the k lines above it in its own block's array.  Each text is
    moved 1 + k / block times, whatever asks for it."""
    near = F.array(F.col("line"), F.col("line") + k)
    b = F.explode(F.array_distinct(F.transform(near, lambda x: F.floor(x / block)))).alias("_b")
    return lines.select("doc_id", b, F.struct("line", "text").alias("_l")).groupBy("doc_id", "_b").agg(
        F.sort_array(F.collect_list("_l")).alias("lines"))


def nth_lines(rows: DataFrame, blocks: DataFrame, outs: dict[str, Callable[[Column], Column]], c: str, block: int = 64) -> DataFrame:
    """``rows`` (doc_id, line, head, ``c``, ...) with a column for each of
    ``outs`` (name -> fold of the compared texts): 0 if ``head`` contains ``c``,
    else how many lines above the nearest of the lines line-1 .. line-19 that
    contains it is (line 0 excluded), 99999 if none does.  A row meets its
    block of lines, not a copy of the lines above it."""
    d = rows.withColumn("_b", F.floor(F.col("line") / block)).join(blocks, ["doc_id", "_b"], "left")
    # Where a line comes more than once, each copy is a line above the next.
    at = F.filter(F.transform("lines", lambda x, i: F.when(x["line"] == F.col("line"), i)), lambda i: i.isNotNull())
    d = d.withColumn("_at", F.explode_outer(at))
    k = lx.MAX_SCAN_LINES - 1
    first = F.greatest(F.col("_at") - k, F.lit(0))
    prev = F.transform(F.reverse(F.filter(F.slice("lines", first + 1, F.col("_at") - first), lambda x: x["line"] >= 1)), lambda x: x["text"])
    keep = [x for x in rows.columns if x not in outs]
    d = d.select(*keep, F.coalesce(prev, F.array().cast("array<string>")).alias("_prev"))
    return d.select(*keep, *[_nth_line(F.col("head"), F.col("_prev"), F.col("line"), F.col(c), fold).alias(name) for name, fold in outs.items()])


def _nth_line(head: Column, prev: Column, line: Column, c: Column, fold) -> Column:
    hit_prev = F.filter(
        F.transform(prev, lambda txt, i: F.when(F.instr(fold(txt), fold(c)) > 0, i + 1)),
        lambda x: x.isNotNull())
    limit = F.least(line, F.lit(lx.MAX_SCAN_LINES))
    first_prev = F.get(F.filter(hit_prev, lambda x: x < limit), 0)
    return (
        F.when(line == 0, F.lit(lx.NOT_FOUND))
        .when(F.instr(fold(head), fold(c)) > 0, F.lit(0))
        .otherwise(F.coalesce(first_prev, F.lit(lx.NOT_FOUND)))
    )


def nearest_before(queries: DataFrame, postings: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Distance from each query row to the latest posting line strictly
    before it with the same ``keys`` (``keys`` include doc_id); 99999 if none."""
    q = queries.select(*GROUP, "c", *[k for k in keys if k not in GROUP], F.lit(0).alias("_flag"))
    p = postings.select(*keys, "line").distinct()
    p = p.select(
        *[F.col(k) for k in keys], "line", F.lit(1).alias("_flag"),
        *[F.lit(None).cast("int").alias(g) for g in GROUP if g not in keys and g != "line"],
        F.lit(None).cast("string").alias("c"),
    )
    u = q.unionByName(p, allowMissingColumns=True)
    # Query rows sort before postings of the same line, so only earlier lines count.
    u = u.withColumn("_o", F.col("line").cast("long") * 2 + F.col("_flag"))
    u = carry_last(u, F.when(F.col("_flag") == 1, F.col("line")), "_prev_line", key=keys, order="_o",
                   block_col=F.floor(F.col("line") / 2048))
    r = u.where(F.col("_flag") == 0).select(*GROUP, "c", F.coalesce(F.col("line") - F.col("_prev_line"),
                                                                     F.lit(lx.NOT_FOUND)).cast("int").alias(out))
    return r


# ---------------------------------------------------------------------------------------
# completion features

for _t in CANDIDATE_TYPES:
    REGISTRY.completion_feature(_t)(lambda t=_t: (F.col("ctype") == t).cast("int"))
for _t in DATA_TYPES:
    REGISTRY.completion_feature(_t)(lambda t=_t: F.coalesce((F.col("dtype") == t).cast("int"), F.lit(0)))
REGISTRY.completion_feature("is_upper_case")(lambda: tx.is_upper(F.col("c")).cast("int"))
REGISTRY.completion_feature("is_lower_case")(lambda: tx.is_lower(F.col("c")).cast("int"))
REGISTRY.completion_feature("is_initial_upper_case")(lambda: tx.is_initial_upper(F.col("c")).cast("int"))
REGISTRY.completion_feature("contains__")(lambda: F.col("c").contains("_").cast("int"))
for _n, _rx in NAME_PATTERNS:
    REGISTRY.completion_feature(_n)(lambda rx=_rx: F.col("c").rlike(rx).cast("int"))
for _w in lx.KEYWORD_FEATURES + lx.BUILTIN_FEATURES:
    REGISTRY.completion_feature(f"kw_{_w}")(lambda w=_w: (F.col("c") == w).cast("int"))
REGISTRY.completion_feature("is_keyword")(
    lambda: F.array_contains(F.array(*[F.lit(k) for k in lx.PY_KEYWORDS]), F.col("c")).cast("int"))
REGISTRY.completion_feature("in_builtin_module")(
    lambda: F.array_contains(F.array(*[F.lit(k) for k in lx.PY_BUILTINS]), F.col("c")).cast("int"))
NTH_LINE = {"contains_in_nth_line": lambda x: x, "contains_in_nth_line_lower": F.lower}
for _m in NTH_LINE:
    REGISTRY.completion_feature(_m)(lambda m=_m: F.col(m))
for _m in ("t1_match", "t2_match", "t3_match", "trigram_match"):
    REGISTRY.completion_feature(_m)(lambda m=_m: F.col(m))
for _m in ("token_frequency", "bigram_frequency", "trigram_frequency"):
    REGISTRY.completion_feature(_m)(lambda m=_m: F.col(m))

# Similarity features: exact re-expressions, checked by unit tests.
# fixed values: lines above that count
LINES_ABOVE = (2, 3, 4, 5, 6)
SIMILARITY_INPUTS = ("line_first", "line_all", "prev_first", "prev_all", "names_above", "arg", "plist")
SIMILARITY_FEATURES = (
    "first_token_ratio", "first_token_partial_ratio", "last_line_first_token_ratio",
    "last_line_first_token_partial_ratio", "last_n_lines_first_token_partial_ratio", "all_token_ratio", "last_line_all_token_ratio",
    "signature_parameter_ratio", "signature_parameter_partial_ratio", "function_ratio", "function_partial_ratio",
)


def active_argument(head: Column) -> Column:
    """Index of the argument being typed inside the innermost open call of
    ``head``: top-level commas after its ``(``; null outside a call."""
    chars = F.split(head, "", -1)
    st = F.aggregate(
        F.transform(chars, lambda ch, i: F.struct(ch.alias("c"), i.alias("i"))),
        F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<int>").alias("commas")),
        lambda acc, x: F.when(x["c"] == "(", F.struct(F.concat(acc["open"], F.array(x["i"])).alias("open"),
                                                      F.concat(acc["commas"], F.array(F.lit(0))).alias("commas")))
        .when((x["c"] == ")") & (F.size(acc["open"]) > 0),
              F.struct(F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0))).alias("open"),
                       F.slice(acc["commas"], 1, F.greatest(F.size(acc["commas"]) - 1, F.lit(0))).alias("commas")))
        .when((x["c"] == ",") & (F.size(acc["open"]) > 0),
              F.struct(acc["open"].alias("open"),
                       F.concat(F.slice(acc["commas"], 1, F.greatest(F.size(acc["commas"]) - 1, F.lit(0))),
                                F.array(F.get(acc["commas"], F.size(acc["commas"]) - 1) + 1)).alias("commas")))
        .otherwise(acc),
    )
    return F.get(st["commas"], F.size(st["commas"]) - 1)


def completion_features(rows: DataFrame) -> DataFrame:
    """One row per candidate with every registered completion feature."""
    return rows.select(*GROUP, "c", "y", *[fn().alias(name) for name, fn in REGISTRY.completion.items()])


def context_inputs(ctx_rows: DataFrame) -> DataFrame:
    """What the context features of a position are computed from."""
    return ctx_rows.select(*GROUP, "blank_line_before", "indent", "indent_delta", "head", "call", F.substring("prev_text", -1, 1).alias("prev_text"))


def feature_matrix(rows: DataFrame) -> DataFrame:
    """Candidates with the completion, similarity and context features.  The
    rows hold what the features are computed from (``candidate_rows``, the
    similarity features or their inputs, and the context of a position); the
    features, many times as wide, are computed behind the joins."""
    completion, context = ([fn().alias(name) for name, fn in fns.items()] for fns in (REGISTRY.completion, REGISTRY.context))
    return rows.select(*GROUP, "c", "y", *completion, *SIMILARITY_FEATURES, *context)


def candidate_rows(cands: DataFrame, lines: DataFrame, tokens: DataFrame, context: DataFrame,
                   ctx_rows: DataFrame) -> DataFrame:
    """One row per candidate with what its completion features are computed
    from, except the frequencies.

    ``context`` = token_context rows (doc_id, line, pos, t0, t1, t2, t3);
    ``ctx_rows`` = positions_with_context rows (head etc.)."""
    pos_ctx = context.select(*GROUP, "t1", "t2", "t3")
    q = cands.join(pos_ctx, GROUP).join(ctx_rows.select(*GROUP, "head"), GROUP)
    q = nth_lines(q, line_blocks(lines), NTH_LINE, "c")
    q = q.drop("head").join(name_classes(lines, tokens), ["doc_id", "c"], "left")
    # The four look-backs and the result read the candidates: written once.
    q = materialize(q, "candidate-context")
    release_shuffles(cands.sparkSession)

    # Postings of (t1,t0), (t2,t0), (t3,t0), (t2,t1,t0) from every token that
    # can be a candidate; a candidate is a name.
    post = context.select("doc_id", "line", "t0", "t1", "t2", "t3").where(token_kind(F.col("t0")) == lx.KIND_NAME)
    post = materialize(post.distinct(), "candidate-postings")

    def distances(*of) -> DataFrame:  # one look-back's shuffle files are gone before the next one begins
        return materialize(nearest_before(*of), "candidate-distances")

    m1 = distances(q.select(*GROUP, "c", F.col("t1").alias("k1"), F.col("c").alias("k0")),
                   post.select("doc_id", F.col("t1").alias("k1"), F.col("t0").alias("k0"), "line"),
                   ["doc_id", "k1", "k0"], "t1_match")
    m2 = distances(q.select(*GROUP, "c", F.col("t2").alias("k1"), F.col("c").alias("k0")),
                   post.select("doc_id", F.col("t2").alias("k1"), F.col("t0").alias("k0"), "line"),
                   ["doc_id", "k1", "k0"], "t2_match")
    m3 = distances(q.select(*GROUP, "c", F.col("t3").alias("k1"), F.col("c").alias("k0")),
                   post.select("doc_id", F.col("t3").alias("k1"), F.col("t0").alias("k0"), "line"),
                   ["doc_id", "k1", "k0"], "t3_match")
    m4 = distances(q.select(*GROUP, "c", F.col("t2").alias("k2"), F.col("t1").alias("k1"), F.col("c").alias("k0")),
                   post.select("doc_id", F.col("t2").alias("k2"), F.col("t1").alias("k1"), F.col("t0").alias("k0"), "line"),
                   ["doc_id", "k2", "k1", "k0"], "trigram_match")
    keys = [*GROUP, "c"]
    q = q.join(m1, keys).join(m2, keys).join(m3, keys).join(m4, keys)
    return q.withColumn("t2_match", F.when(F.col("t2") == "", F.lit(lx.NOT_FOUND)).otherwise(F.col("t2_match"))) \
        .withColumn("t3_match", F.when(F.col("t3") == "", F.lit(lx.NOT_FOUND)).otherwise(F.col("t3_match"))) \
        .withColumn("trigram_match", F.when(F.col("t2") == "", F.lit(lx.NOT_FOUND)).otherwise(F.col("trigram_match")))


def with_frequencies(q: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """Adds the frequencies of a candidate in its context from pruned statistics,
    which go to the rows up to ``BROADCAST_ROWS`` rows and are joined by key beyond."""
    stats = {k: materialize(s, f"pruned-{k}") for k, s in stats.items()}
    stats = {k: F.broadcast(s) if s.count() <= BROADCAST_ROWS else s for k, s in stats.items()}
    uni = stats["token"].select(F.col("t0").alias("c"), F.col("n").alias("_uf"))
    bi = stats["bigram"].select("t1", F.col("t0").alias("c"), F.col("n").alias("_bf"))
    tri = stats["trigram"].select("t2", "t1", F.col("t0").alias("c"), F.col("n").alias("_tf"))
    q = q.join(uni, "c", "left").join(bi, ["t1", "c"], "left").join(tri, ["t2", "t1", "c"], "left")
    return q.withColumn("token_frequency", F.coalesce("_uf", F.lit(0))) \
        .withColumn("bigram_frequency", F.when(F.col("t1") != "", F.coalesce("_bf", F.lit(0))).otherwise(F.lit(0))) \
        .withColumn("trigram_frequency", F.when((F.col("t1") != "") & (F.col("t2") != ""),
                                                F.coalesce("_tf", F.lit(0))).otherwise(F.lit(0)))


def similarity_features(cands: DataFrame, tokens: DataFrame, ctx_rows: DataFrame | None = None,
                        params: DataFrame | None = None, defs: DataFrame | None = None) -> DataFrame:
    """Ratio features of a candidate against:

    * the line's first NAME/STRING token (-2 where the cursor is still in it);
    * the previous line's first NAME/STRING token ('' if none; -1 for line 0);
    * the first NAME tokens ('' if none) of the lines two to six above, the best
      partial ratio (-1 if there is no such line);
    * the NAME/STRING tokens of the line except the one at the cursor, and of
      the previous line, the best ratio (-1 if none)."""
    return similarity_inputs(cands, tokens, ctx_rows, params, defs).select(*GROUP, "c", *similarity_columns())


def similarity_inputs(cands: DataFrame, tokens: DataFrame, ctx_rows: DataFrame | None = None,
                      params: DataFrame | None = None, defs: DataFrame | None = None) -> DataFrame:
    """Candidates with the tokens around their position (``SIMILARITY_INPUTS`` and ``call``)."""
    ns = tokens.where(F.col("kind").isin(lx.KIND_NAME, lx.KIND_STRING))
    firsts = ns.groupBy("doc_id", "line").agg(F.min_by(F.struct("t", "pos"), "pos").alias("first"), F.collect_list(F.struct("t", "pos")).alias("all_t"),
                                              F.min_by(F.when(F.col("kind") == lx.KIND_NAME, F.lower("t")),
                                                       F.when(F.col("kind") == lx.KIND_NAME, F.col("pos"))).alias("name"))
    own = firsts.select("doc_id", "line", F.col("first").alias("line_first"), F.col("all_t").alias("line_all"))
    prev = firsts.select("doc_id", (F.col("line") + 1).alias("line"), F.col("first.t").alias("prev_first"),
                         F.transform("all_t", lambda x: x.t).alias("prev_all"))
    above = firsts.where("name is not null").select("doc_id", F.explode(F.array(*[F.col("line") + k for k in LINES_ABOVE])).alias("line"), "name") \
        .groupBy("doc_id", "line").agg(F.collect_set("name").alias("names_above"))
    d = cands.join(own, ["doc_id", "line"]).join(prev, ["doc_id", "line"], "left").join(above, ["doc_id", "line"], "left")
    if ctx_rows is not None:
        d = d.join(ctx_rows.select(*GROUP, "call", active_argument(F.col("head")).alias("arg")), GROUP, "left")
    else:
        d = d.withColumn("call", F.lit("")).withColumn("arg", F.lit(None).cast("int"))
    if params is not None and defs is not None:
        # The callee's parameters: the first def of that name in the document.
        first_def = defs.where(F.col("kind") != "class").groupBy("doc_id", F.col("name").alias("call")).agg(
            F.min("line").alias("def_line"))
        plist = params.groupBy("doc_id", F.col("line").alias("def_line")).agg(
            F.sort_array(F.collect_list(F.struct("i", "param"))).alias("plist"))
        callee = first_def.join(plist, ["doc_id", "def_line"], "left")
        d = d.join(callee.select("doc_id", "call", F.coalesce("plist", F.array().cast(
            "array<struct<i:int,param:string>>")).alias("plist")), ["doc_id", "call"], "left")
    else:
        d = d.withColumn("plist", F.lit(None).cast("array<struct<i:int,param:string>>"))
    return d


def with_similarity(rows: DataFrame) -> DataFrame:
    """Candidates with their similarity features instead of the inputs of these."""
    kept = [x for x in rows.columns if x not in SIMILARITY_INPUTS]
    return rows.select(*kept, *similarity_columns())


def similarity_columns() -> list[Column]:
    """The similarity features of a candidate ``c`` from the tokens around its position."""
    cur_first = F.when(F.col("line_first.pos") < F.col("pos"), F.col("line_first.t"))
    c = F.col("c")
    pf = F.coalesce(F.col("prev_first"), F.lit(""))
    no_prev = F.col("line") == 0
    return [
        F.when(cur_first.isNull(), F.lit(lx.INSIDE_FIRST_TOKEN)).otherwise(sim.ratio(cur_first, c)).alias("first_token_ratio"),
        F.when(cur_first.isNull(), F.lit(lx.INSIDE_FIRST_TOKEN)).otherwise(
            sim.partial_ratio(F.lower(cur_first), F.lower(c))).alias("first_token_partial_ratio"),
        F.when(no_prev, F.lit(-1)).otherwise(sim.ratio(pf, c)).alias("last_line_first_token_ratio"),
        F.when(no_prev, F.lit(-1)).otherwise(sim.partial_ratio(F.lower(pf), F.lower(c))).alias(
            "last_line_first_token_partial_ratio"),
        F.when(F.col("line") < min(LINES_ABOVE), F.lit(-1)).otherwise(F.coalesce(F.array_max(F.transform(
            "names_above", lambda t: sim.partial_ratio(t, F.lower(c)))), F.lit(0))).alias("last_n_lines_first_token_partial_ratio"),
        F.coalesce(F.array_max(F.transform(F.filter("line_all", lambda x: x.pos != F.col("pos")), lambda x: sim.ratio(x.t, c))), F.lit(-1)).alias("all_token_ratio"),
        F.when(no_prev | F.col("prev_all").isNull(), F.lit(-1)).otherwise(
            F.array_max(F.transform("prev_all", lambda t: sim.ratio(t, c)))).alias("last_line_all_token_ratio"),
        *_signature_cols(c),
    ]


def _signature_cols(c: Column) -> list[Column]:
    no_call = (F.coalesce(F.col("call"), F.lit("")) == "") | F.col("plist").isNull()
    param = F.get(F.col("plist"), F.col("arg"))["param"]
    sig = lambda f: F.when(no_call, F.lit(-1)).when(param.isNull(), F.lit(-2)).otherwise(f)
    has_call = F.coalesce(F.col("call"), F.lit("")) != ""
    return [
        sig(sim.ratio(c, param)).alias("signature_parameter_ratio"),
        sig(sim.partial_ratio(F.lower(c), F.lower(param))).alias("signature_parameter_partial_ratio"),
        F.when(has_call, sim.ratio(c, F.col("call"))).otherwise(F.lit(-1)).alias("function_ratio"),
        F.when(has_call, sim.partial_ratio(c, F.col("call"))).otherwise(F.lit(-1)).alias("function_partial_ratio"),
    ]
