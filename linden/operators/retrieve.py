"""Word segmentation, extra predictions and the final candidate ranking.

Segmentation is an exact unigram Viterbi: every substring of a part is looked
up in the vocabulary with one equi-join (parts are de-duplicated first), and
the best split is a dynamic program over the part's own substring scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import similarity as sim
from linden.functions.similarity import bound
from linden.operators import dictionary as dct
from linden.operators import lookup
from linden.sources import views

# --- fixed values: prediction sources -------------------------------------------------------
UNKNOWN_WORD_MASS = 10.0       # unknown word probability: 10 / (N * 10^len)
WORD_SCORE_BASE = 990          # dictionary words score 990 - rank
TOKEN_SCORE_BASE = 980         # document tokens score 980 - rank
SEGMENT_SCORE = 1
MIN_RESULTS = 6                # segmentation is added only below this count
TYPED_LEN = 3
SORT_SCORE_FACTOR = 10


def segment_parts(parts: DataFrame, vocab: DataFrame, col: str = "part") -> DataFrame:
    """(part, words ARRAY<STRING>): best unigram segmentation of each distinct
    part (lower-case letters/digits).  Ties go to the longer last word."""
    total = vocab.select(F.sum("f")).scalar()
    p = parts.select(F.col(col).alias("part")).where(F.length("part") > 0).distinct()
    n = F.length("part")
    subs = p.select("part", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(1), n),
        lambda j: F.transform(F.sequence(F.lit(0), j - 1),
                              lambda i: F.struct(i.alias("i"), j.alias("j"), F.substring("part", i + 1, j - i).alias("w")))
    ))).alias("s")).select("part", "s.i", "s.j", "s.w")
    known = vocab.select("w", F.ln(F.col("f") / total).alias("_lp"))
    unknown = F.ln(F.lit(UNKNOWN_WORD_MASS) / (total * F.pow(F.lit(10.0), F.length("w"))))
    scored = subs.join(known, "w", "left").withColumn("s", F.coalesce("_lp", unknown))
    per_part = scored.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("j", "i", "s"))).alias("cells"))
    init = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("back"))

    def step(acc, e):
        cand = F.get(acc["best"], e["i"]) + e["s"]
        first = F.size(acc["best"]) == e["j"]
        keep_best = F.slice(acc["best"], 1, e["j"])
        keep_back = F.slice(acc["back"], 1, e["j"])
        better = cand > F.get(acc["best"], e["j"])
        return (
            F.when(first, F.struct(F.concat(acc["best"], F.array(cand)).alias("best"),
                                   F.concat(acc["back"], F.array(e["i"])).alias("back")))
            .when(better, F.struct(F.concat(keep_best, F.array(cand)).alias("best"),
                                   F.concat(keep_back, F.array(e["i"])).alias("back")))
            .otherwise(acc)
        )

    dp = per_part.select("part", F.aggregate("cells", init, step)["back"].alias("back"))

    def walk(acc, _):
        pos = acc["pos"]
        i = F.get(F.col("back"), pos)
        return F.when(pos > 0, F.struct(i.alias("pos"), F.concat(
            F.array(F.substring(F.col("part"), i + 1, pos - i)), acc["words"]).alias("words"))).otherwise(acc)

    words = F.aggregate(F.sequence(F.lit(1), F.length("part")),
                        F.struct(F.length("part").alias("pos"), F.array().cast("array<string>").alias("words")),
                        walk)["words"]
    return dp.select("part", words.alias("words"))


def snake_of(text: Column) -> Column:
    """Parts of a typed text split on ``_`` (empty parts kept)."""
    return F.split(text, "_", -1)


def extra_predictions(positions: DataFrame, tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, line, pos, c, source, s): extra predictions for the typed text
    (first three characters of the token): dictionary words (990 - rank),
    then document tokens by distance (980 - rank), then -- only while fewer
    than six results -- the segmented text joined with ``_`` (score 1).  A
    prediction already produced by an earlier source is not repeated."""
    typed = positions.where(F.length("t") > TYPED_LEN).select(
        "doc_id", "line", "pos", F.substring("t", 1, TYPED_LEN).alias("text"))
    top = dct.prefix_top(vocab).select(F.col("p").alias("text"), F.col("w").alias("c"), "rank")
    words = typed.join(top, "text").select("doc_id", "line", "pos", "c",
                                          F.lit("word").alias("source"), (WORD_SCORE_BASE - F.col("rank") + 1).alias("s"),
                                          F.lit(0).alias("prio"))
    idx = lookup.prefix_index(tokens).select("doc_id", F.col("t").alias("c"), F.col("line").alias("l"),
                                            F.substring("t", 1, TYPED_LEN).alias("text"))
    near = typed.join(idx, ["doc_id", "text"]).groupBy("doc_id", "line", "pos", "c").agg(
        F.min(F.abs(F.col("l") - F.col("line"))).alias("dist"))
    w = Window.partitionBy("doc_id", "line", "pos").orderBy("dist", "c")
    toks = near.withColumn("r", F.row_number().over(w)).select(
        "doc_id", "line", "pos", "c", F.lit("token").alias("source"), (TOKEN_SCORE_BASE - F.col("r") + 1).alias("s"),
        F.lit(1).alias("prio"))
    both = words.unionByName(toks)
    wf = Window.partitionBy("doc_id", "line", "pos", "c").orderBy("prio")
    dedup = both.withColumn("_k", F.row_number().over(wf)).where(F.col("_k") == 1).drop("_k")
    counts = dedup.groupBy("doc_id", "line", "pos").agg(F.count(F.lit(1)).alias("n"))
    parts = typed.select(F.explode(snake_of(F.col("text"))).alias("part"))
    seg = segment_parts(parts, vocab)
    snake = typed.select("doc_id", "line", "pos", "text", F.posexplode(snake_of(F.col("text"))).alias("k", "part")) \
        .join(seg, "part", "left") \
        .withColumn("piece", F.when(F.col("part") == "", F.array(F.lit(""))).otherwise(F.col("words"))) \
        .groupBy("doc_id", "line", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("ps")) \
        .select("doc_id", "line", "pos", F.array_join(F.flatten(F.transform("ps", lambda x: x["piece"])), "_").alias("c"))
    snake = snake.join(counts, ["doc_id", "line", "pos"], "left").where(
        (F.coalesce("n", F.lit(0)) < MIN_RESULTS) & (F.col("c") != ""))
    snake = snake.join(dedup.select("doc_id", "line", "pos", "c"), ["doc_id", "line", "pos", "c"], "left_anti")
    seg_rows = snake.select("doc_id", "line", "pos", "c", F.lit("word-segment").alias("source"),
                            F.lit(SEGMENT_SCORE).alias("s"), F.lit(2).alias("prio"))
    return dedup.unionByName(seg_rows).drop("prio")


def rank_candidates(scored: DataFrame, typed: Column) -> DataFrame:
    """(doc_id, line, pos, c, final, rank): abbreviation score of the typed
    text x 10 (1 when nothing is typed) plus the model score; rows with a
    non-positive total are dropped; duplicates keep their best row."""
    sort_score = F.when(F.coalesce(F.length(typed), F.lit(0)) == 0, F.lit(1)).otherwise(
        sim.abbreviation_score_udf(F.col("c"), typed) * SORT_SCORE_FACTOR)
    d = scored.withColumn("final", sort_score + F.col("score")).where(F.col("final") > 0)
    w = Window.partitionBy("doc_id", "line", "pos").orderBy(F.col("final").desc(), "c")
    d = d.withColumn("rank", F.row_number().over(w))
    wd = Window.partitionBy("doc_id", "line", "pos", "c").orderBy("rank")
    return d.withColumn("_d", F.row_number().over(wd)).where(F.col("_d") == 1).select(
        "doc_id", "line", "pos", "c", "final", "rank")


# --- full-statement completion -------------------------------------------------------------
# fixed values: scan order and checks
STATEMENT_SCAN = 49                  # lines above / below, nearest first, above wins ties
CONSISTENCY_CHECKS = (r"\s*for\s", r"\s*def\s", r"\s*class\s", r"\s*with\s")
IMPORT_CHECK = r"\s*import\s"
RIGHT_HALVES = ",)]}"


def statement_end(s: Column, idx: Column) -> Column:
    """Position of the first ``, ) ] }`` at bracket depth 0 scanning ``s``
    from ``idx`` (0-based); the line length when there is none.  The scan goes
    from bracket to bracket or comma, not from character to character."""
    pieces = F.regexp_extract_all(F.substring(s, idx + 1, F.length(s)), F.lit(r"[^,()\[\]{}]*[,()\[\]{}]"), F.lit(0))
    init = F.struct(F.array().cast("array<string>").alias("st"), idx.cast("int").alias("n"), F.lit(-1).alias("p"))

    def step(acc, x):
        ch, end = F.substring(x, -1, 1), (acc["n"] + F.length(x)).alias("n")
        top = F.get(acc["st"], F.size(acc["st"]) - 1)
        closer = F.when(ch == "(", F.lit(")")).when(ch == "[", F.lit("]")).when(ch == "{", F.lit("}"))
        return (
            F.when(acc["p"] >= 0, acc)
            .when(closer.isNotNull(), F.struct(F.concat(acc["st"], F.array(closer)).alias("st"), end, acc["p"].alias("p")))
            .when(F.coalesce(ch == top, F.lit(False)),
                  F.struct(F.slice(acc["st"], 1, F.greatest(F.size(acc["st"]) - 1, F.lit(0))).alias("st"), end, acc["p"].alias("p")))
            .when((F.size(acc["st"]) == 0) & F.lit(RIGHT_HALVES).contains(ch),
                  F.struct(acc["st"].alias("st"), end, (acc["n"] + F.length(x) - 1).alias("p")))
            .otherwise(F.struct(acc["st"].alias("st"), end, acc["p"].alias("p")))
        )

    return F.aggregate(pieces, init, step, lambda acc: F.when(acc["p"] >= 0, acc["p"]).otherwise(F.length(s)))


def full_statement(positions: DataFrame, lines: DataFrame, block: int = 128) -> DataFrame:
    """(doc_id, line, pos, t, source_line, statement): for each position, the
    nearest line (order -1, +1, -2, +2, ... within 49) that contains the token
    at a word start, outside a comment or string, not an import line, with
    the same for/def/class/with shape as the current line and enough text
    after it; the statement is the text from the token up to the first
    closing bracket or comma at its own bracket depth.  Lines are gathered in
    blocks of ``block`` with 49 more on either side, so a text moves less than
    twice, and each position meets its block once and scans it in place."""
    shape = F.array(*[F.col("text").rlike(rx) for rx in CONSISTENCY_CHECKS])
    around = F.sequence(F.floor((F.col("line") - STATEMENT_SCAN) / block), F.floor((F.col("line") + STATEMENT_SCAN) / block))
    blocks = lines.where(F.col("text").isNotNull()).select(
        "doc_id", F.explode(around).alias("_b"),
        F.struct("line", F.col("text").alias("s"), shape.alias("shape"), F.col("text").rlike(IMPORT_CHECK).alias("imports")).alias("_l")) \
        .groupBy("doc_id", "_b").agg(F.collect_list("_l").alias("near"))
    q = positions.select("doc_id", "line", "pos", "t").distinct().withColumn("_b", F.floor(F.col("line") / block))
    q = q.join(blocks, ["doc_id", "_b"])
    t, off = F.col("t"), lambda x: x["line"] - F.col("line")
    own = F.transform(F.filter("near", lambda x: off(x) == 0), lambda x: x["shape"])

    def fits(x):
        return (off(x) != 0) & (F.abs(off(x)) <= STATEMENT_SCAN) & ~x["imports"] & F.array_contains(F.col("_own"), x["shape"]) & _offers(x["s"], t)

    d = q.withColumn("_own", own)
    hits = F.transform(F.filter("near", fits), lambda x: F.struct(
        (F.abs(off(x)) * 2 + (off(x) > 0).cast("int")).alias("k"), x["line"].alias("source_line"), x["s"].alias("s")))
    d = d.select("doc_id", "line", "pos", "t", F.array_min(hits).alias("b")).where("b is not null")
    return _statements(d)


def _offers(s: Column, t: Column) -> Column:
    """Whether line ``s`` has ``t`` first at a word start, outside a comment or
    string, with enough text behind it."""
    idx = F.instr(s, t) - 1
    hash_at = F.instr(s, "#") - 1
    before = F.substring(s, F.lit(1), idx)
    quotes = F.length(before) - F.length(F.regexp_replace(before, "[\"']", ""))
    return (
        s.contains(t)
        & ~((hash_at >= 0) & (idx > hash_at))
        & ~((idx > 0) & F.substring(s, idx, 1).rlike(r"^[A-Za-z0-9_]$"))
        & (quotes % 2 == 0)
        & (F.length(t) + idx + 1 < F.length(s))
    )


def _statements(d: DataFrame) -> DataFrame:
    """Rows (doc_id, line, pos, t, b STRUCT<source_line, s>) with the statement of line ``s`` from ``t`` on."""
    d = d.withColumn("idx", F.instr(F.col("b.s"), F.col("t")) - 1)
    stmt = F.substring(F.col("b.s"), F.col("idx") + 1, statement_end(F.col("b.s"), F.col("idx")) - F.col("idx"))
    return d.select("doc_id", "line", "pos", "t", F.col("b.source_line").alias("source_line"), stmt.alias("statement"))


def document_full_statement(docs: DataFrame) -> DataFrame:
    """``full_statement`` of all completion positions of documents (doc_id,
    codes): a position asks the lines around it in its document's array, the
    nearest first, and reads those of its own shape alone; nothing is shuffled."""
    shape = lambda s: sum((F.when(s.rlike(rx), 1 << k).otherwise(0) for k, rx in enumerate(CONSISTENCY_CHECKS)), F.lit(0))
    d = docs.select("doc_id", "codes", F.transform("codes", shape).alias("_shape"))
    offered = F.transform("codes", lambda s, i: F.when(s.rlike(IMPORT_CHECK), F.lit(-1)).otherwise(F.get(F.col("_shape"), i)))
    d = d.select("doc_id", "codes", "_shape", offered.alias("_offered"))
    is_position = lambda t: t.rlike(r"^\p{L}") & (F.length(t) >= 2)
    found = F.flatten(F.transform("codes", lambda s, i: F.filter(
        F.transform(views.line_tokens(s), lambda t, k: F.struct(i.alias("line"), k.alias("pos"), t.alias("t"))), lambda x: is_position(x["t"]))))

    def nearest(p):
        order = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(STATEMENT_SCAN)), lambda j: F.array(p["line"] - j, p["line"] + j)))
        own = F.get(F.col("_shape"), p["line"])
        hits = bound(F.struct(own.alias("own"), p["t"].alias("t")), lambda q: F.filter(
            order, lambda n: (F.get(F.col("_offered"), n) == q["own"]) & _offers(F.get(F.col("codes"), n), q["t"])))
        return bound(F.get(hits, 0), lambda n: F.when(n.isNotNull(), F.struct(
            p["line"].alias("line"), p["pos"].alias("pos"), p["t"].alias("t"), F.struct(n.alias("source_line"), F.get(F.col("codes"), n).alias("s")).alias("b"))))

    rows = F.filter(F.transform(found, nearest), lambda x: x.isNotNull())
    return _statements(d.select("doc_id", F.explode(rows).alias("p")).select("doc_id", "p.*"))
