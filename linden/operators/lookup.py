"""Token postings and lookups over them.

Postings are the normalised relation ``(doc_id, t, line)``; sets of lines per
token or tokens per line are views of it, never collected lists, so a
frequent token in a large document is just many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.operators.ngrams import context_arrays, token_context
from linden.operators.sequence import carry_last, line_pos_order
from linden.session import materialize
from linden.sources import views

# --- fixed values: prefix index ----------------------------------------------------
PREFIX_INDEX_MIN_LEN = 4  # only NAME tokens longer than 3 characters are indexed
BLOCK_LINES = 2048
# --- fixed values: statistics joins -------------------------------------------------
BROADCAST_ROWS = 1_000_000  # pruned tables up to this size go to every executor


def postings(tokens: DataFrame) -> DataFrame:
    """(doc_id, t, line, n): distinct token/line pairs with occurrence count."""
    return tokens.groupBy("doc_id", "t", "line").agg(F.count(F.lit(1)).alias("n"))


def line_postings(lines: DataFrame) -> DataFrame:
    """``postings`` of lines (doc_id, line, text) of which each is a row of its
    own: runs of the line's sorted tokens, without a shuffle."""
    d = lines.select("doc_id", "line", F.sort_array(views.line_tokens(F.col("text"))).alias("ts"))
    starts = F.transform("ts", lambda t, i: F.when((i == 0) | (t != F.get(F.col("ts"), i - 1)), i))
    d = d.select("doc_id", "line", "ts", F.filter(starts, lambda i: i.isNotNull()).alias("at"))
    runs = F.transform("at", lambda a, i: F.struct(
        F.get(F.col("ts"), a).alias("t"), (F.coalesce(F.get(F.col("at"), i + 1), F.size("ts")) - a).cast("long").alias("n")))
    return d.select("doc_id", "line", F.explode(runs).alias("r")).select("doc_id", "r.t", "line", "r.n")


def document_postings(documents: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """``postings`` of whole documents (doc_id, text), except of the lines
    ``without`` (doc_id, line).  Only documents with a repeated id or a very
    long text shuffle their tokens."""
    def of(docs: DataFrame) -> DataFrame:
        return views.lines(docs) if without is None else views.lines(docs).join(without, ["doc_id", "line"], "left_anti")

    whole, rest = views.whole_documents(documents)
    found = line_postings(of(whole))
    return found if rest is None else found.unionByName(postings(views.tokens(of(rest))))


def prefix_index(tokens: DataFrame) -> DataFrame:
    """Postings restricted to NAME tokens longer than 3 characters."""
    return tokens.where((F.col("kind") == lx.KIND_NAME) & (F.length("t") >= PREFIX_INDEX_MIN_LEN))


def token_min_max(tokens: DataFrame) -> DataFrame:
    """(doc_id, t, min_line, max_line) over the prefix index."""
    return prefix_index(tokens).groupBy("doc_id", "t").agg(
        F.min("line").alias("min_line"), F.max("line").alias("max_line"))


def prefix_lookup(tokens: DataFrame, prefix: str) -> DataFrame:
    """(doc_id, t): indexed tokens starting with ``prefix`` (taken literally)."""
    return prefix_index(tokens).where(F.col("t").startswith(prefix)).select("doc_id", "t").distinct()


def prefix_nearest(tokens: DataFrame, prefix: str, line: int) -> DataFrame:
    """(doc_id, t, dist, rank): indexed tokens starting with ``prefix`` ordered
    by their nearest line to ``line``, then by token."""
    d = (
        prefix_index(tokens).where(F.col("t").startswith(prefix))
        .groupBy("doc_id", "t").agg(F.min(F.abs(F.col("line") - F.lit(line))).alias("dist"))
    )
    w = Window.partitionBy("doc_id").orderBy("dist", "t")
    return d.withColumn("rank", F.row_number().over(w))


def nearest_previous(rows: DataFrame, key_cols: list[str], out: str,
                     valid=None) -> DataFrame:
    """``out`` = line distance to the previous occurrence (in (line, pos)
    order) of the same key within the document, else 99999.  Blocked
    look-back, so a frequent key in a large document is spread out."""
    order = "_np_order"
    d = rows.withColumn(order, line_pos_order())
    d = carry_last(d, F.col("line"), "_np_prev", key=["doc_id", *key_cols], order=order,
                   block_col=F.floor(F.col("line") / BLOCK_LINES))
    dist = F.coalesce(F.col("line") - F.col("_np_prev"), F.lit(lx.NOT_FOUND))
    if valid is not None:
        dist = F.when(valid, dist).otherwise(F.lit(lx.NOT_FOUND))
    return d.withColumn(out, dist.cast("int")).drop(order, "_np_prev")


# fixed values: match feature -> context tokens of its key besides t0
PLACE_BITS = 31
MATCH_KEYS = {"t1_match": ["t1"], "t2_match": ["t2"], "t3_match": ["t3"], "trigram_match": ["t2", "t1"]}


def _array_matches(documents: DataFrame) -> DataFrame:
    """``nearest_ngram`` of whole documents, without a shuffle: a document's
    tokens sorted by key and place have the previous occurrence next to them;
    sorted by place again, the four distances lie side by side.  A place packs
    the token's number and its line, a result its number and distance; both
    fit, as ``views.WHOLE_CHARS`` bounds a document's tokens and lines."""
    bits, low = PLACE_BITS, F.lit((1 << PLACE_BITS) - 1)
    d = context_arrays(documents).where(F.size("ctx") > 0)
    for out, key in MATCH_KEYS.items():
        place = lambda x, i: F.shiftleft(i.cast("long"), bits).bitwiseOR(x["line"].cast("long"))
        by_key = F.sort_array(F.transform("ctx", lambda x, i: F.struct(x["t0"].alias("t0"), *[x[k].alias(k) for k in key], place(x, i).alias("at"))))
        d = d.select(*d.columns, by_key.alias("_s"))

        def distance(x, i):
            before = F.get(F.col("_s"), i - 1)
            same = before["t0"] == x["t0"]
            for k in key:
                same = same & (before[k] == x[k])
            if out != "t1_match":
                same = same & (x[key[0]] != "")
            m = F.when(same, x["at"].bitwiseAND(low) - before["at"].bitwiseAND(low)).otherwise(F.lit(lx.NOT_FOUND).cast("long"))
            return F.shiftleft(F.shiftright(x["at"], bits), bits).bitwiseOR(m)

        d = d.select(*[c for c in d.columns if c != "_s"], F.sort_array(F.transform("_s", distance)).alias(out))
    z = d.select("doc_id", F.explode(F.arrays_zip("ctx", *MATCH_KEYS)).alias("z"))
    return z.select("doc_id", "z.ctx.line", "z.ctx.pos", *[F.col(f"z.{m}").bitwiseAND(low).cast("int").alias(m) for m in MATCH_KEYS])


def nearest_ngram(context: DataFrame) -> DataFrame:
    """t1/t2/t3/trigram match for every token of ``token_context`` rows, or of
    documents (doc_id, text):
    distance in lines to the previous occurrence of (t1,t0), (t2,t0), (t3,t0)
    and (t2,t1,t0) in the same document; 99999 when there is none or when
    the needed context token is ''."""
    if "text" in context.columns:
        whole, rest = views.whole_documents(context)
        found = _array_matches(whole)
        return found if rest is None else found.unionByName(nearest_ngram(token_context(views.lines(rest))))
    d = nearest_previous(context, ["t1", "t0"], "t1_match")
    d = nearest_previous(d, ["t2", "t0"], "t2_match", F.col("t2") != "")
    d = nearest_previous(d, ["t3", "t0"], "t3_match", F.col("t3") != "")
    d = nearest_previous(d, ["t2", "t1", "t0"], "trigram_match", F.col("t2") != "")
    return d.select("doc_id", "line", "pos", "t1_match", "t2_match", "t3_match", "trigram_match")


def ngram_lookup(context: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """token / bigram / trigram frequency of each token in its context from
    (pruned) statistics tables; 0 when absent, bigram needs t1 non-empty and
    trigram needs t1 and t2 non-empty.  Pruning leaves tables far smaller than
    the corpus: they are written and, up to ``BROADCAST_ROWS`` rows, sent to the
    token rows, which then need no shuffle; larger ones are joined by key."""
    stats = {k: materialize(s, f"pruned-{k}") for k, s in stats.items()}
    stats = {k: F.broadcast(s) if s.count() <= BROADCAST_ROWS else s for k, s in stats.items()}
    uni = stats["token"].select(F.col("t0"), F.col("n").alias("token_frequency"))
    bi = stats["bigram"].select("t1", "t0", F.col("n").alias("bigram_frequency"))
    tri = stats["trigram"].select("t2", "t1", "t0", F.col("n").alias("trigram_frequency"))
    d = (
        context.join(uni, ["t0"], "left")
        .join(bi, ["t1", "t0"], "left")
        .join(tri, ["t2", "t1", "t0"], "left")
    )
    return d.select(
        "doc_id", "line", "pos",
        F.coalesce("token_frequency", F.lit(0)).alias("token_frequency"),
        F.when(F.col("t1") != "", F.coalesce("bigram_frequency", F.lit(0))).otherwise(0).alias("bigram_frequency"),
        F.when((F.col("t1") != "") & (F.col("t2") != ""), F.coalesce("trigram_frequency", F.lit(0)))
        .otherwise(0).alias("trigram_frequency"),
    )
