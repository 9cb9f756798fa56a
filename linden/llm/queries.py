"""Named queries of the training-data operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linden.llm import chat, embeddings, fingerprints, minhash, packing, phrases, pieces, quality, records, repair, repeats, sharding, urls
from linden.llm.common import fresh_path, tokenizer_path, written
from linden.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality.vectors(docs, drop_text=True), "quality-stats")
    model = quality.fit(quality.examples_of(stats, table(spark, sf_dir, "labels")))
    return quality.add_scores(stats, model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and of its edited text,
    with their likeness, and that to the next document's fingerprint."""
    rows = fingerprints.edited(fingerprints.with_next(table(spark, sf_dir, "documents")))
    rows = fingerprints.with_fingerprint(rows, "text", "fingerprint")
    rows = fingerprints.with_fingerprint(rows, "edited_text", "edited_fingerprint")
    rows = written(rows.select("doc_id", "n_chars", "text_hash", "next_id", "next_hash", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                               "fingerprint", "edited_fingerprint"), "fingerprints")
    # the following row by its id (null or not) and text; equal rows have equal fingerprints
    key = lambda name, text: [F.coalesce(name, F.lit(0)).alias("id"), F.col(name).isNull().alias("no_id"), F.col(text).alias("hash")]
    follow = rows.select(*key("doc_id", "text_hash"), F.col("fingerprint").alias("next_fingerprint")).dropDuplicates(["id", "no_id", "hash"])
    rows = rows.select("*", *key("next_id", "next_hash")).join(follow, ["id", "no_id", "hash"], "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.parse(chat.format_conversations(chat.events_of(turns.union(hard)), F.col("position.turn")))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("parsed", lambda t: t.masked), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), digest(said).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


URL_RULES = [urls.Rule("com", "/", "allow"), urls.Rule("example.com", "/en/", "block"), urls.Rule("www.example.com", "/en/", "allow"),
             urls.Rule("net", "/es/", "block"), urls.Rule("net", "/fr/", "block")]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the rules', else that of trees fitted on
    the URLs that a rule labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    ruled = urls.with_rule(urls.split_url(pages), URL_RULES)
    labelled = ruled.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("int"))
    return urls.filter_urls(pages, URL_RULES, urls.train(labelled)).select("page_id", "host", "path", "rule", "verdict", "model_score")


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents alike in their sets of four-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


ORACLE["op7_near_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM both_have p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, roots.root AS component_id, w.doc_id = roots.root AS kept
FROM words w JOIN roots ON roots.a = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id
"""


@query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of the vectors of a label at a cosine of 0.93."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


ORACLE["op8_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(links.n, 0) AS n_links, roots.root AS component_id, v.vec_id = roots.root AS kept
FROM v JOIN roots ON roots.a = v.vec_id LEFT JOIN links ON links.a = v.vec_id
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids, a row for each piece."""
    pieces_of = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces_of.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                            "doc_tokens", "sequence_id", "offset")


@query
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as framed records and read back."""
    folder = fresh_path(spark, "token-records")
    index = records.write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    back = records.read_records(records.with_starts(index), folder)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in a global random order to 24 shards of row
    counts at most one apart, and read back."""
    rows = sharding.write_shards(table(spark, sf_dir, "documents"), 24)
    text = F.coalesce("doc.text", F.lit(""))
    return rows.select("doc.doc_id", sharding.size_of(F.col("doc.text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a checksum and repaired at least cost."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summary, messages = repair.repair(repair.damaged(turns))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda r: r.line), "\n")
    line = F.concat("role", F.lit(":"), "text").alias("line")
    blocks = messages.groupBy("conv_id", F.shiftright("id", repair.LEAF).alias("node")).agg(joined(F.collect_list(F.struct("id", "nth", line))).alias("line"))
    whole = blocks.groupBy(F.col("conv_id").alias("own_id")).agg(joined(F.collect_list(F.struct("node", "line"))).alias("repaired"))
    rows = turns.select("conv_id").distinct().join(summary.withColumnRenamed("conv_id", "sum_id"), F.col("conv_id").eqNullSafe(F.col("sum_id")), "left") \
        .join(whole, F.col("conv_id").eqNullSafe(F.col("own_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 two- and three-word phrases by the score of
    their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, [x for x in regexp_split_to_array(piece, '[ \t]+') if x <> ''] AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS p FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM words
), f AS MATERIALIZED (SELECT lang, k, p, count(*) AS n FROM grams GROUP BY lang, k, p),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, p, n AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
halves AS MATERIALIZED (
  SELECT lang, p, a, 1 AS j, w[1] AS lp, CASE k WHEN 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS rp FROM candidates
  UNION ALL SELECT lang, p, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE k = 3
), cuts AS (
  SELECT h.lang, h.p, h.a, j, l.n AS l, r.n AS r, (1000000::HUGEINT * h.a * h.a) // (l.n::HUGEINT * r.n) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.p = h.lp JOIN f r ON r.lang = h.lang AND r.p = h.rp
), weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS nth FROM cuts
), dropped AS (
  SELECT DISTINCT s.lang, s.p FROM candidates s
  JOIN (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_p FROM candidates WHERE k = 3) t
    ON t.lang = s.lang AND t.inner_p = s.p WHERE 100 * t.a >= 50 * s.a
), ranked AS (
  SELECT x.lang, x.p, x.a, x.l, x.r, x.score,
         row_number() OVER (PARTITION BY x.lang ORDER BY x.score DESC, x.a DESC, x.p) AS rank
  FROM weakest x LEFT JOIN dropped d ON d.lang = x.lang AND d.p = x.p WHERE x.nth = 1 AND d.p IS NULL
)
SELECT ranked.lang, rank, p AS phrase, a, l, r, totals.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
