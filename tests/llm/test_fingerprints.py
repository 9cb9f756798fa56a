"""Order MinHash fingerprints: selection by brute force, likeness, edits."""

import hashlib
import random

from pyspark.sql import functions as F

from linden.llm import fingerprints as fp
from linden.llm.queries import QUERIES
from tests.conftest import SMALL


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.f for r in fp.with_fingerprint(df, "text", "f").collect()}


def brute(spark, text):
    """The fingerprint by plain loops; hashes come from the session."""
    def hashes(groups):
        rows = spark.createDataFrame([(g,) for g in groups], "g array<long>") if groups else None
        return [] if rows is None else [r[0] for r in rows.select(F.expr("xxhash64(g[0], g[1], g[2])" if len(groups[0]) == 3 else "xxhash64(g)")).collect()]

    import re
    words = re.findall(r"\S{1,%d}" % fp.TOKEN, text, re.ASCII)
    if not words:
        return fp.EMPTY * fp.BINS
    tokens = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    kmers = hashes([[*tokens[i:i + 3], None, None][:3] for i in range(max(len(tokens) - 2, 1))])
    low = (1 << fp.PLACES) - 1
    seen, rows = {}, []
    for i, k in enumerate(kmers):
        short = k >> fp.PLACES
        seen[short] = seen.get(short, [])
        seen[short].append(i)
    df = spark.createDataFrame([(kmers[i], n + 1, i) for own in seen.values() for n, i in enumerate(own)], "k long, n int, i long")
    for r in df.select(F.xxhash64("k", "n").alias("v"), "i").collect():
        rows.append(((r.v & ~low) | r.i))
    bins = {}
    for p in sorted(rows):
        bins.setdefault((p >> 58) + 32, []).append(p)
    out = [fp.EMPTY] * fp.BINS
    for b, own in bins.items():
        own = sorted(own[:fp.PICK], key=lambda p: p & low)
        value = spark.createDataFrame([([p >> fp.PLACES for p in own],)], "g array<long>").select(F.lower(F.hex(F.xxhash64("g")))).first()[0]
        out[b] = value.zfill(16)[-8:]
    return "".join(out)


def test_selection_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["", " \n", "one", "one two", "a b c", "a a a a a a a a", " ".join(rng.choices("abcdef", k=200)),
             "x" * 500, " ".join(f"w{rng.randrange(50)}" for _ in range(400)) + "\n tail é"]
    got = prints(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(spark, t), t[:40]


def test_likeness_feels_order_and_edits(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    halves = words[300:] + words[:300]
    one = words[:250] + ["changed"] + words[251:]
    repeated = words + words
    pairs = [(" ".join(words), " ".join(x)) for x in (words, one, halves, words[:300] + [f"v{k}" for k in range(300)], repeated, [f"u{k}" for k in range(600)])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    df = fp.with_fingerprint(fp.with_fingerprint(df, "a", "fa"), "b", "fb")
    same, edit, swapped, half, doubled, other = [r.x for r in df.orderBy("i").select(fp.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()]
    assert same == 1 and other == 0
    assert edit > 0.9 and 0.02 < half < 0.6
    assert 0.2 < swapped < 0.75  # a set similarity would be about 0.99
    assert doubled < 0.6  # numbered occurrences tell a text from itself twice


def test_query_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op3_order_minhash"](spark, SMALL).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    assert len(got) == len(docs)
    near = []
    for (d, t), (_, follow) in zip(docs, docs[1:] + docs[:1], strict=True):
        r, h = got[d], len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[:len(t) - h] + follow[:h]).encode()).hexdigest()
        assert len(r.fingerprint) == len(r.edited_fingerprint) == fp.BINS * fp.DIGITS
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        near.append((r.near_edited, r.near_next, t == follow, r))
    assert sum(a for a, *_ in near) > 3 * sum(b for _, b, same, _ in near if not same)
    by_text = {}
    for d, t in docs:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def next_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text, r.next_id, r.next_text) for r in fp.with_next(df).collect()), key=str)


def test_query_keeps_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "e f g h"), (2, None), (3, "x y z w " * 9), (None, "n"), (None, "m m"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_order_minhash"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id) == [(1, 7), (1, 7), (1, 7), (2, 0), (3, 72)]
    assert sorted(r.n_chars for r in got if r.doc_id is None) == [0, 1, 3]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    ones = sorted(r.near_next for r in got if r.doc_id == 1)  # e.. -> a.., a.. -> a.., a.. -> null id
    assert ones == [0, 0, 1]


def test_next_document_across_blocks_gaps_and_wide_blocks(spark):
    rng = random.Random(6)
    ids = sorted(rng.sample(range(-5000, 200_000), 300) + list(range(100)), reverse=True)
    ids = sorted(set(ids), reverse=True)
    rows = [(i, f"text {i} " * 3) for i in ids]
    want = [(a, t, b, u[:len(t) // 2]) for (a, t), (b, u) in zip(rows, rows[1:] + rows[:1], strict=True)]
    rng.shuffle(rows)
    assert next_ids(spark, rows) == sorted(want, key=str)


def test_followers_of_sparse_numbers(spark, monkeypatch):
    monkeypatch.setattr(fp, "WIDE", 8)
    rng = random.Random(9)
    ids = sorted({rng.randrange(-(1 << 40), 1 << 40) for _ in range(300)} | set(range(20)) | {-(1 << 62)}, reverse=True)
    df = spark.createDataFrame([(i,) for i in ids], "block long")
    got = {r.from_block: r.to_block for r in fp.followers(df).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_nulls_repeats_one_row_and_empty(spark):
    assert next_ids(spark, [(5, "abcd")]) == [(5, "abcd", 5, "ab")]
    got = next_ids(spark, [(None, "xyzw"), (1, None), (2, "bb"), (2, "aa")])
    assert got == sorted([(2, "bb", 2, "a"), (2, "aa", 1, ""), (1, "", None, ""), (None, "xyzw", 2, "bb")], key=str)
    assert next_ids(spark, []) == []


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op3_order_minhash"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
