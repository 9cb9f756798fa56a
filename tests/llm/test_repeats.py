"""Repeated byte strings against brute force."""

import hashlib
import random

import pytest
from linden.llm import repeats
from linden.llm.queries import QUERIES
from pyspark.sql import functions as F
from tests.conftest import SMALL


def brute(texts, length):
    """Per text: removed spans and kept bytes, by counting every window."""
    data = [(t or "").encode() for t in texts]
    counts = {}
    for d in data:
        for s in range(len(d) - length + 1):
            w = hashlib.md5(d[s:s + length]).digest()
            counts[w] = counts.get(w, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if counts[hashlib.md5(d[s:s + length]).digest()] > 1:
                gone[s:s + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a)
            at = len(gone) if at < 0 else at
            spans.append((a, at))
        out.append((len(d), spans, kept))
    return out


def check(spark, rows, length, gram=repeats.GRAM):
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string"), length, gram)
    assert got.columns == ["doc_id", "text", "n_bytes", "spans", "kept"]
    want = [(r[0], r[1], *b) for r, b in zip(rows, brute([r[1] for r in rows], length), strict=True)]
    found = [(r.doc_id, r.text, r.n_bytes, [(s.first, s.end) for s in r.spans], bytes(r.kept)) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: b for d, b in zip(docs, brute([d.text for d in docs], 400), strict=True)}
    got = QUERIES["op5_repeated_strings"](spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        size, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (size, size - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_mixed_passages(spark, seed):
    rng = random.Random(seed)
    alphabet = ["ab", "abcdé", "a"][seed]
    passages = ["".join(rng.choices(alphabet, k=rng.randrange(20, 90))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages)[rng.randrange(8):] if rng.random() < 0.6 else
                        "".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(rng.randrange(6))), "x") for i in range(60)]
    check(spark, rows, 40, 12)


def test_repeats_inside_one_text_runs_and_periods(spark):
    rows = [(1, "x" * 500, ""), (2, "abc" * 40, ""), (3, "y" * 40, ""), (4, "y" * 39, ""), (5, "y" * 41, "")]
    check(spark, rows, 40, 12)


def test_nulls_copies_short_and_ties(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdef ", k=700))
    rows = [(1, None, ""), (2, "", ""), (3, "short", ""), (4, "short", ""), (5, long, ""), (6, long, ""), (6, long, ""),
            (None, long[:300], ""), (None, "é" * 30, ""), (7, "é" * 30 + "z", "")]
    check(spark, rows, 40)
    check(spark, rows[:0], 40)


def test_equal_windows_have_their_sample_at_the_same_shift():
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=700)).encode()
    shifts = []
    for before in (b"", b"something else in front", b"x" * 333):
        _, at, lo, hi = repeats.samples(before + passage + b"tail" * 50, 400, 128)
        own = {s - len(before): int(a) - s for a, x, y in zip(at, lo, hi, strict=True) for s in range(x, y + 1)}
        shifts.append([own[s] for s in range(301)])
    assert shifts[0] == shifts[1] == shifts[2]
    assert len(set(shifts[0])) > 20


def test_segments_of_a_long_text(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    data = (text + text[500:900] + "q").encode()
    plain = repeats.samples(data, 100, 20)
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    cut = repeats.samples(data, 100, 20)
    of = lambda s: {start: int(at) for at, lo, hi in zip(*s[1:], strict=True) for start in range(lo, hi + 1)}
    assert of(plain) == of(cut) and len(of(plain)) == len(data) - 99


def test_rows_of_a_frequent_name_are_not_gathered(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") < 12_000, -1).otherwise(F.col("id")).alias("name"), "id")
    names = spark.range(-1, 16_000).where("id < 0 or id >= 14000").select(F.col("id").alias("name"), F.when(F.col("id") < 0, 12_000).otherwise(1).cast("long").alias("n"))
    found = repeats._named(rows, names, "name")
    assert sorted(r.id for r in found.collect()) == [*range(12_000), *range(14_000, 16_000)]
    tasks = found.where(F.col("name") == -1).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(t["count"] for t in tasks) <= 2_500


def test_passages_planted_across_documents_and_nothing_else(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 10))) for _ in range(n))
    rows = [(i, words(120), "") for i in range(30)]
    passages = [words(80) for _ in range(5)]
    planted = [(i, f"{words(60)} {passages[i % 5]} {words(60)}", "") for i in range(30, 50)]
    assert all(len(p) >= 400 for p in passages)
    got = repeats.remove_repeats(spark.createDataFrame(rows + planted, "doc_id long, text string, spans string")).collect()
    for r in got:
        assert (len(r.spans) > 0) == (r.doc_id >= 30) and len(r.kept) <= r.n_bytes - (400 if r.spans else 0)
    check(spark, rows + planted, 400)


def test_one_python_worker_a_task(spark):
    """No stage evaluates Python twice: each evaluation holds a worker of its own beside each core's."""
    docs = spark.createDataFrame([(k, "abc" * 300 + str(k)) for k in range(8)], "doc_id long, text string")
    plan = repeats.remove_repeats(docs, 400)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_among_finds_every_key(spark):
    rng = random.Random(5)
    keys = [rng.randrange(-2**63, 2**63) for _ in range(3000)] + [0, -1, 63, 64, 2**63 - 1, -2**63]
    other = [rng.randrange(-2**63, 2**63) for _ in range(3000)]
    rows = spark.createDataFrame([(k, k in set(keys)) for k in keys + other], "key long, known boolean")
    found = repeats._among(rows, F.col("key"), rows.where("known").select("key")).groupBy("known").agg(
        F.count("*").alias("n"), F.count_if("maybe").alias("maybe"), F.count_if(F.col("maybe").isNull()).alias("null")).collect()
    found = {r.known: r for r in found}
    assert (found[True].n, found[True].maybe, found[True].null) == (len(keys), len(keys), 0)
    assert found[False].maybe < 30 and found[False].null == 0
    assert repeats._among(rows, F.col("key"), rows.where("known and not known").select("key")).where("maybe").count() == 0
