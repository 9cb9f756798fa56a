"""Collocations against plain counting: cuts, subsumption, ranks, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from linden.llm import phrases
from linden.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL


def brute(rows, least=10, subsumed=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) == 1 or a < least:
                continue
            inside = any(len(q) == 3 and p in (q[:2], q[1:]) and b >= least and 100 * b >= subsumed * a for q, b in own.items()) if len(p) == 2 else False
            if not inside:
                s, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(found[:top])]
    return sorted(out)


def result(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string")
    return sorted(map(tuple, phrases.collocations(df, **how).collect()))


@pytest.fixture
def small_parts(monkeypatch):
    """Flushes, cuts and carried stripes in small fixtures, without Spark."""
    for name, value in (("TOKENS", 60), ("PIECE", 40), ("ROWS", 5), ("MOST", 2), ("ENTRIES", 30)):
        monkeypatch.setattr(phrases, name, value)


@pytest.mark.parametrize("heavy", [frozenset(), frozenset([b"a", b"h"])])
def test_parts_count_every_phrase(small_parts, heavy):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", "e.", "f,g", "h"], k=rng.randrange(90))) for _ in range(40)]
    gathered, batches = phrases.Gatherer(), []
    for text in texts:
        for piece in phrases.cut(text.encode().translate(phrases._TABLE)):
            gathered.add(piece)
            if gathered.size > phrases.TOKENS:
                batches += phrases.rows_of("en", gathered.stripes(False), heavy, 3)
        gathered.parts.append(np.ones(1, np.int64))
    batches += phrases.rows_of("en", gathered.stripes(True), heavy, 3)
    table = pa.Table.from_batches(batches)
    assert len({*table.column("slice").to_pylist()}) == (4 if heavy else 1)
    keys = list(zip(*(table.column(c).to_pylist() for c in ("lang", "first", "slice")), strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    found, pairs, firsts = Counter(), Counter(), Counter()
    for b in phrases.merge(iter(table.take(order).to_batches(max_chunksize=7)), 1):
        for r in b.to_pylist():
            if r["second"] is None:
                firsts[r["first"]] += r["total"]
                continue
            pairs[r["first"], r["second"]] += r["total"]
            for w, k in zip(r["nexts"], r["counts"], strict=True):
                found[r["first"], r["second"], w] += k
    want = [Counter(), Counter(), Counter()]
    for t in texts:
        for piece in re.split("[.,]", t):
            w = piece.split()
            for k in range(3):
                want[k].update(tuple(w[i:i + k + 1]) for i in range(len(w) - k))
    assert found == want[2] and pairs == want[1] and firsts == {k: n for (k,), n in want[0].items()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "New", "york", "city", "of", "and", "É", "x y", "\x1c"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(120))))
            for _ in range(150)]
    rows += [("en", None), (None, ""), ("fr", "solo"), ("en", "new york city " * 60), ("en", "of " * 3000)] + [("de", "immer das gleiche")] * 40
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, top=5, least=20, subsumed=80) == brute(rows, 20, 80, 5)


def test_heavy_words_and_wide_stripes(spark):
    """A pair that goes on in 3000 ways, and one of them often; its words are sliced."""
    rows = [("en", f"very common w{k % 3000}") for k in range(9000)] + [("en", "very common pair")] * 30 + [("en", "very common")] * 20
    assert result(spark, rows) == brute(rows)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {b"very", b"common"} <= phrases.heavy_words(docs, 8) and phrases.heavy_words(docs.limit(0), 8) == frozenset()


def test_sums_beyond_64_bits(spark):
    a = 3_000_000_000
    df = spark.createDataFrame([(a, a + 1, a + 7)], "a long, l long, r long")
    pairs = df.selectExpr("'en' AS lang", "'x' AS first", "'y' AS second", "a AS f", "CAST(null AS long) AS extended")
    got = pairs.selectExpr("(cast(1000000 as decimal(7, 0)) * cast(f as decimal(19, 0)) * cast(f as decimal(19, 0))) div "
                           f"(cast({a + 1} as decimal(19, 0)) * cast({a + 7} as decimal(19, 0))) AS s").first().s
    assert got == 1_000_000 * a * a // ((a + 1) * (a + 7))


def test_empty_and_extra_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([("en", "a b " * 20, 1, "x")], "lang string, text string, first int, second string")
    assert phrases.collocations(df).count() == len(brute([("en", "a b " * 20)]))


def test_query_equals_sql(spark, duck):
    want = sorted(duck.execute(ORACLE["op13_collocations"]).fetchall())
    got = QUERIES["op13_collocations"](spark, SMALL)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
