"""MinHash near-duplicates against brute force over the full sets."""

import random
import re

import pytest
from linden.llm import minhash
from linden.llm.components import components
from linden.llm.queries import QUERIES
from tests.conftest import SMALL

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, words=4, percent=80):
    """{row number: (size, component_id)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        own = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(own[i:i + words]) for i in range(max(len(own) - words + 1, 1))} if own else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(rows))]


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, **options):
    got = minhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string"), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute(rows, options.get("words", 5)), key=key)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op7_near_duplicates"](spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("edits", [1, 4])
def test_families_with_chains_and_near_misses(spark, edits):
    rng = random.Random(5)
    rows = []
    for family in range(12):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(14):
            rows.append((len(rows), " ".join(text)))
            for _ in range(edits):  # each copy is an edit of the one before: chains
                text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
    rng.shuffle(rows)
    check(spark, rows, words=4)


def test_nulls_empty_short_long_and_repeats(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (3, "one TWO"), (None, "one two"), (9, "one two"),
            (1, "a b c d e f g " * 3000), (2, "a b c d e f g " * 2000), (4, "same"), (4, "same"), (4, "other words here"), (None, "alone")]
    check(spark, rows)
    check(spark, rows[:0])


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(7000, 7000)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(501)}
