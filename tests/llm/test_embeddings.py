"""Embedding near-duplicates against brute force in double precision."""

import numpy as np
import pytest

from linden.llm import embeddings
from linden.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(rows, cosine=0.93):
    """{row: (links, component)} over (vec_id, embedding, label)."""
    ok = [lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v) for _, v, lab in rows]
    units = [embeddings.unit(np.array([v]))[0] if k else None for k, (_, v, _) in zip(ok, rows, strict=True)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], links[i], min((v for v in groups[find(i)] if v is not None), default=None)) for i in range(len(rows))]


def key(r):
    return tuple((x is not None, x) for x in r)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]  # as floats
    got = embeddings.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op8_embedding_dedup"](spark, SMALL).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))


@pytest.mark.parametrize("block", [16, 1024])
def test_recall_at_the_threshold(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = []
    for v in base:
        for c in (1.0, 0.96, 0.94, 0.935, 0.91):
            away = rng.normal(size=24)
            away -= away @ v / (v @ v) * v
            rows.append((len(rows), (c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * away / np.linalg.norm(away)).tolist(), len(rows) % 2 and 5))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, block=block).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.98 * sum(want.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 0.0], None),
                  (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [3.0], 2), (12, [5.0], 2),
                  (7, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (13, [1e-30, 1e-30], 3), (14, [1e30, 1e30], 3)])
    check(spark, [])


def test_traversal_visits_cells_in_order(spark):
    rng = np.random.default_rng(2)
    x = embeddings.unit(rng.normal(size=(500, 16)))
    index = embeddings.fit_index(x, 0.93, 8, 0.99)
    _, p, q = index.bounds(x)
    for r in range(20):
        cells = index.visits(p[r], q[r])
        sums = [p[r][c // q.shape[1]] + q[r][c % q.shape[1]] for c in cells]
        assert sums == sorted(sums)
        assert len(cells) == sum(a + b <= index.radius for a in p[r] for b in q[r])
