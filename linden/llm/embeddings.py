"""Embedding near-duplicates through an inverted multi-index.

The two halves of each unit vector are quantised by codebooks of their own;
their product is the grid of cells.  Every vector is filed under its nearest
cell and visits, in the order of a multi-sequence traversal, the cells whose
two half distances add up to no more than a radius.  The half distance to a
cell is that to the plane between the cell's centre and the nearest one, so
the sum bounds the distance to any vector filed there from below.  The radius
is calibrated on the sample: vectors exactly at the threshold in random
directions must be found with the target recall from one side alone (a pair
is found from either side).  Found pairs are verified in double precision.

Equal vectors of a label are one node with a multiplicity.  Filed vectors and
visitors of a cell meet in blocks of bounded size, whatever the cell holds,
and each block reports sums of links and a spanning star of its links, not
the pairs.

Nulls and edge cases: a vector without label, null, zero, or with null or
non-finite components links with nothing and is its own component; vectors of
different lengths never link; repeated rows count as vectors of their own,
linked with each other; a null vec_id never becomes a component_id unless all
are null; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linden.llm.common import written
from linden.llm.components import components


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.asarray(vectors, np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if x.shape[0] * len(centres) < 4e5 else \
            (-2 * x @ centres.T + (centres ** 2).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return np.unique(centres, axis=0)


@dataclass(frozen=True)
class Half:
    """Codebook of one half of the dimensions."""

    centres: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centre, and the squared distance to each centre's region
        (to the plane between it and the nearest centre)."""
        c = self.centres
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        near = d.argmin(1)
        apart = ((c[:, None] - c[None]) ** 2).sum(2)[near]
        least = np.take_along_axis(d, near[:, None], 1)
        return near, (d - least) ** 2 / (4 * np.where(apart > 0, apart, 1))


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks and the radius of the traversal, for one vector length."""

    first: Half
    second: Half
    radius: float

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :x.shape[1] // 2], x[:, x.shape[1] // 2:]

    def bounds(self, x: np.ndarray):
        """Cells and both tables of half distances."""
        a, b = self.split(x)
        (i, p), (j, q) = self.first.bounds(a), self.second.bounds(b)
        return i * len(self.second.centres) + j, p, q

    def visits(self, p: np.ndarray, q: np.ndarray) -> list[int]:
        """Cells of one vector in multi-sequence order: a heap walks the two
        sorted lists by rising sums until the radius is passed."""
        one, two = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
        heap, seen, out = [(float(p[one[0]] + q[two[0]]), 0, 0)], {(0, 0)}, []
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > self.radius:
                break
            out.append(int(one[i]) * len(q) + int(two[j]))
            for s in ((i + 1, j), (i, j + 1)):
                if s[0] < len(p) and s[1] < len(q) and s not in seen:
                    seen.add(s)
                    heapq.heappush(heap, (float(p[one[s[0]]] + q[two[s[1]]]), *s))
        return out


def fit_index(sample: np.ndarray, cosine: float, cells: int, recall: float, seed: int = 13) -> MultiIndex:
    """Codebooks of ``cells`` centres for each half, fitted on unit vectors,
    with the radius that reaches ``recall`` at the threshold from one side."""
    cut = sample.shape[1] // 2
    index = MultiIndex(Half(k_means(sample[:, :cut], cells)), Half(k_means(sample[:, cut:], cells)), 0.0)
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    norm = np.sqrt((away * away).sum(1, keepdims=True))
    y = unit(cosine * x + np.sqrt(1 - cosine ** 2) * away / np.where(norm > 0, norm, 1))
    cell, _, _ = index.bounds(y)
    _, p, q = index.bounds(x)
    width = len(index.second.centres)
    need = p[np.arange(len(x)), cell // width] + q[np.arange(len(x)), cell % width]
    return MultiIndex(index.first, index.second, float(np.quantile(need, recall)) + 1e-12)


def _valid(rows: DataFrame, vec: str) -> DataFrame:
    parts = F.coalesce(F.col(vec), F.array().cast("array<double>"))
    finite = F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(parts, lambda v: v != 0))


def near_duplicates(rows: DataFrame, cosine: float = 0.93, cells: int = 16, recall: float = 0.995,
                    sample_size: int = 20_000, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row (vec_id,
    embedding, label).  The codebooks are fitted on at most ``sample_size``
    distinct vectors, those with the smallest hashes; every vector is filed."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = rows.withColumn("vec_key", F.sha2(F.concat_ws(",", F.coalesce(F.col("embedding").cast("array<string>"), F.array())).cast("binary"), 256))
    nodes = _valid(rows, "embedding").groupBy("label", "vec_key").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")  # numbered once, when written

    sample = nodes.select("embedding").orderBy(F.xxhash64("vec_key"), "vec_key").limit(sample_size).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.embedding), []).append(r.embedding)
    indexes = {n: fit_index(unit(np.array(v)), cosine, cells, recall) for n, v in by_size.items() if n > 1 and len(v) > 1}

    filed = written(_file(nodes, indexes, False), "filed")
    visits = written(_file(nodes, indexes, True), "visits")
    keys = ["label", "dim", "cell"]
    blocks = filed.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("filed_blocks")) \
        .join(visits.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("visit_blocks")), keys)
    spread = lambda df, own, other: df.join(blocks, keys).withColumn(own, F.pmod(F.xxhash64("node"), f"{own}_blocks")) \
        .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))) \
        .drop("filed_blocks", "visit_blocks")
    vectors = nodes.select("node", "copies", "embedding")
    left, right = (spread(df, own, other).join(vectors, "node").select(
        *(F.col(c).alias(c) for c in (*keys, "filed", "visit", "node", "copies", "embedding")))
        for df, own, other in ((filed, "filed", "visit"), (visits, "visit", "filed")))
    meet = [*keys, "filed", "visit"]
    found = written(left.groupBy(*meet).cogroup(right.groupBy(*meet)).applyInArrow(
        lambda a, b: _compare(a, b, indexes, cosine), "node long, links long, near long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    placed = nodes.select("label", "vec_key", "node", "vec_id", "copies").join(roots, "node", "left") \
        .join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = placed.join(least, "root").select(
        F.col("label").alias("own_label"), F.col("vec_key").alias("own_key"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "label", "vec_key").join(known, (F.col("label") == F.col("own_label")) & (F.col("vec_key") == F.col("own_key")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("own_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _file(nodes: DataFrame, indexes: dict[int, MultiIndex], visiting: bool) -> DataFrame:
    """(label, dim, cell, node): the cell of each node, or all it visits."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            sizes = np.array([len(v) for v in batch.column("embedding")])
            labels, node = batch.column("label").to_pylist(), batch.column("node").to_pylist()
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                index = indexes.get(n)
                if index is None:
                    out += [(labels[k], n, 0, node[k]) for k in at]
                    continue
                x = unit(np.array(batch.column("embedding").take(pa.array(at)).to_pylist()))
                cell, p, q = index.bounds(x)
                for r, k in enumerate(at):
                    out += [(labels[k], n, c, node[k]) for c in (index.visits(p[r], q[r]) if visiting else [int(cell[r])])]
            if out:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 ["label", "dim", "cell", "node"])

    return nodes.select("label", "node", "embedding").mapInArrow(run, "label string, dim int, cell int, node long")


def _compare(filed, visiting, indexes: dict[int, MultiIndex], cosine: float):
    """Verified links of one block: sums of links and a star per component."""
    import pyarrow as pa

    names, kinds = ["node", "links", "near"], [pa.int64()] * 3
    if not filed.num_rows or not visiting.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    read = lambda t: (t.column("node").to_numpy(), t.column("copies").to_numpy(), unit(np.array(t.column("embedding").to_pylist())))
    (a, a_copies, x), (b, b_copies, y) = read(filed), read(visiting)
    hits = np.argwhere((x @ y.T >= cosine) & (a[:, None] != b[None]))
    if not len(hits):
        return pa.table([pa.array([], k) for k in kinds], names)
    i, j = hits.T
    # the same pair also meets where b is filed, if a visits that cell: count it once
    index = indexes.get(x.shape[1])
    if index is None:
        both = np.ones(len(hits), bool)
    else:
        _, p, q = index.bounds(x)
        cell, _, _ = index.bounds(y)
        width = len(index.second.centres)
        both = p[i, cell[j] // width] + q[i, cell[j] % width] <= index.radius
    counted = ~both | (a[i] < b[j])
    nodes, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    u, v = place[:len(i)], place[len(i):]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, u[counted], b_copies[j[counted]])
    np.add.at(links, v[counted], a_copies[i[counted]])
    near = np.arange(len(nodes))
    while True:  # smallest reachable node, by halving paths
        before = near.copy()
        least = np.minimum(near[u], near[v])
        np.minimum.at(near, u, least)
        np.minimum.at(near, v, least)
        near = near[near]
        if (near == before).all():
            break
    return pa.table([pa.array(nodes), pa.array(links), pa.array(nodes[near])], names)
