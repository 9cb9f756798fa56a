"""Quality classifier: regularised quadratic discriminant over text statistics.

Each whole text becomes a fixed vector of transformed statistics (lengths,
shares of character classes, repetition, and the same shares in the text's
worst window).  Both classes get a mean and a covariance shrunk towards a
multiple of the identity; the Cholesky factor of each is inverted once and
travels with the model, so a score costs two small matrix products: the
difference of the Mahalanobis log-densities plus the log prior odds, softened
by ``temper`` and put through the logistic function.

Fitting sums products per class on the executors; the driver receives as many
numbers as the statistics have products, whatever the input's size.

Nulls and edge cases: a null text is an empty one and gets a score like any
other; rows whose label or doc_id is null are not learned from; a document
labelled twice counts twice; without labels of both classes every score is
the share of label 1 (0.5 without labels); an empty table gives no rows;
input columns named as a result column are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

WINDOW = 512  # code points of a window
UPPER, LOWER, DIGIT, BLANK, STOP, MARK = range(6)


def _classes() -> np.ndarray:
    table = np.full(0x110000, MARK, np.int8)
    for c in range(0x3000):
        s = chr(c)
        table[c] = UPPER if s.isupper() else LOWER if s.isalpha() else DIGIT if s.isdigit() else \
            BLANK if s.isspace() else STOP if s in ".,;:'\"-!?()" else MARK
    table[0x3000:0xD800] = LOWER
    table[0x3000] = BLANK
    return table


TABLE: list[np.ndarray] = []


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text."""
    if not TABLE:
        TABLE.append(_classes())
    kind = TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    n = len(kind)
    words = text.lower().split()
    m = len(words)
    steps = np.arange(0, max(n, 1), WINDOW)
    if len(steps) > 1 and n - steps[-1] < WINDOW // 2:
        steps = steps[:-1]
    widths = np.diff(np.append(steps, n)).clip(1)
    shares, worst = [], []
    for k in (UPPER, DIGIT, STOP, MARK, BLANK):
        flags = kind == k
        shares.append(np.sqrt(flags.sum() / max(n, 1)))
        worst.append(np.sqrt((np.add.reduceat(flags, steps, dtype=np.int64) / widths).max()) if n else 0.0)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(str.__eq__, words, words[1:]))
    # the worst of windows of 64 words: fewest different words
    fresh = min((len(set(words[i:i + 64])) / len(words[i:i + 64]) for i in range(0, max(m - 31, 1), 64)), default=1.0) if m else 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    size = np.fromiter(map(len, words), np.float64, m)
    packed = len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / max(len(text), 1)
    return [
        np.log1p(m),
        np.log1p(n / max(m, 1)),
        np.log1p(size.std() if m else 0.0),
        *shares,
        *worst,
        np.log1p(len(counts)) / np.log1p(max(m, 1)),
        np.sqrt(max(counts.values(), default=0) / max(m, 1)),
        np.sqrt(1 - pairs / max(m - 1, 1)) if m > 1 else 0.0,
        np.sqrt(same / max(m - 1, 1)),
        fresh,
        np.log1p(m / max(len(lines), 1)),
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)),
        np.sqrt(sum(w[-1] in ".!?" for w in words) / max(m, 1)),
        np.log(min(max(packed, 0.01), 10.0)),
    ]


SIZE = 22


def vectors(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``stats`` array<double>; ``drop_text`` leaves the text out."""
    import pyarrow as pa

    rest = [c for c in docs.columns if c != "stats"]
    kept = [c for c in rest if not (drop_text and c == text)]
    docs = docs.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py() or "") for t in batch.column(rest.index(text))]
            flat = pa.array(np.array(found, np.float64).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, SIZE * len(found) + 1, SIZE, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(rest.index(c)) for c in kept), lists], [*kept, "stats"])

    fields = [f for f in docs.schema if f.name in kept]
    return docs.mapInArrow(run, StructType([*fields, StructField("stats", ArrayType(DoubleType()))]))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors, log determinants and log prior odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        logs = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / self.temper + self.log_odds, -700, 700)))


def fit(examples: DataFrame, shrinkage: float = 0.02, temper: float = 4.0) -> Discriminant:
    """Fit on rows (label 0 or 1, stats).  ``shrinkage``: share of the
    identity's multiple in each covariance; ``temper``: what the difference
    of log-densities is divided by, since statistics are not independent."""
    import pyarrow as pa

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + SIZE + SIZE * SIZE))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["place", "part"])

    rows = examples.where("label in (0, 1)").select(F.col("label").cast("int"), "stats") \
        .mapInArrow(sums, "place long, part double").groupBy("place").agg(F.sum("part").alias("total")).collect()
    total = np.zeros(2 * (1 + SIZE + SIZE * SIZE))
    for r in rows:
        total[r.place] = r.total
    total = total.reshape(2, -1)
    n = total[:, 0]
    odds = float(np.log(max(n[1], 0.5) / max(n[0], 0.5)))
    if min(n) < 1:
        return Discriminant(np.zeros((0, SIZE)), np.zeros((0, SIZE, SIZE)), np.zeros(0), odds, temper)
    means = total[:, 1:1 + SIZE] / n[:, None]
    seconds = total[:, 1 + SIZE:].reshape(2, SIZE, SIZE) / n[:, None, None]
    covariances = seconds - means[:, :, None] * means[:, None, :]
    scale = np.sqrt(np.clip((n[:, None] * np.diagonal(covariances, axis1=1, axis2=2)).sum(0) / n.sum(), 1e-8, None))
    factors, dets = [], []
    for c in covariances:
        c = c / scale[:, None] / scale
        c = (1 - shrinkage) * c + shrinkage * max(np.trace(c) / SIZE, 1e-3) * np.eye(SIZE)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low) / scale)
        dets.append(2 * np.log(np.diagonal(low)).sum())
    return Discriminant(means, np.array(factors), np.array(dets), odds, temper)


def add_scores(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Rows with ``stats`` get ``score`` instead."""
    import pyarrow as pa

    rest = [c for c in rows.columns if c not in ("stats", "score")]
    rows = rows.select(*rest, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(rest)).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], [*rest, "score"])

    fields = [f for f in rows.schema if f.name != "stats"]
    return rows.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def held_out(doc_id: str) -> Column:
    """Rows that fitting must not see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def examples_of(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, stats) of the labelled rows that are not held out."""
    known = labels.where(~held_out("doc_id") & F.col("quality").isNotNull()) \
        .select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label"))
    return stats.select("doc_id", "stats").join(known, F.col("doc_id") == F.col("labelled_id")).select("label", "stats")


def classify(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if score >= threshold), in
    one pass through Python."""
    import pyarrow as pa

    docs = docs.select(*[c for c in docs.columns if c not in ("stats", "score", "predicted")])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py() or "") for t in batch.column(at)], np.float64).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(found))], [*batch.schema.names, "score"])

    rows = docs.mapInArrow(run, StructType([*docs.schema, StructField("score", DoubleType())]))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
