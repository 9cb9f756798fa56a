"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents, in doc_id order, form one row of token ids (each document followed
by its end id).  The row is cut into sequences of at most ``window`` ids at
document ends, sentence ends or, inside long stretches without either, at
every ``stride`` ids.  With T_i the position of candidate cut i,

    cost[j] = penalty[j] + min over i, T_j - T_i <= window, of
              cost[i] + (0 if T_j - T_i is a power of two else window - (T_j - T_i))

Padding is linear in T_i, so the minimum is that of cost[i] + T_i over a
sliding range of i, which a monotone queue yields in constant time; the few
powers of two are looked up directly.  The DP runs over stretches of about
``span`` ids of one range partition and carries what lies behind its best cut
into the next stretch, so memory is bounded and no stretch ends padded.  The
rest at the end of a partition is cut into powers of two where that is
cheaper than padding it.

Nulls and edge cases: a null or empty text is one end id; a null doc_id sorts
first; rows that repeat a doc_id are separate documents ordered by text; a
document longer than a window is cut into several pieces; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from linden.llm.common import chunks
from linden.llm.wordids import encoder

#: Cost of a cut, in ids of padding: at a document's end, a sentence's end, elsewhere.
DOCUMENT, SENTENCE, ELSEWHERE = 0.0, 24.0, 64.0
SCHEMA = ("doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, sequence_tokens long")


def candidates(sizes: np.ndarray, stops: np.ndarray, stride: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts (ascending, the last at the end) and their penalties.
    ``sizes``: ids per document; ``stops``: ascending positions of sentence ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    stops = stops[(stops > 0) & (stops < total)]
    cuts = np.concatenate([ends, stops])
    cost = np.repeat([DOCUMENT, SENTENCE], [len(ends), len(stops)])
    order = np.argsort(cuts, kind="stable")  # on ties the document's end comes first
    cuts, cost = cuts[order], cost[order]
    gaps = np.diff(cuts, prepend=0)
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        fill = np.concatenate([np.arange(cuts[k] - gaps[k] + stride, cuts[k], stride) for k in wide])
        place = np.searchsorted(cuts, fill)
        cuts, cost = np.insert(cuts, place, fill), np.insert(cost, place, ELSEWHERE)
    fresh = np.diff(cuts, prepend=0) > 0
    return cuts[fresh], cost[fresh]


def plan(cuts: np.ndarray, cost: np.ndarray, window: int, last: bool) -> list[int]:
    """Positions of the chosen cuts, ascending.  Unless ``last``, it ends at
    the cheapest cut of the final window instead of the last candidate."""
    known = np.concatenate([[0], cuts])
    free: dict[int, list[int]] = {}  # candidates a power of two behind
    for p in (1 << k for k in range(8, window.bit_length()) if 1 << k < window):
        back = np.searchsorted(known, known - p)
        for j in np.flatnonzero(known[back] == known - p).tolist():
            free.setdefault(j, []).append(int(back[j]))
    at, pen = known.tolist(), [0.0, *cost.tolist()]
    best, came = [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(at)):
        t = at[j]
        low, i = queue[0]
        while at[i] < t - window:
            queue.popleft()
            low, i = queue[0]
        low += window - t
        if j in free:
            for k in free[j]:
                if best[k] < low:
                    low, i = best[k], k
        low += pen[j]
        best.append(low)
        came.append(i)
        low += t
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, j))
    j = len(at) - 1
    if not last:
        j = min((k for k in range(j, 0, -1) if at[k] > at[-1] - window), key=lambda k: best[k])
    chosen = []
    while j:
        chosen.append(at[j])
        j = came[j]
    return chosen[::-1]


def halve_tail(length: int, window: int) -> list[int]:
    """Sizes into which a final sequence of ``length`` ids is cut: powers of
    two, largest first, as far as that costs less than the padding saved."""
    def padding(n: int) -> int:
        return 0 if n & (n - 1) == 0 else window - n

    taken, rest, best = [], length, (padding(length) * 1.0, [length])
    while rest:
        taken.append(1 << (rest.bit_length() - 1))
        rest -= taken[-1]
        cost = ELSEWHERE * (len(taken) - (not rest)) + padding(rest)
        if cost < best[0]:
            best = (cost, [*taken, *([rest] if rest else [])])
    return best[1]


class Packer:
    """Packs the documents of one task in the order they are given."""

    def __init__(self, part: int, window: int, span: int):
        self.window, self.span, self.sequence = window, span, part << 32
        self.docs: list[tuple] = []  # (key, ids, first id not yet packed)
        self.stops: list[np.ndarray] = []  # sentence ends, counted from the first id not yet packed
        self.held = 0

    def add(self, key, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple]:
        self.docs.append((key, ids, 0))
        self.stops.append(stops + self.held)
        self.held += len(ids)
        if self.held >= self.span:
            yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        sizes = np.array([len(ids) - done for _, ids, done in self.docs], np.int64)
        stops = np.concatenate(self.stops)
        chosen = plan(*candidates(sizes, stops), self.window, last)
        if last:
            tail = chosen.pop() - (begin := chosen[-1] if chosen else 0)
            chosen += (begin + np.cumsum(halve_tail(tail, self.window))).tolist()
        begin = 0
        for end in chosen:
            yield from self.emit(end - begin)
            begin = end
        self.held -= begin
        self.stops = [stops[stops > begin] - begin]
        self.docs = self.docs[self.first:]
        self.first = 0

    first = 0

    def emit(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            key, ids, done = self.docs[self.first]
            n = min(len(ids) - done, length - offset)
            yield key, done, n, ids[done:done + n].tobytes(), len(ids), self.sequence, offset, length
            if done + n == len(ids):
                self.first += 1
            else:
                self.docs[self.first] = (key, ids, done + n)
            offset += n
        self.sequence += 1


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, span: int = 1 << 20) -> DataFrame:
    """One row per piece of a document of ``docs`` (doc_id, text): doc_id,
    start, length, ids (packed little-endian u32), doc_tokens, sequence_id,
    offset in the sequence and sequence_tokens."""
    import pyarrow as pa
    from pyspark import TaskContext

    docs = docs.select("doc_id", "text")
    schema = SCHEMA.format(key=docs.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId(), window, span)
        kinds = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            keys = batch.column(0).to_pylist()
            for a, _, texts in chunks(batch.column(1)):
                ids, sizes, stops, offsets = words.encode(texts)
                edges = [np.searchsorted(stops, offsets, "right"), np.searchsorted(stops, offsets + sizes, "left")]
                rows: list[tuple] = []
                for k, (o, n) in enumerate(zip(offsets.tolist(), sizes.tolist(), strict=True)):
                    own = np.append(ids[o:o + n], np.uint32(end_id))
                    rows += packer.add(keys[a + k], own, stops[edges[0][k]:edges[1][k]] - o)
                if rows:
                    yield batch_of(rows)
        if kinds and (rows := list(packer.pack(True))):
            yield batch_of(rows)

    return docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)
