"""Splicing edits as a stream: ``doc[from:to] = lines`` over documents.

The state of a document is a piece table: pieces of consecutive lines of the
base document (``src`` = -1) or of an edit (``src`` = its seq), in chunks of at
most ``CHUNK`` pieces.  A line keeps its identity ``(src, index)`` for good.  A
chunk carries a label; labels rise along the document with gaps between them,
so an edit rewrites the chunks it touches and renumbers no line.  A chunk that
overflows is split and its second half gets a label in the gap; only if the gap
is used up are the chunks of that document labelled anew.

The stateful operator (``transformWithState``) keeps the directory of a
document's chunks and, apart, the chunks themselves, and reads those that an
edit touches.  It holds no text.  What it puts out is appended batch by batch:

``chunk``    the pieces of a chunk as of ``version`` (none: the chunk is gone)
``lines``    the new lines of an accepted edit
``rejected`` an edit that was not applied, with the reason: ``range`` (outside
             the document: its sender needs a full sync), ``document`` (no such
             document) or ``late`` (older than one already applied)

Edits of a batch are applied in (ts, seq) order.  A batch that runs again
replaces its folder, and readers see committed batches alone.  Edits of one
document depend on each other, so a document is one task's work in a batch;
its text is put together by joins, chunk by chunk.

Nulls: an edit with a null position or null bounds is out of range; null new
lines are none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from linden.session import materialize, scratch_path
from linden.streaming.edits import event_stream

CHUNK = 128
GAP = 1 << 40
BASE = -1
PIECES = "srcs array<long>, starts array<long>, sizes array<long>"
DIRECTORY = "version long, at long, seq long, labels array<long>, totals array<long>"
OUTPUT = f"doc_id long, kind string, seq long, label long, version long, {PIECES}, lines array<string>, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Document:
    """A document's chunks: ``directory`` lists [label, lines] in order, and
    ``load`` fetches the pieces of a label when they are first needed."""

    def __init__(self, directory: list[list[int]], load: Callable[[int], list[tuple]], chunk: int = CHUNK):
        self.directory, self.load, self.chunk = directory, load, chunk
        self.loaded: dict[int, list[tuple]] = {}
        self.touched: set[int] = set()

    def pieces(self, label: int) -> list[tuple]:
        if label not in self.loaded:
            self.loaded[label] = self.load(label)
        return self.loaded[label]

    def put(self, k: int, pieces: list[tuple]) -> None:
        label = self.directory[k][0]
        self.loaded[label] = pieces
        self.directory[k][1] = sum(n for *_, n in pieces)
        self.touched.add(label)

    def splice(self, start: int | None, stop: int | None, src: int, n: int) -> bool:
        """Lines [start, stop) replaced by ``n`` lines of ``src``; False if
        the range is outside the document."""
        if start is None or stop is None or not 0 <= start <= stop <= sum(n for _, n in self.directory):
            return False
        k, before = 0, 0
        while k < len(self.directory) - 1 and before + self.directory[k][1] <= start:
            before += self.directory[k][1]
            k += 1
        if not self.directory:
            self.directory.append([0, 0])
            self.loaded[0] = []
        first, todo, at = k, stop - start, start - before
        while True:  # cut [at, at + todo) out of chunk k, then out of those behind it
            size = self.directory[k][1]
            gone = min(todo, size - at)
            kept, upto = [], 0
            new = [(src, 0, n)] if k == first and n else []
            for s, b, m in self.pieces(self.directory[k][0]):
                head, tail = max(0, min(m, at - upto)), max(0, min(m, upto + m - at - gone))
                if head:
                    kept.append((s, b, head))
                if upto + m > at and new:  # the new lines go in front of what is cut or kept from here on
                    kept += new
                    new = []
                if tail and tail < m or tail and not head:
                    kept.append((s, b + m - tail, tail))
                upto += m
            if gone or k == first:
                self.put(k, kept + new)
            todo -= gone
            if not todo:
                break
            k, at = k + 1, 0
        for k in range(k, first - 1, -1):  # chunks left empty go, but for the first
            if not self.directory[k][1] and k != first:
                del self.directory[k]
        self.split(first)
        return True

    def split(self, k: int) -> None:
        own = self.pieces(self.directory[k][0])
        if len(own) <= self.chunk:
            return
        label = self.directory[k][0]
        after = self.directory[k + 1][0] if k + 1 < len(self.directory) else label + 2 * GAP
        middle = (label + after) // 2
        if middle == label:  # the gap is used up: label the chunks anew
            chunks = [self.pieces(old) for old, _ in self.directory]
            self.touched |= {old for old, _ in self.directory}
            self.loaded.update({old: [] for old, _ in self.directory})
            for i, pieces in enumerate(chunks):
                self.directory[i][0] = i * GAP
                self.put(i, pieces)
            label, middle = k * GAP, k * GAP + GAP // 2
        self.directory.insert(k + 1, [middle, 0])
        half = len(own) // 2
        self.put(k, own[:half])
        self.put(k + 1, own[half:])


class Splicer(StatefulProcessor):
    """Input: doc_id, start, stop, lines, at (microseconds), seq, base_lines."""

    def init(self, handle) -> None:
        self.directory = handle.getValueState("directory", DIRECTORY)
        self.chunks = handle.getMapState("chunks", "label long", PIECES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.at, r.seq))

        def out(kind, seq=None, label=None, version=None, pieces=(None, None, None), lines=None, reason=None):
            return Row(doc_id=key[0], kind=kind, seq=seq, label=label, version=version, srcs=pieces[0], starts=pieces[1], sizes=pieces[2],
                       lines=lines, reason=reason)

        load = lambda label: list(zip(*self.chunks.getValue((label,)), strict=True))
        if self.directory.exists():
            version, at, seq, labels, totals = self.directory.get()
            doc = Document([list(c) for c in zip(labels, totals, strict=True)], load)
        else:
            version, at, seq, n = 0, None, None, rows[0].base_lines
            doc = Document([[0, n]] if n else [], load)
            doc.loaded[0] = [(BASE, 0, n)] if n else []
            doc.touched.add(0)
        for r in rows:
            if r.base_lines is None:
                yield out("rejected", r.seq, reason="document")
            elif at is not None and (r.at, r.seq) <= (at, seq):
                yield out("rejected", r.seq, reason="late")
            else:
                at, seq = r.at, r.seq
                lines = list(r.lines or [])
                if doc.splice(r.start, r.stop, r.seq, len(lines)):
                    if lines:
                        yield out("lines", r.seq, lines=lines)
                else:
                    yield out("rejected", r.seq, reason="range")
        version += 1
        here = {label for label, _ in doc.directory}
        for label in sorted(doc.touched):
            own = doc.loaded.get(label, []) if label in here else []
            pieces = tuple([p[k] for p in own] for k in range(3))
            if label in here:
                self.chunks.updateValue((label,), pieces)
            elif self.chunks.containsKey((label,)):
                self.chunks.removeKey((label,))
            yield out("chunk", label=label, version=version, pieces=pieces)
        self.directory.update((version, at, seq, [label for label, _ in doc.directory], [n for _, n in doc.directory]))

    def close(self) -> None:
        pass


def line_counts(base: DataFrame) -> DataFrame:
    """(doc_id, base_lines) of lines (doc_id, line, text)."""
    return base.groupBy("doc_id").agg((F.max("line") + 1).cast("int").alias("base_lines"))


class SpliceTables:
    """What a run wrote under ``root``; ``__call__`` is its foreachBatch sink."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.createDataFrame([], OUTPUT).write.mode("ignore").parquet(f"{root}/out/batch=-1")
        spark.createDataFrame([], "done boolean").write.mode("ignore").parquet(f"{root}/commits/batch=-1")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/out/batch={batch_id}")
        self.spark.createDataFrame([(True,)], "done boolean").write.mode("overwrite").parquet(f"{self.root}/commits/batch={batch_id}")

    def rows(self, kind: str) -> DataFrame:
        last = self.spark.read.schema("done boolean").parquet(f"{self.root}/commits").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        return self.spark.read.schema(OUTPUT).parquet(f"{self.root}/out").where((F.col("batch") <= last) & (F.col("kind") == kind))

    def rejected(self) -> DataFrame:
        return self.rows("rejected").select("doc_id", "seq", "reason")

    def lines(self, base: DataFrame) -> DataFrame:
        """(doc_id, line, text): current lines of every document that was edited."""
        chunks = self.rows("chunk").groupBy("doc_id", "label").agg(F.max_by(F.arrays_zip("srcs", "starts", "sizes"), "version").alias("pieces"))
        size = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p.sizes)
        before = Window.partitionBy("doc_id").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
        placed = chunks.withColumn("size", size).where("size > 0").withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
        ids = F.flatten(F.transform("pieces", lambda p: F.transform(F.sequence(p.starts, p.starts + p.sizes - 1), lambda i: F.struct(p.srcs.alias("src"), i.cast("int").alias("i")))))
        rows = placed.select("doc_id", "first", F.posexplode(ids).alias("at", "id")) \
            .select("doc_id", (F.col("first") + F.col("at")).cast("int").alias("line"), "id.src", "id.i")
        old = base.select("doc_id", F.lit(BASE).cast("long").alias("src"), F.col("line").alias("i"), "text")
        new = self.rows("lines").select("doc_id", F.col("seq").alias("src"), F.posexplode("lines").alias("i", "text"))
        return rows.join(old.union(new), ["doc_id", "src", "i"]).select("doc_id", "line", "text")


def splice_log(events: DataFrame) -> DataFrame:
    """Splices replayed from ``events``: (doc_id, start, stop, lines, ts, seq).
    At line k / 4 signups insert two lines, clicks one; views replace that line,
    errors delete it, purchases put one line in the place of three."""
    k = F.floor(F.get_json_object("props", "$.k").try_cast("int") / 4).cast("int")
    kind = F.col("event_type")
    line = lambda n: F.concat(kind, F.lit(f":{n}:"), F.col("event_id").cast("string"))
    width = F.when(kind.isin("view", "error"), 1).when(kind == "purchase", 3).otherwise(0)
    lines = F.when(kind == "signup", F.array(line(1), line(2))).when(kind == "error", F.array().cast("array<string>")).otherwise(F.array(line(1)))
    return events.select(F.col("user_id").alias("doc_id"), k.alias("start"), (k + width).alias("stop"), lines.alias("lines"), "ts", F.col("event_id").alias("seq"))


def run_splices(spark: SparkSession, edits: DataFrame, base: DataFrame, root: str | None = None) -> SpliceTables:
    """Apply all available ``edits`` (a stream, see ``splice_log``) to
    documents given by their lines; the ``root`` of an earlier run resumes it."""
    root = root or scratch_path(spark, f"stream-splices-{uuid.uuid4().hex[:12]}")
    tables = SpliceTables(spark, root)
    sized = edits.join(materialize(line_counts(base), "line-counts"), "doc_id", "left") \
        .select("doc_id", "start", "stop", "lines", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "base_lines")
    with rocksdb_state(spark):
        changes = sized.groupBy("doc_id").transformWithState(Splicer(), OUTPUT, "append", "None")
        changes.writeStream.foreachBatch(tables).outputMode("append").option("checkpointLocation", f"{root}/_checkpoint") \
            .trigger(availableNow=True).start().awaitTermination()
    return tables


def splices_of_events(spark: SparkSession, sf_dir: str, base: DataFrame) -> SpliceTables:
    return run_splices(spark, splice_log(event_stream(spark, sf_dir)), base)
