"""Edit streams: keep line text, dirty edits and postings current.

The edit log (``doc_id, line, text, ts, seq``) arrives as a stream, in any
order and split over any number of micro-batches.  ``foreachBatch`` appends
to tables under the shared checkpoint folder, one folder per batch id:

``log``       every edit of the batch with the base text of its line
``lines``     latest text of each line that the batch touches
``dirty``     dirty edits of those lines: text differs from the edit before
              in (ts, seq) order, or from the base line for the first one
``postings``  tokens of those lines

Rows of the last three replace what earlier batches say of the same line, so
a late edit puts its line right without rewriting other lines.  A batch reads
the log up to itself and writes only its own folders, then its commit marker:
a batch that runs again writes the same again, and readers see committed
batches alone.  Edits of a line that does not exist stay in the log and are
returned by ``rejected`` (their sender needs a full sync).

Range edits that change the number of lines are ``linden.streaming.splices``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linden.operators import lookup
from linden.operators.sequence import carry_last
from linden.session import scratch_path
from linden.sources import views

EDIT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LINE = ["doc_id", "line"]


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream over the files of the ``events`` table, be it one file or a folder."""
    # a pattern, because the source takes a plain path for a folder
    events = spark.readStream.schema(EDIT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def edit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming edit log replayed from the ``events`` table."""
    return views.edit_log(event_stream(spark, sf_dir))


def with_base(edits: DataFrame, base: DataFrame) -> DataFrame:
    """Edits with the ``base`` text of their line, null where there is none."""
    known = base.select(*LINE, F.col("text").alias("base"))
    return edits.select(*LINE, "text", "ts", "seq").join(known, LINE, "left")


def dirty_edits(edits: DataFrame) -> DataFrame:
    """(doc_id, line, seq, ts, text, dirty) for edits (``with_base``) of existing lines."""
    # Previous edit of the same line: blocked by event hour, so a line edited
    # very often is not one task.
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    found = carry_last(edits.where("base is not null"), F.col("text"), "_before", key=LINE, order=["ts", "seq"], block_col=hour)
    return found.select(*LINE, "seq", "ts", "text", (F.col("text") != F.coalesce("_before", "base")).alias("dirty"))


class EditApplier:
    """foreachBatch handler; its tables live under ``root``."""

    KINDS = {
        "log": "doc_id long, line int, text string, ts timestamp, seq long, base string",
        "lines": "doc_id long, line int, text string",
        "dirty": "doc_id long, line int, seq long",
        "postings": "doc_id long, t string, line int, n long",
        "commits": "done boolean",
    }

    def __init__(self, spark: SparkSession, base_lines: DataFrame, root: str, documents: DataFrame | None = None):
        """``documents`` (doc_id, text): those that ``base_lines`` are the lines of, if they are known."""
        self.spark, self.base, self.root, self.documents = spark, base_lines, root, documents
        for kind, schema in self.KINDS.items():  # so that every table can be read from the start
            spark.createDataFrame([], schema).write.mode("ignore").parquet(self._path(kind, -1))

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch={batch_id}"

    def _table(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.KINDS[kind]).parquet(f"{self.root}/{kind}")

    @property
    def version(self) -> int:
        """Last committed batch, -1 before the first."""
        return self._table("commits").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]

    def _newest(self) -> DataFrame:
        """(doc_id, line, batch): the committed batch that last touched each line."""
        return self._table("lines").where(F.col("batch") <= self.version).groupBy(*LINE).agg(F.max("batch").alias("batch"))

    def read(self, kind: str) -> DataFrame:
        """Current rows of ``lines`` or ``dirty``, or the postings of all lines
        of the edited documents."""
        rows = self._table(kind).join(self._newest(), [*LINE, "batch"]).drop("batch")
        if kind == "postings":
            newest = self._newest().select(*LINE)
            if self.documents is None:
                same = lookup.postings(views.tokens(self.base.join(newest, LINE, "left_anti")))
            else:
                same = lookup.document_postings(self.documents, newest)
            rows = rows.unionByName(same.select(rows.columns))
        return rows

    def rejected(self) -> DataFrame:
        """(doc_id, line, seq) of edits whose line does not exist."""
        return self._table("log").where((F.col("batch") <= self.version) & F.col("base").isNull()).select(*LINE, "seq")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        def write(kind: str, rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(self._path(kind, batch_id))

        write("log", with_base(batch, self.base))
        log = self._table("log").where(F.col("batch") <= batch_id)
        touched = log.where((F.col("batch") == batch_id) & F.col("base").isNotNull()).select(*LINE).distinct()
        log = log.join(touched, LINE, "left_semi")
        write("lines", log.groupBy(*LINE).agg(F.max_by("text", F.struct("ts", "seq")).alias("text")))
        write("dirty", dirty_edits(log).where("dirty").select(*LINE, "seq"))
        lines = self.spark.read.schema(self.KINDS["lines"]).parquet(self._path("lines", batch_id))
        write("postings", lookup.postings(views.tokens(lines)).select("doc_id", "t", "line", "n"))
        write("commits", self.spark.createDataFrame([(True,)], self.KINDS["commits"]))


def run_edit_stream(spark: SparkSession, sf_dir: str, base_lines: DataFrame, name: str = "edits",
                    root: str | None = None, documents: DataFrame | None = None) -> EditApplier:
    """Apply the whole available edit log (``availableNow``) and return the
    applier.  Passing the ``root`` of an earlier run resumes it (stream
    checkpoint and tables live there)."""
    root = root or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    applier = EditApplier(spark, base_lines, root, documents)
    q = (
        edit_stream(spark, sf_dir).writeStream.foreachBatch(applier)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return applier


def final_lines(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Batch twin: base lines with the latest edit of each existing line."""
    latest = edits.groupBy("doc_id", "line").agg(F.max_by("text", F.struct("ts", "seq")).alias("_new"))
    return base.join(latest, ["doc_id", "line"], "left").select(
        "doc_id", "line", F.coalesce("_new", "text").alias("text"))


def dirty_lines_batch(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Batch twin of the dirty-edit log: (doc_id, line, seq)."""
    return dirty_edits(with_base(edits, base)).where("dirty").select(*LINE, "seq")
