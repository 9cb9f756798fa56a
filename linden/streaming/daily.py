"""Daily totals of an event stream under a watermark, with a table of late rows.

Rows may arrive up to ``DELAY`` after later ones.  The open days of the users
of one of ``GROUPS`` groups (by hash) are kept in the state of a
``transformWithState`` operator, a few numbers per user and day; an event-time
timer at the day's end (plus the delay, by way of the watermark) puts the day
of all these users out and drops it from the state, so the state holds the days
that can still change and nothing else.  A call to Python, its state and its
timers serve a group, so their number doesn't grow with the users.  A row older than the watermark belongs to
no open day; it is neither dropped nor mixed into a day that is already out,
but returned in the ``late`` rows, as it came.

Spark removes late rows before a stateful operator if the operator's input has
the event-time column.  Here it carries the time as a plain number, so the
watermark still moves and drives the timers, and the operator sees late rows.

Nulls: rows without a user are a user of their own; rows without a time are
late (no day can be told).  Ties in time are decided by ``event_id``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from linden.session import materialize, scratch_path
from linden.streaming.edits import EDIT_SCHEMA
from linden.streaming.splices import rocksdb_state

DELAY = "1 hour"
DAY_MS = 86_400_000
GROUPS = 1024
DAYS = "days array<long>, users array<long>, counts array<long>, last_at array<long>, last_id array<long>"
OUTPUT = "kind string, user_id long, day long, n long, event_id long, at long"


class DailyTotals(StatefulProcessor):
    """Input: group (the key), user_id, event_id, at (microseconds)."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", DAYS)

    def days(self) -> dict[int, dict[int | None, tuple[int, int, int]]]:
        """(rows, last time, last event) by day and user."""
        days: dict = {}
        if self.open.exists():
            for day, user, *rest in zip(*self.open.get(), strict=True):
                days.setdefault(day, {})[user] = tuple(rest)
        return days

    def keep(self, days: dict) -> None:
        if days:
            rows = [(day, user, *rest) for day, users in days.items() for user, rest in users.items()]
            self.open.update(tuple(map(list, zip(*rows, strict=True))))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, days = timerValues.getCurrentWatermarkInMs(), self.days()
        for r in rows:
            if r.at is None or r.at // 1000 < mark:
                yield Row(kind="late", user_id=r.user_id, day=None, n=None, event_id=r.event_id, at=r.at)
                continue
            day = r.at // 1000 // DAY_MS
            if day not in days:
                days[day] = {}
                self.handle.registerTimer((day + 1) * DAY_MS)
            n, at, last = days[day].get(r.user_id) or (0, r.at, r.event_id)
            at, last = max((at, last), (r.at, r.event_id))
            days[day][r.user_id] = (n + 1, at, last)
        self.keep(days)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        days = self.days()
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        if day in days:
            users = days.pop(day)
            self.keep(days)
            for user, (n, at, last) in users.items():
                yield Row(kind="day", user_id=user, day=day, n=n, event_id=last, at=at)

    def close(self) -> None:
        pass


def arrivals(events: DataFrame, batches: int, late: int = 40) -> DataFrame:
    """``events`` with the ``batch`` they arrive in: equal spans of time, and
    every ``late``-th event one batch after its own."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(at), F.max(at)).first()
    if first is None:
        return events.withColumn("batch", F.lit(0))
    own = F.floor((at - first) * batches / (last - first + 1))
    return events.withColumn("batch", F.least(F.lit(batches - 1), own + (F.col("event_id") % late == 7).cast("int")).cast("int"))


class DailyRun:
    """A stream over the files below ``{root}/in`` and what it wrote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.state_rows: list[int] = []
        spark.createDataFrame([], OUTPUT).write.mode("ignore").parquet(f"{root}/out/batch=-1")
        spark.createDataFrame([], EDIT_SCHEMA).write.mode("ignore").parquet(f"{root}/in")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/out/batch={batch_id}")

    def advance(self) -> None:
        """Take in what has arrived since the last call, then let timers fire."""
        events = self.spark.readStream.schema(EDIT_SCHEMA).parquet(f"{self.root}/in").withColumn("time", F.col("ts").cast("timestamp"))
        rows = events.withWatermark("time", DELAY).select(
            F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("group"), "user_id", "event_id", F.unix_micros("time").alias("at"))
        with rocksdb_state(self.spark):
            query = rows.groupBy("group").transformWithState(DailyTotals(), OUTPUT, "append", "EventTime") \
                .writeStream.foreachBatch(self).outputMode("append").option("checkpointLocation", f"{self.root}/_checkpoint") \
                .trigger(availableNow=True).start()
            query.awaitTermination()
        self.state_rows += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:] if p["stateOperators"]]

    def rows(self, kind: str) -> DataFrame:
        return self.spark.read.schema(OUTPUT).parquet(f"{self.root}/out").where(F.col("kind") == kind)

    def closed_days(self) -> DataFrame:
        """(user_id, day, n, last_event): days that can change no more."""
        return self.rows("day").select("user_id", F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "n", F.col("event_id").alias("last_event"))

    def late(self) -> DataFrame:
        """(user_id, event_id): rows that came after their time."""
        return self.rows("late").select("user_id", "event_id")


def replay(spark: SparkSession, events: DataFrame, batches: int = 4) -> DailyRun:
    """``events`` streamed as they would arrive (``arrivals``)."""
    run = DailyRun(spark, scratch_path(spark, f"stream-daily-{uuid.uuid4().hex[:12]}"))
    timed = materialize(arrivals(events, batches), "arrivals")
    for b in range(batches):
        timed.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{run.root}/in")
        run.advance()
    return run
