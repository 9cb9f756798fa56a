"""Daily totals under a watermark: late rows, timers, bounded state."""

from datetime import datetime, timedelta

from linden.sources.tables import table
from linden.streaming import daily
from linden.streaming.edits import EDIT_SCHEMA
from tests.conftest import SMALL

EPOCH = datetime(1970, 1, 1)


def expected(rows, batches):
    """Plain loops over (batch, user, event, time): days that are out, late rows."""
    mark, seen, late, days = None, None, [], {}
    for b in range(batches):
        own = [r for r in rows if r[0] == b]
        for _, user, event, ts in own:
            if mark is not None and ts < mark:
                late.append((user, event))
            else:
                n, last = days.get((user, ts.date()), (0, (ts, event)))
                days[user, ts.date()] = (n + 1, max(last, (ts, event)))
        for *_, ts in own:
            seen = ts if seen is None else max(seen, ts)
        mark = None if seen is None else seen - timedelta(hours=1)
        mark = mark and mark.replace(microsecond=mark.microsecond // 1000 * 1000)
    out = [(u, d, n, e) for (u, d), (n, (_, e)) in days.items() if datetime.combine(d, datetime.min.time()) + timedelta(days=1) <= mark]
    return sorted(out), sorted(late)


def results(run):
    return sorted(map(tuple, run.closed_days().collect())), sorted(map(tuple, run.late().collect()))


def test_replay_equals_loops_and_state_is_bounded(spark):
    events = table(spark, SMALL, "events")
    timed = daily.arrivals(events, 4).select("batch", "user_id", "event_id", "ts").collect()
    want = expected([(r.batch, r.user_id, r.event_id, r.ts) for r in timed], 4)
    run = daily.replay(spark, events)
    assert results(run) == want and len(want[0]) > 100 and want[1]
    # a value and a timer for each user with an open day, however many rows came before
    users = events.select("user_id").distinct().count()
    assert len(run.state_rows) == 4 and max(run.state_rows) <= 8 * users < events.count()


def test_batch_that_is_written_again_and_empty_stream(spark):
    events = table(spark, SMALL, "events").limit(200)
    run = daily.replay(spark, events, 2)
    want = results(run)
    written = spark.read.schema(daily.OUTPUT).parquet(f"{run.root}/out/batch=1")
    run(spark.createDataFrame(written.collect(), daily.OUTPUT), 1)
    assert results(run) == want
    none = daily.replay(spark, spark.createDataFrame([], EDIT_SCHEMA), 1)
    assert results(none) == ([], [])


def test_state_does_not_grow_with_the_users(spark):
    """Users share state and timers; users without events of their own, null among them, keep days of their own."""
    rows = [(i, EPOCH + timedelta(days=i % 3, seconds=i), None if i % 401 == 0 else i % 4000, "view", 1.0, "{}") for i in range(8000)]
    events = spark.createDataFrame(rows, EDIT_SCHEMA)
    timed = daily.arrivals(events, 2).select("batch", "user_id", "event_id", "ts").collect()
    run = daily.replay(spark, events, 2)
    user = lambda u: -1 if u is None else u
    want = expected([(r.batch, user(r.user_id), r.event_id, r.ts) for r in timed], 2)
    got = sorted((user(u), *rest) for u, *rest in run.closed_days().collect()), sorted((user(u), e) for u, e in run.late().collect())
    assert got == want and any(u == -1 for u, *_ in want[0])
    # a value and a timer a day for each group of users
    assert max(run.state_rows) <= 8 * daily.GROUPS
