"""Edit streams against their batch twins, splices, tree folds."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linden.operators import lookup
from linden.operators import records as rec
from linden.plans.common import doc_lines, edit_log
from linden.plans.records import STATE_TYPE
from linden.sources import views
from linden.sources.tables import table
from linden.streaming import changelog, compact, edits
from tests.conftest import SMALL


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as a folder of four files, late ones in every batch: a batch each."""
    root = str(tmp_path_factory.mktemp("events"))
    table(spark, SMALL, "events").repartition(4, F.xxhash64("event_id")).write.parquet(f"{root}/events.parquet")
    return root


def test_streams_in_many_batches_match_their_batch_twins(spark, folder):
    base, log = doc_lines(spark, SMALL), edit_log(spark, SMALL)
    a = edits.run_edit_stream(spark, folder, base)
    assert a.version == 3
    assert rows(a.read("dirty")) == rows(edits.dirty_lines_batch(base, log))
    known = log.join(base.select("doc_id", "line"), ["doc_id", "line"], "left_semi")
    assert rows(a.read("lines")) == rows(known.groupBy("doc_id", "line").agg(F.max_by("text", F.struct("ts", "seq"))))
    want = lookup.postings(views.tokens(edits.final_lines(base, log)))
    assert rows(a.read("postings").select("doc_id", "t", "line", "n")) == rows(want.select("doc_id", "t", "line", "n"))
    assert a.rejected().count() + known.count() == log.count()


def test_compaction_in_many_batches_matches_one(spark, folder):
    e = table(spark, SMALL, "events").select("event_id", "user_id", "event_type", "value", "ts")
    one = rec.compact_states(e, "user_id", F.col("event_type") == STATE_TYPE, "ts", "event_id").drop("ts")
    got = compact.compact_states_stream(spark, folder, STATE_TYPE)
    assert rows(got.select(sorted(got.columns))) == rows(one.select(sorted(one.columns)))
    one = rec.coalesce_latest(e, "user_id", "ts", "event_id").select("user_id", "batch_start", "event_id", "event_type")
    assert rows(compact.coalesce_latest_stream(spark, folder)) == rows(one)


def edits_of(spark, *found):
    return spark.createDataFrame([(1, line, text, datetime(2024, 1, day), seq) for line, text, day, seq in found],
                                 "doc_id long, line int, text string, ts timestamp, seq long")


def test_late_edits_replays_and_batches_without_dirty_edits(spark, tmp_path):
    base = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, line int, text string")
    a = edits.EditApplier(spark, base, str(tmp_path))
    assert a.version == -1 and rows(a.read("lines")) == []
    a(edits_of(spark, (0, "a", 1, 1), (7, "x", 1, 2), (None, "x", 1, 3)), 0)  # nothing dirty
    assert rows(a.read("dirty")) == [] and rows(a.rejected()) == [(1, 7, 2), (1, None, 3)]
    a = edits.EditApplier(spark, base, str(tmp_path))  # the driver starts again
    assert a.version == 0 and rows(a.read("lines")) == [(1, 0, "a")]
    late = edits_of(spark, (0, "old", 2, 6))
    a(edits_of(spark, (0, "new", 5, 5)), 1)
    for _ in range(2):  # the batch is replayed
        a(late, 2)
        assert rows(a.read("lines")) == [(1, 0, "new")]
        assert rows(a.read("dirty")) == [(1, 0, 5), (1, 0, 6)]
        assert rows(a.read("postings").select("line", "t", "n")) == [(0, "new", 1), (1, "b", 1)]
    a(edits_of(spark, (0, "new", 3, 7)), 3)  # the edit after it is not a change any more
    assert rows(a.read("dirty")) == [(1, 0, 6), (1, 0, 7)]


def test_stream_resumes_from_committed_state(spark):
    base = doc_lines(spark, SMALL)
    first = edits.run_edit_stream(spark, SMALL, base)
    want = rows(first.read("postings"))
    # A new driver-side applier on the same root: no new input, state recovered.
    again = edits.run_edit_stream(spark, SMALL, base, root=first.root)
    assert again.version == first.version
    assert rows(again.read("postings")) == want
