"""Splicing edits: the piece table against list slices, the stream in many
batches against a fold, replayed batches, edits out of range."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linden.plans.common import doc_lines
from linden.sources.tables import table
from linden.streaming import splices
from tests.conftest import SMALL


def text_of(doc, texts):
    out = []
    for label, _ in doc.directory:
        for src, start, n in doc.pieces(label):
            out += texts[src][start:start + n]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_piece_table_equals_list_slices(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(splices, "GAP", 4)  # gaps are used up and labelled anew
    rng = random.Random(seed)
    texts = {-1: [f"b{i}" for i in range(rng.choice([0, 1, 30]))]}
    n = len(texts[-1])
    doc = splices.Document([[0, n]] if n else [], {}.__getitem__, chunk=4)
    doc.loaded[0] = [(-1, 0, n)] if n else []
    want = list(texts[-1])
    for seq in range(400):
        a, new = rng.randrange(-1, len(want) + 2), rng.choice([0, 0, 1, 1, 2, 5])
        b = a + rng.choice([0, 0, 1, 1, 2, 9])
        texts[seq] = [f"{seq}.{k}" for k in range(new)]
        ok = 0 <= a <= b <= len(want)
        assert doc.splice(a, b, seq, new) == ok
        if ok:
            want[a:b] = texts[seq]
        assert text_of(doc, texts) == want
        labels = [label for label, _ in doc.directory]
        assert labels == sorted(set(labels)) and all(len(doc.pieces(x)) <= 6 for x in labels)
    assert not doc.splice(None, 0, 1, 1) and not doc.splice(0, None, 1, 1)


def fold(base, log):
    docs, bad = {d: list(lines) for d, lines in base.items()}, []
    edited = set()
    for r in sorted(log, key=lambda r: (r.ts, r.seq)):
        doc = docs.get(r.doc_id)
        if doc is None:
            bad.append((r.doc_id, r.seq, "document"))
        elif r.start is None or not 0 <= r.start <= r.stop <= len(doc):
            bad.append((r.doc_id, r.seq, "range"))
        else:
            doc[r.start:r.stop] = r.lines or []
        edited.add(r.doc_id)
    return sorted((d, i, t) for d in edited & docs.keys() for i, t in enumerate(docs[d])), sorted(bad, key=repr)


def state_of(tables, base):
    return sorted(map(tuple, tables.lines(base).collect())), sorted(map(tuple, tables.rejected().collect()), key=repr)


def test_stream_in_four_batches_equals_a_fold(spark, tmp_path):
    events = table(spark, SMALL, "events")
    cuts = [r[0] for r in events.select(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("p")).select(F.explode("p")).collect()]
    edges = [-float("inf"), *cuts, float("inf")]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    for a, b in zip(edges, edges[1:], strict=False):  # files in time order: a batch each
        events.where((us >= a) & (us < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    base = doc_lines(spark, SMALL)
    tables = splices.splices_of_events(spark, str(tmp_path), base)
    assert tables.spark.read.parquet(f"{tables.root}/commits").agg(F.max("batch")).first()[0] >= 3
    lines: dict = {}
    for r in base.orderBy("doc_id", "line").collect():
        lines.setdefault(r.doc_id, []).append(r.text)
    want = fold(lines, splices.splice_log(events).collect())
    assert state_of(tables, base) == want and len(want[0]) > 200 and want[1]
    one = splices.splices_of_events(spark, SMALL, base)
    assert state_of(one, base) == want
    # a batch that is written again changes nothing
    batch = spark.read.schema(splices.OUTPUT).parquet(f"{tables.root}/out/batch=2")
    tables(spark.createDataFrame(batch.collect(), splices.OUTPUT), 2)
    assert state_of(tables, base) == want


def test_late_nulls_and_missing_documents(spark, tmp_path):
    schema = "doc_id long, start int, stop int, lines array<string>, ts timestamp, seq long"
    base = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, line int, text string")
    t0 = datetime(2024, 1, 1)
    batches = [[(1, 1, 1, ["x", "y"], 5, 1), (9, 0, 0, ["z"], 5, 2), (None, 0, 0, ["z"], 5, 3)],
               [(1, 0, 0, ["late"], 4, 4), (1, None, 1, ["n"], 6, 5), (1, 0, 9, [], 7, 6), (1, 0, 4, None, 8, 7), (1, 0, 0, ["new"], 9, 8)]]
    for k, rows in enumerate(batches):
        rows = [(*r[:4], t0 + timedelta(seconds=r[4]), r[5]) for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    got = state_of(splices.run_splices(spark, stream, base), base)
    assert got[0] == [(1, 0, "new")]
    assert {*got[1]} == {(9, 2, "document"), (None, 3, "document"), (1, 4, "late"), (1, 5, "range"), (1, 6, "range")}
