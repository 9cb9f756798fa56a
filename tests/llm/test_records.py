"""Record files: framing, whole texts against the library, any read order."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linden.llm import records
from linden.llm.common import fresh_path, tokenizer_path
from linden.llm.queries import QUERIES
from linden.llm.wordids import WordIds
from tests.conftest import SMALL

PATH = tokenizer_path("word_bpe_49k.json")


def library_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0 　'.!?sStT́eΣİ"),
                                         st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_word_ids_equal_the_library(texts):
    ids, sizes, _, offsets = WordIds(PATH).encode(texts)
    assert [ids[o:o + n].tolist() for o, n in zip(offsets, sizes, strict=True)] == library_ids(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|",
                                          "|>", "Word", "É", ".", ",", "!", " ", "\n", "Σ"]), max_size=12).map("".join), max_size=4))
def test_markers_in_any_case_equal_the_library(texts):
    texts += ["a <|EndOfText|> b", "A<|ENDOFTEXT|>B.", "<|endoftext|>Word <|StartOfText|>, X"]
    ids, sizes, _, offsets = WordIds(PATH).encode(texts)
    assert [ids[o:o + n].tolist() for o, n in zip(offsets, sizes, strict=True)] == library_ids(texts)


def test_frame_detects_damage():
    data = records.frame(b"\x02abc")
    assert records.unframe(data) == b"\x02abc"
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        records.unframe(data[:-1])


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_token_records"](spark, SMALL).collect()}
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    start = 0
    assert len(rows) == len(docs)
    for d, ids in zip(docs, library_ids([x.text or "" for x in docs]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_nulls_repeats_order_and_small_shards(spark):
    docs = spark.createDataFrame(
        [(3, "b b", 1), (None, "x", 2), (3, "a", 3), (1, None, 4), (2, "", 5), (9, "long " * 5000, 6)],
        "doc_id long, text string, n_tokens long")
    folder = fresh_path(spark, "records-test")
    index = records.write_records(docs, folder, PATH, shard_bytes=64)
    back = records.read_records(records.with_starts(index).orderBy(F.rand(1)), folder).orderBy("start").collect()
    texts = ["x", "", "", "a", "b b", "long " * 5000]
    assert [r.doc_id for r in back] == [None, 1, 2, 3, 3, 9]
    start = 0
    for r, ids in zip(back, library_ids(texts), strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == [*ids, 2]
        assert r.start == start
        start += r.n_tokens


def test_empty_table(spark):
    folder = fresh_path(spark, "records-test")
    index = records.write_records(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    assert records.read_records(records.with_starts(index), folder).count() == 0


def test_wide_ids():
    ids = np.array([1, 70000], np.uint32)
    assert records.deserialize(records.serialize(ids)).tolist() == [1, 70000]
