"""SentencePiece ids and decoding against the library, whole texts."""

import hashlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from linden.llm import pieces
from linden.llm.common import tokenizer_path
from linden.llm.queries import QUERIES
from tests.conftest import SMALL

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
BPE = pieces.Pieces(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁  \n\taaabthe<0xA>éñ梦�\x00"),
                                         st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_ids_and_text_equal_the_library(texts):
    ids = BPE.encode(texts)
    assert [x.tolist() for x in ids] == [library_ids(t) for t in texts]
    assert BPE.decode(ids) == [LIBRARY.decode(x.tolist()) for x in ids]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, LIBRARY.get_piece_size() - 1) | st.integers(3, 258), max_size=30))
def test_decode_of_any_ids(ids):
    if 0 in ids:
        ids = [i for i in ids if i]
    assert BPE.decode([np.array(ids, np.uint32)]) == [LIBRARY.decode(ids)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinorst ", min_size=0, max_size=400))
def test_long_runs_of_few_letters(text):
    assert BPE.encode([text])[0].tolist() == library_ids(text)


def test_one_long_word():
    text = "thanerinenatouingeron" * 500 + "a" * 3000 + " " * 300
    assert BPE.encode([text])[0].tolist() == library_ids(text)


def test_query_equals_library(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library_ids(d.text or "")
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "a  b ", "z")],
                                 "doc_id long, text string, ids string")
    out = pieces.encode(docs, PATH, decoded=True)
    assert out.columns == ["doc_id", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == 4
    got = {(r.doc_id, r.decoded): np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    assert got == {(1, ""): [1, 2], (None, ""): [1, 2], (2, "a  b "): library_ids("a  b ")}
    assert [r.decoded for r in pieces.decode(out.drop("decoded"), PATH).collect()] == [r.decoded for r in rows]
    assert pieces.encode(docs.limit(0), PATH).count() == 0
