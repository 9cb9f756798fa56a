"""Packing: exact dynamic program, whole ids, little padding, edge cases."""

import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linden.llm import packing
from linden.llm.common import tokenizer_path
from linden.llm.queries import QUERIES
from tests.conftest import SMALL

PATH = tokenizer_path("word_bpe_49k.json")


def cost_of(chosen, cuts, pens, window):
    total, begin, pen = 0.0, 0, dict(zip(cuts, pens, strict=True))
    for end in chosen:
        n = end - begin
        if n > window:
            return float("inf")
        total += pen[end] + (0 if n in (256, 512) and n < window else window - n)
        begin = end
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.sampled_from([0.0, 24.0, 64.0])), min_size=1, max_size=9))
def test_plan_is_the_cheapest(steps):
    cuts = np.cumsum([s for s, _ in steps])
    pens = np.array([p for _, p in steps])
    got = packing.plan(cuts, pens, 600, True)
    inner = cuts[:-1].tolist()
    every = [[*c, int(cuts[-1])] for n in range(len(inner) + 1) for c in itertools.combinations(inner, n)]
    best = min(cost_of(c, cuts.tolist(), pens, 600) for c in every)
    assert cost_of(got, cuts.tolist(), pens, 600) == best


def test_tail_in_powers_of_two():
    assert packing.halve_tail(4096, 4096) == [4096]
    assert packing.halve_tail(3000, 4096) == [2048, 512, 256, 128, 32, 16, 8]
    assert sum(packing.halve_tail(4095, 4096)) == 4095


def padding(pieces):
    totals = {}
    for r in pieces:
        totals[r.sequence_id] = totals.get(r.sequence_id, 0) + r.length
    assert max(totals.values()) <= 4096
    return sum(4096 - n for n in totals.values() if n & (n - 1)) / sum(totals.values())


def check_pieces(pieces, texts):
    t = Tokenizer.from_file(PATH)
    keys = list(texts)
    want = {k: np.array([*e.ids, 2], "<u4") for k, e in
            zip(keys, t.encode_batch([texts[k] or "" for k in keys], add_special_tokens=False), strict=True)}
    at, sequences = {k: 0 for k in want}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {k: len(v) for k, v in want.items()}
    for own in sequences.values():
        upto = 0
        for offset, length in sorted(own):
            assert offset == upto
            upto += length


def test_query_keeps_every_id_with_little_padding(spark):
    pieces = QUERIES["op9_packing"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check_pieces(pieces, {d.doc_id: d.text for d in docs})
    assert padding(pieces) < 0.01


def test_stretches_are_carried_over(spark):
    docs = spark.createDataFrame([(i, "A sentence of words. " * (i * 7 % 90)) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(docs.coalesce(1), PATH, span=9000).selectExpr("*", "crc32(ids) ids_crc32").collect()
    check_pieces(rows, {r.doc_id: r.text for r in docs.collect()})
    assert padding(rows) < 0.02


def test_nulls_long_texts_repeats_and_order(spark):
    texts = {None: "a b", 1: None, 2: "", 3: "junk " * 9000, 4: "x" * 50000}
    docs = spark.createDataFrame([(k, v, 9) for k, v in texts.items()], "doc_id long, text string, length long")
    rows = packing.pack(docs, PATH).selectExpr("*", "crc32(ids) ids_crc32").collect()
    check_pieces(rows, texts)
    twice = packing.pack(docs.union(docs), PATH).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in rows)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_every_letter_before_a_stop_or_comma():
    """The ids of texts that end in any character and a stop or comma are the library's."""
    from linden.llm.wordids import WordIds

    t = Tokenizer.from_file(PATH)
    texts = [f"{b}{chr(c)}{e} x" for c in range(0x21, 0x20000) if not 0xD800 <= c < 0xE000 for b, e in (("", "."), ("ab", ","))]
    own = WordIds(PATH)
    for k in range(0, len(texts), 40_000):
        part = texts[k:k + 40_000]
        ids, counts, *_ = own.encode(part)
        want = [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
        upto = np.cumsum(counts)
        for i, w in enumerate(want):
            assert ids[upto[i] - counts[i]:upto[i]].tolist() == w, part[i]


def test_encoder_remembers_a_bounded_number_of_words():
    """Every worker of an executor holds one; forgetting words changes no id."""
    from linden.llm.common import tokenizer_path
    from linden.llm.wordids import WordIds

    path = tokenizer_path("word_bpe_49k.json")
    own = WordIds(path)
    assert own.memory <= 200_000
    small, texts = WordIds(path, memory=50), [f"word{k} longerword{k * 7919} some, of it." for k in range(300)]
    for at in range(0, 300, 20):
        a, b = own.encode(texts[at:at + 20]), small.encode(texts[at:at + 20])
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
        assert len(small.code) <= 50 + 20 * 5 * 2
