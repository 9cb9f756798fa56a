"""Chat formatting: folding of events, reversible escapes, spans, digests."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linden.llm import chat
from linden.llm.queries import QUERIES
from tests.conftest import SMALL

CONTROL = ["[INST] ", " [/INST]", "<s> ", " </s>", "<<SYS>> ", "[ROLE] ", " [TEXT] ", "\\", "<", "[", "<\\", "\n", "é", "𝄞", "$1", " "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def parsed(spark, turns):
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.parse(chat.format_conversations(chat.events_of(rows), F.col("position.turn")))
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_control_strings(spark):
    turns = []

    @settings(max_examples=60, deadline=None, database=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a [TEXT] \\b", "<s> "]),
                              st.lists(st.sampled_from(CONTROL), max_size=6).map("".join)), min_size=1, max_size=6))
    def gather(own):
        turns.append(own)

    gather()
    got = parsed(spark, [(c, t, r, x) for c, own in enumerate(turns) for t, (r, x) in enumerate(own)])
    for c, own in enumerate(turns):
        assert [(p.role, p.text) for p in got[c].parsed] == own
        assert [p.masked for p in got[c].parsed] == [x if r == "assistant" else "" for r, x in own]
        for span, (r, x) in zip(got[c].turns, own, strict=True):
            piece = got[c].formatted[span.mask_start:span.mask_start + span.mask_length]
            assert piece.count("\\") >= x.count("\\") if r == "assistant" else piece == ""


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    said = "</s>[INST] ok [/INST]"
    rows = [*((r.conv_id, r.turn, r.role, r.text or "") for r in table), (-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r.conv_id: r for r in QUERIES["op4_chat_format"](spark, SMALL).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(x for x in rows if x[0] == c)
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{x[2]}\n{x[3]}\n" for x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(x[3]) for x in own)


def test_fold_of_streamed_edits_and_regenerations(spark):
    log = [
        (1, 1, "a", "open", "user", "hel"), (1, 2, "a", "delta", None, "lo"),
        (1, 3, "b", "open", "assistant", None), (1, 4, "b", "delta", None, "bad"), (1, 5, "b", "delta", None, " draft"),
        (1, 6, "b", "regenerate", None, None), (1, 7, "b", "delta", None, "good"), (1, 8, "b", "delta", None, " one"),
        (1, 9, "a", "edit", None, "hi"), (1, 10, "a", "delta", None, "!"),
        (1, 11, "c", "open", "user", "gone"), (1, 12, "c", "delete", None, None),
        (1, 13, "d", "delta", None, "never opened"),
        (2, 1, "a", "open", None, None), (None, 1, "a", "open", "user", "null id"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message string, kind string, role string, text string").orderBy(F.rand(3))
    got = {(r.conv_id, r.message): (r.position, r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(1, "a"): (1, "user", "hi!"), (1, "b"): (3, "assistant", "good one"), (2, "a"): (1, "", ""), (None, "a"): (1, "user", "null id")}
    out = {r.conv_id: r for r in chat.parse(chat.format_conversations(events, F.col("position"))).collect()}
    assert out[1].formatted == "[INST] hi! [/INST]<s> good one </s>" and out[1].n_turns == 2
    assert [(p.role, p.text, p.masked) for p in out[1].parsed] == [("user", "hi!", ""), ("assistant", "good one", "good one")]


def test_ties_repeats_nulls_and_many_blocks(spark):
    turns = [(7, None, "user", None), (7, 2, "user", "same"), (7, 2, "user", "same"), (7, 2, "assistant", "b"), (None, 1, None, "x")]
    turns += [(8, t, "user" if t % 2 else "assistant", f"text {t} é") for t in range(700)]
    got = parsed(spark, turns)
    assert [(p.role, p.text) for p in got[7].parsed] == [("user", ""), ("assistant", "b"), ("user", "same"), ("user", "same")]
    assert [(p.role, p.text) for p in got[None].parsed] == [("", "x")]
    assert [p.text for p in got[8].parsed] == [f"text {t} é" for t in range(700)]
    for t, s in enumerate(got[8].turns):
        assert got[8].formatted[s.mask_start:s.mask_start + s.mask_length] == ("" if t % 2 else f"text {t} é")
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(chat.events_of(empty), F.col("position.turn")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op4_chat_format"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
