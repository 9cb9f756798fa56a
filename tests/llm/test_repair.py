"""Conversation repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from linden.llm import repair
from linden.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, messages) of rows (role, text, dead, truncated) by trying
    every edit in every state; a plain left-to-right program."""
    best = {"": (0, "", ())}  # role initials so far, shortened to what matters

    def state(said):
        return "" if said == "" else "s" if said == "s" else said[-1]

    def may(said, c):
        s = state(said)
        return c == "s" and s == "" or c == "u" and s in ("", "s", "a") or c == "a" and s == "u"

    def insert(table):
        for _ in range(3):
            for said, (cost, audit, out) in list(table.items()):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if may(said, c):
                        offer(table, c, cost + 2, audit + "I", (*out, (role, "")))
        return table

    def offer(table, said, cost, audit, out):
        if said not in table or (cost, audit) < table[said][:2]:
            table[said] = (cost, audit, out)

    for role, text, dead, truncated in rows:
        after: dict = {}
        for said, (cost, audit, out) in insert(best).items():
            offer(after, said, cost + 3, audit + "D", out)
            if not dead:
                if role[:1] in ("s", "u", "a") and may(said, role[:1]):
                    offer(after, role[:1], cost + truncated, audit + "K", (*out, (role, text)))
                for c, new in (("u", "user"), ("a", "assistant")):
                    if may(said, c):
                        offer(after, c, cost + 2 + truncated, audit + "R", (*out, (new, text)))
        best = after
    return min(v for k, v in insert(best).items() if state(k) in ("", "a"))


def brute(all_rows):
    convs = {}
    for conv in {r[0] for r in all_rows}:
        convs[conv] = [r for r in damage(all_rows) if r[0] == conv]
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked, n = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            trimmed = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not WORD.search(text) else 1 if (role, text) in seen else 2 if trimmed[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, said = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def query(spark, folder):
    df = QUERIES["op12_conversation_repair"](spark, str(folder))
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            text = rng.choice(["ok.", "no", "", " ", "well!\n", f"t{turn}?", None, "é..", "say. \x1c"])
            rows.append((rng.choice([conv, conv, conv, None]) if conv % 9 == 0 else conv, rng.choice([turn, turn, turn, None]) if conv % 5 == 0 else turn, role, text))
    return rows


@pytest.mark.parametrize("bits", [8, 2])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, bits):
    """Whole conversations in one leaf, and in trees of leaves of four rows."""
    monkeypatch.setattr(repair, "LEAF", bits)
    rows = conversations(bits, 120, 14) + [(1000, t, random.Random(t).choice(["user", "assistant"]), f"x {t % 40}.") for t in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert query(spark, tmp_path) == brute(rows)


def test_query_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert query(spark, SMALL) == brute(rows)


def test_hot_row_and_messages(spark):
    """One row repeated 10,000 times, and what the operator itself returns."""
    rows = spark.createDataFrame([(5, 0, "user", "a.", 10_000), (5, 1, "assistant", "b", 1), (6, 0, "assistant", "c.", 1), (7, 0, "system", " ", 1)],
                                 "conv_id long, turn long, role string, text string, copies int")
    summary, messages = repair.repair(rows)
    got = {r.conv_id: r for r in summary.collect()}
    assert (got[5].duplicate, got[5].truncated, got[5].cost, got[5].audit) == (9999, 1, 3 * 9999 + 1, "K" + "D" * 9999 + "K")
    assert (got[6].cost, got[6].audit, got[7].cost, got[7].audit, got[7].blank) == (2, "IK", 3, "D", 1)
    said = {}
    for r in messages.orderBy("conv_id", "id", "nth").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text, r.edit))
    assert said == {5: [("user", "a.", "K"), ("assistant", "b", "K")], 6: [("user", "", "I"), ("assistant", "c.", "K")]}


def test_rules_change_nothing():
    rng = random.Random(7)
    plain = repair.Evaluator([])
    rules = repair.Evaluator([{(2, 4): 9, (8, 8): 10}, {(9, 9): 11, (5, 10): 12}, {(11, 11): 13}])
    for _ in range(200):
        s = "".join(rng.choices("0123456788242424", k=rng.randrange(1, 40)))
        a, b = plain(s), rules(s)
        assert {k: (c, repair.flat(r)) for k, (c, r) in a.items()} == {k: (c, repair.flat(r)) for k, (c, r) in b.items()}


def test_empty_extra_and_clashing_columns(spark, tmp_path):
    schema = "conv_id string, turn int, role string, text string, id int, key string, node int"
    for name, rows in (("none", []), ("one", [("x", 3, "user", "hi.", 1, "k", 2), (None, None, None, None, None, None, None)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        assert query(spark, f"{tmp_path}/{name}") == brute([r[:4] for r in rows])
