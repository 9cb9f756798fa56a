"""Structure repair of conversations by a grammar-compressed dynamic program.

A conversation's rows become symbols: role and fault.  Edits of rows (keep,
rerole, delete, insert before) move an automaton that accepts an optional
system row and then user/assistant turns; a row's symbol is a min-plus matrix
over its four states, whose entries hold a cost and an *audit rope*, the edits
that reach it.  The matrix of a row sequence is the product of its symbols'
matrices, so it is shared wherever the sequence occurs:

* sequences are compressed by Re-Pair: pairs of neighbouring symbols, counted
  over all distinct sequences, become rules, the most frequent first; several
  disjoint pairs to a round;
* a rule's matrix is the product of its two symbols' matrices, evaluated once,
  bottom-up; its ropes point to theirs;
* a sequence takes as many products as its compressed form has symbols, and a
  task evaluates a sequence once for all conversations that show it.

Of equally cheap edits the audit least in ASCII wins.  Inserts stand before
the row that follows (those at the end close the conversation), so of two
audits of a sequence that end in different states none begins with the other,
and the choice composes: between parts of a conversation only costs and, to
each entry state, the ranks of the audits have to be known.

Long conversations are cut into leaves of 2^``LEAF`` rows by their place in
the sorted table; nodes of 2^``LEAF`` neighbours are multiplied level by level
until a conversation has one, then states are handed down.  No task gathers a
conversation's rows: equal rows are counted before they are sorted, and first
occurrences are found by salted minima.  What the driver sees is bounded: the
most frequent pairs of a round, at most ``RULES`` rules (what they do not
cover is multiplied symbol by symbol), row counts of the sort's partitions.

Nulls and edge cases: a null role or text is one space (blank), a null turn
comes first, null conv_ids are one conversation; rows of one turn are ordered
by role and text; repeated rows are duplicates of the first; roles other than
system, user and assistant (by initial) must be given another role or go;
a conversation without rows left has an empty repair; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linden.llm.common import written

BLANK = " \t\n\x0b\x0c\r"
ROLES = "sua"  # initials in symbol order; any other is the fourth
DEAD = 8
FRESH = 9  # the first rule's symbol
CLOSING = ("", "II", "I", "")
CLOSING_ROLES = ("", "ua", "a", "")
COST_INSERT, COST_REROLE, COST_DELETE, COST_TRUNCATED = 2, 2, 3, 1
LEAF = 8
SALTS = 32
COPIES = 4096
RULES, ROUNDS, PAIRS = 1024, 12, 256
MEMORY = 50_000
#: state -> (role that comes next in a turn, state behind it)
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))

# --- matrices ------------------------------------------------------------------------------


def flat(rope) -> str:
    """The text of a rope: a string or a pair of ropes."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += (top[1], top[0])
    return "".join(out)


def symbol_matrix(symbol: int) -> dict:
    """(from, to) -> (cost, rope) of one row, inserts before it included."""
    out: dict = {}
    role, truncated = divmod(symbol, 2)

    def offer(i, j, cost, audit):
        out[i, j] = min(out.get((i, j), (cost, audit)), (cost, audit))

    for i in range(4):
        at, cost, audit = i, 0, ""
        for _ in range(3):
            offer(i, at, cost + COST_DELETE, audit + "D")
            if symbol != DEAD:
                kept = truncated * COST_TRUNCATED
                turn, after = NEXT[at]
                offer(i, after, cost + kept + COST_REROLE, audit + "R")
                if role == 0 and at == 0:
                    offer(i, 1, cost + kept, audit + "K")
                elif ROLES[role:role + 1] == turn:
                    offer(i, after, cost + kept, audit + "K")
            at, cost, audit = NEXT[at][1], cost + COST_INSERT, audit + "I"
    return out


def times(a: dict, b: dict) -> dict:
    """Min-plus product; equal costs go by the first factor's audit, as that
    of one entry state tells the states between apart."""
    out: dict = {}
    for (i, k), (cost, rope) in a.items():
        for j in range(4):
            if (k, j) in b:
                more, tail = b[k, j]
                old = out.get((i, j))
                if old is None or cost + more < old[0] or cost + more == old[0] and flat(rope) < flat(old[1][0]):
                    out[i, j] = (cost + more, (rope, tail))
    return out


def ranked(matrix: dict) -> tuple[list[int | None], str]:
    """Costs of the sixteen entries, and a digit to each that orders the
    audits of an entry state."""
    costs = [matrix[divmod(k, 4)][0] if divmod(k, 4) in matrix else None for k in range(16)]
    ranks = [" "] * 16
    for i in range(4):
        own = sorted((flat(matrix[i, j][1]), j) for j in range(4) if (i, j) in matrix)
        for rank, (_, j) in enumerate(own):
            ranks[4 * i + j] = str(rank)
    return costs, "".join(ranks)


# --- the grammar ---------------------------------------------------------------------------


def compress(symbols: list[int], rounds: list[dict]) -> list[int]:
    for pairs in rounds:
        out, i = [], 0
        while i < len(symbols):
            pair = tuple(symbols[i:i + 2])
            out.append(pairs.get(pair, symbols[i]))
            i += 2 if pair in pairs else 1
        symbols = out
    return symbols


def grammar(sequences: DataFrame) -> list[dict]:
    """Re-Pair rules, as {pair: symbol} by round, for ``sequences`` (sequence:
    a digit to a row, n: how often)."""
    rounds: list[dict] = []
    fresh = FRESH

    def pairs_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found: Counter = Counter()
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = compress(list(map(int, s)), rounds)
                for pair in zip(own, own[1:]):
                    found[pair] += n
            rows = [(a, b, n) for (a, b), n in found.items()]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["a", "b", "n"])

    while len(rounds) < ROUNDS and fresh < FRESH + RULES:
        pairs = sequences.select("sequence", "n").mapInArrow(pairs_of, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        most = pairs.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(min(PAIRS, FRESH + RULES - fresh)).collect()
        used: set[int] = set()
        chosen: dict = {}
        for r in most:  # pairs of one round share no symbol, so replacing one never breaks another
            if not used & {r.a, r.b}:
                used |= {r.a, r.b}
                chosen[r.a, r.b] = fresh
                fresh += 1
        if not chosen:
            break
        rounds = [*rounds, chosen]
    return rounds


class Evaluator:
    """Matrices of symbols, rules and (remembered) whole sequences."""

    def __init__(self, rounds: list[dict]):
        self.rounds = rounds
        self.matrix = {k: symbol_matrix(k) for k in range(FRESH)}
        for pairs in rounds:
            for (a, b), symbol in pairs.items():
                self.matrix[symbol] = times(self.matrix[a], self.matrix[b])
        self.known: dict = {}

    def __call__(self, sequence: str) -> dict:
        if sequence not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            own = [self.matrix[s] for s in compress(list(map(int, sequence)), self.rounds)]
            total = own[0]
            for m in own[1:]:
                total = times(total, m)
            self.known[sequence] = total
        return self.known[sequence]


def steps(sequence: str, audit: str, state: int) -> tuple[list[str], list[str]]:
    """To each row of a leaf, the roles inserted before it and what becomes of
    it: ``K`` kept, ``u`` / ``a`` its new role, empty if it goes."""
    inserted, own = [], []
    for symbol, piece in zip(sequence, re.findall("I*[DKR]", audit), strict=True):
        roles = ""
        for _ in piece[:-1]:
            role, state = NEXT[state]
            roles += role
        inserted.append(roles)
        if piece[-1] == "K":
            state = 1 + int(symbol) // 2
            own.append("K")
        elif piece[-1] == "R":
            role, state = NEXT[state]
            own.append(role)
        else:
            own.append("")
    return inserted, own


# --- rows, leaves, nodes --------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the test damage: rows dropped,
    emptied, cut short, repeated or given the user's role by a checksum."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(part("conv_id"), F.lit(":"), part("turn"))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) sorted and numbered without
    gaps: key (conv_id as text, never null), id, conv_id, turn, role, text
    (null in repetitions), blank, truncated, repeated."""
    key = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", key.alias("key"), "turn", space("role"), space("text"), "copies")
    rows = rows.groupBy("conv_id", "key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    trimmed = F.rtrim("text", F.lit(BLANK))
    rows = rows.withColumns({"blank": trimmed == "", "truncated": (trimmed != "") & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")})
    rows = rows.orderBy("key", F.asc_nulls_first("turn"), "role", "text")
    # copies come in two steps, so that no array grows with them
    rows = rows.withColumn("many", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    here = F.least(F.lit(COPIES), F.col("copies") - F.col("many") * COPIES).cast("int")
    rows = rows.withColumn("one", F.explode(F.sequence(F.lit(1), here)))
    rows = rows.withColumn("repeated", (F.col("many") > 0) | (F.col("one") > 1)).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows.select("key", "at", "conv_id", "turn", "role", F.when(~F.col("repeated"), F.col("text")).alias("text"), "blank", "truncated", "repeated"), "sorted-rows")
    # numbers within a partition of the sort -> numbers in the whole table; a row to each partition
    part = F.shiftright("at", 33)
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())
    starts, total = {}, 0
    for r in counts:
        starts[r["part"]], total = total, total + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair]), part) if starts else F.lit(0)
    return rows.withColumn("id", start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def with_symbols(rows: DataFrame) -> DataFrame:
    """Narrow rows: key, id, role, initial, symbol, and the faults as 0 or 1."""
    rows = rows.select("key", "id", "role", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "repeated",
                       F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (F.col("id") % SALTS).cast("int").alias("salt"))
    same = ["key", "role", "digest"]
    seen = rows.where("not blank and not repeated").groupBy(*same, "salt").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    seen = seen.groupBy(*same).agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    seen = seen.select(*same, "first", F.explode("salts").alias("salt"))
    rows = rows.join(seen, [*same, "salt"], "left")
    duplicate = ~F.col("blank") & (F.col("repeated") | F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    rows = rows.withColumn("duplicate", duplicate).withColumn("truncated", F.col("truncated") & ~F.col("duplicate"))
    role = F.coalesce(*[F.when(F.col("initial") == c, k) for k, c in enumerate(ROLES)], F.lit(len(ROLES)))
    symbol = F.when(F.col("blank") | F.col("duplicate"), DEAD).otherwise(2 * role + F.col("truncated").cast("int"))
    return rows.select("key", "id", "initial", symbol.alias("symbol"), *[F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


def illegal(a: Column, b: Column) -> Column:
    return (~F.concat(a, b).isin("su", "ua", "au")).cast("long")


def leaves(rows: DataFrame) -> DataFrame:
    """Rows of ``with_symbols`` by leaf: key, node, start, sequence, the sums of
    faults, and the illegal neighbours, those across its start included."""
    own = F.sort_array(F.collect_list(F.struct("id", "symbol", "initial")))
    found = rows.withColumn("node", F.shiftright("id", LEAF)).groupBy("key", "node").agg(
        own.alias("own"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    inside = F.aggregate(F.zip_with(F.slice("own", 1, F.size("own") - 1), F.slice("own", 2, F.size("own")), lambda a, b: illegal(a.initial, b.initial)),
                         F.lit(0).cast("long"), lambda s, x: s + x)
    found = found.select("key", "node", F.col("own")[0].id.alias("start"), F.array_join(F.transform("own", lambda r: r.symbol.cast("string")), "").alias("sequence"),
                         "blank", "duplicate", "truncated", inside.alias("inside"), F.col("own")[0].initial.alias("head"), F.element_at("own", -1).initial.alias("tail"))
    found = written(found, "leaves")
    before = found.select("key", (F.col("node") + 1).alias("node"), F.col("tail").alias("before"))
    return found.join(before, ["key", "node"], "left").select(
        "key", "node", "start", "sequence", "blank", "duplicate", "truncated",
        (F.col("inside") + F.coalesce(illegal(F.col("before"), F.col("head")), F.lit(0))).alias("illegal"))


def with_matrices(found: DataFrame, evaluator: Evaluator) -> DataFrame:
    """(key, node, costs, ranks) of leaves."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            costs, ranks = [], []
            for s in batch.column(2).to_pylist():
                c, r = ranked(evaluator(s))
                costs.append(c)
                ranks.append(r)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.string())],
                                             ["key", "node", "costs", "ranks"])

    return found.select("key", "node", "sequence").mapInArrow(run, "key string, node long, costs array<long>, ranks string")


def parents(nodes: DataFrame) -> DataFrame:
    """(key, node, costs, ranks, children, paths): products of 2^LEAF
    neighbouring nodes, with the states on the way of each entry."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            costs, ranks, paths = [], [], []
            for own in batch.column(2).to_pylist():
                total: dict = {}
                for n, child in enumerate(own):
                    m = {divmod(k, 4): (c, child["ranks"][k]) for k, c in enumerate(child["costs"]) if c is not None}
                    if not n:
                        total = {(i, j): (c, r, f"{i}{j}") for (i, j), (c, r) in m.items()}
                        continue
                    step: dict = {}
                    for (i, k), (cost, rank, path) in total.items():
                        for j in range(4):
                            if (k, j) in m:
                                new = (cost + m[k, j][0], rank + m[k, j][1], path + str(j))
                                step[i, j] = min(step.get((i, j), new), new)
                    total = step
                c, r = ranked(total)
                costs.append(c)
                ranks.append(r)
                paths.append([total[divmod(k, 4)][2] if divmod(k, 4) in total else None for k in range(16)])
            children = pa.array([[x["node"] for x in own] for own in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.string()),
                                              children, pa.array(paths, pa.list_(pa.string()))], ["key", "node", "costs", "ranks", "children", "paths"])

    own = F.sort_array(F.collect_list(F.struct("node", "costs", "ranks")))
    grouped = nodes.groupBy("key", F.shiftright("node", LEAF).alias("up")).agg(own.alias("own"))
    return grouped.mapInArrow(run, "key string, node long, costs array<long>, ranks string, children array<long>, paths array<string>")


def states(found: DataFrame, evaluator: Evaluator) -> tuple[DataFrame, DataFrame]:
    """(key, node, enter, leave) of every leaf on its conversation's cheapest
    way, and (key, cost, leave) of every conversation."""
    nodes = written(with_matrices(found, evaluator), "nodes")
    levels, roots = [nodes], []
    # the end: costs of closing, then the audit's rank
    ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(
        (F.get("costs", j) + F.element_at(F.lit([COST_INSERT * len(c) for c in CLOSING]), j + 1)).alias("cost"),
        F.substring("ranks", j + 1, F.lit(1)).alias("rank"), j.alias("leave")))
    best = F.array_min(F.filter(ends, lambda e: e.cost.isNotNull()))
    while True:
        sizes = levels[-1].groupBy("key").agg(F.count("*").alias("nodes"))
        placed = levels[-1].join(sizes, "key")
        roots.append(placed.where("nodes = 1").select("key", "node", best.alias("end")))
        if sizes.where("nodes > 1").isEmpty():
            break
        levels.append(written(parents(placed.where("nodes > 1")), "nodes"))
    known = None
    for level in range(len(levels) - 1, -1, -1):
        own = roots[level].select("key", "node", F.lit(0).alias("enter"), F.col("end.leave").alias("leave"))
        if known is not None:
            inner = levels[level + 1].join(known, ["key", "node"])
            path = F.get("paths", F.col("enter") * 4 + F.col("leave"))
            inner = inner.select("key", path.alias("path"), F.posexplode("children").alias("at", "node"))
            state = lambda k: F.substring("path", F.col("at") + k, F.lit(1)).cast("int")
            own = own.union(inner.select("key", "node", state(1), state(2)))
        known = written(own, "states")
    ended = roots[0]
    for r in roots[1:]:
        ended = ended.union(r)
    return known, ended.select("key", F.col("end.cost").alias("cost"), F.col("end.leave").alias("leave"))


def edits(found: DataFrame, known: DataFrame, evaluator: Evaluator) -> DataFrame:
    """(key, node, start, audit, inserted, own) of leaves."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            audits, inserted, own = [], [], []
            for s, i, j in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                audits.append(flat(evaluator(s)[i, j][1]))
                a, b = steps(s, audits[-1], i)
                inserted.append(a)
                own.append(b)
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(audits, pa.string()), pa.array(inserted, texts), pa.array(own, texts)],
                                             ["key", "node", "start", "audit", "inserted", "own"])

    rows = found.join(known, ["key", "node"]).select("key", "node", "start", "sequence", "enter", "leave")
    return rows.mapInArrow(run, "key string, node long, start long, audit string, inserted array<string>, own array<string>")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text, copies).

    First: one row per conversation that has rows: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit.  Second: the repaired messages,
    conv_id, id and nth (their order), role, text, edit (K, R or I)."""
    rows = ordered(rows)
    found = leaves(with_symbols(rows))
    found = written(found, "leaves")
    sequences = written(found.groupBy("sequence").agg(F.count("*").alias("n")), "sequences")
    evaluator = Evaluator(grammar(sequences))
    known, ended = states(found, evaluator)
    ended = written(ended, "ends")
    edited = written(edits(found, known, evaluator), "edits")

    sums = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    turns = rows.groupBy("key", "conv_id", "turn").agg(F.lit(1)).groupBy("key", "conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    audits = edited.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "audit"))), lambda r: r.audit), "").alias("audit"))
    closing = lambda texts: F.element_at(F.lit(list(texts)), F.col("leave") + 1)
    summary = turns.join(sums, "key").join(audits, "key").join(ended, "key").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", closing(CLOSING)).alias("audit"))

    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    insert = lambda x: F.struct(name(x).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))
    step = edited.select("start", F.posexplode(F.arrays_zip("inserted", "own")).alias("at", "e")) \
        .select((F.col("start") + F.col("at")).alias("id"), "e.inserted", "e.own").where("inserted <> '' or own <> ''")
    stays = F.when(F.col("own") == "", F.array()).otherwise(F.array(F.struct(
        F.when(F.col("own") == "K", F.col("role")).otherwise(name(F.col("own"))).alias("role"), "text",
        F.when(F.col("own") == "K", "K").otherwise("R").alias("edit"))))
    messages = rows.select("conv_id", "id", "role", "text").join(step, "id") \
        .select("conv_id", "id", F.posexplode(F.concat(F.transform(letters(F.col("inserted")), insert), stays)).alias("nth", "m"))
    last = rows.groupBy("key", "conv_id").agg(F.max("id").alias("id"))
    closed = ended.where(F.col("leave").isin(1, 2)).join(last, "key") \
        .select("conv_id", "id", F.posexplode(F.transform(letters(closing(CLOSING_ROLES)), insert)).alias("nth", "m"))
    messages = messages.union(closed.withColumn("nth", F.col("nth") + 4))  # behind the last row's
    return summary, messages.select("conv_id", "id", "nth", "m.role", "m.text", "m.edit")
