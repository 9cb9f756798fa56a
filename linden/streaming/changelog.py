"""File-tree change logs: create / delete / modify / rename per path, and the
folders that a client has opened.

Without renames the tree is a latest-per-key aggregation (partial
aggregation, skew-safe).  A rename moves a whole subtree.  ``tree_state_with_renames``
follows what was created through time instead of folding a root's events: the
next event that concerns an entry is the first later rename or deletion of its
path or of a folder above it.  All entries look that up at once, by one as-of
join on their ancestors' paths, and go on from there until nothing concerns
them any more: as many rounds as the longest chain of renames an entry goes
through, each a job over the entries still on their way, written in between.
Entries that meet in a path at a time are one from then on.  No task holds a
root, a folder or an entry's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linden.operators.sequence import carry_last
from linden.session import materialize

# --- fixed values: event mapping ----------------------------------------------------------
OP_OF_EVENT = {"signup": "create", "error": "delete"}  # everything else modifies


def file_events(events: DataFrame) -> DataFrame:
    """(root, path, op, ts, seq) file events replayed from ``events``."""
    k = F.get_json_object("props", "$.k")
    op = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(o)) for e, o in OP_OF_EVENT.items()], F.lit("modify"))
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("root"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), k).alias("path"),
        op.alias("op"), F.col("ts"), F.col("event_id").alias("seq"))


def tree_state(fevents: DataFrame) -> DataFrame:
    """Paths that exist after the log: latest create/delete per path is a
    create."""
    cd = fevents.where(F.col("op").isin("create", "delete"))
    last = cd.groupBy("path").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))
    return last.where(F.col("op") == "create").select("path")


def ancestors(path: Column) -> Column:
    """A path's ancestors, topmost first, and itself."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def rename_events(events: DataFrame) -> DataFrame:
    """(root, path, op, new_path, ts, seq) replayed from ``events``: entry k lies
    in folder k / 10 of its user's tree.  Signups and clicks create it, errors
    delete it; purchases rename the folder (even k) or the entry (odd k)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    root = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    folder = lambda n: F.concat(root, F.lit("/d"), n.cast("string"))
    own = folder(F.floor(k / 10))
    entry = F.concat(own, F.lit("/f"), k.cast("string"))
    kind = F.col("event_type")
    moves = (kind == "purchase") & (k % 2 == 0)
    op = F.when(kind.isin("signup", "click"), "create").when(kind == "error", "delete").when(kind == "purchase", "rename").otherwise("modify")
    return events.select(root.alias("root"), F.when(moves, own).otherwise(entry).alias("path"), op.alias("op"),
                         F.when(moves, folder((k * 7 + 3) % 10)).when(kind == "purchase", F.concat(entry, F.lit("x"))).alias("new_path"),
                         F.col("ts"), F.col("event_id").alias("seq"))


def next_changes(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """``entries`` (root, path, at, seq) with ``next``: the first later rename
    or deletion of the path or of a folder above it, null if there is none."""
    key = ["root", "path"]
    probes = entries.select("root", "path", "at", "seq", F.explode(ancestors(F.col("path"))).alias("above"))
    asked = probes.select("root", F.col("above").alias("path"), "at", "seq").distinct()
    event = F.struct("at", "seq", "op", F.col("path").alias("old_path"), "new_path")
    both = asked.select(*key, "at", "seq", F.lit(0).alias("change"), F.lit(None).cast(changes.select(event.alias("e")).schema["e"].dataType).alias("e")) \
        .union(changes.select(*key, "at", "seq", F.lit(1).alias("change"), event.alias("e")))
    # backwards in time, a question before a change of the same moment
    both = both.withColumns({"back": -F.col("at"), "back_seq": -F.col("seq")})
    found = carry_last(both, F.col("e"), "next", key=key, order=["back", "back_seq", "change"], block_col=F.floor(F.col("back") / 3_600_000_000))
    found = found.where("change = 0 and next is not null").select("root", F.col("path").alias("above"), "at", "seq", "next")
    least = probes.join(found, ["root", "above", "at", "seq"]).groupBy(*key, "at", "seq").agg(F.min("next").alias("next"))
    return entries.join(least, [*key, "at", "seq"], "left")


def tree_state_with_renames(fevents: DataFrame) -> DataFrame:
    """(root, path) that exist after the log (root, path, op, new_path, ts, seq),
    events taken in (ts, seq) order.  Renames without a new path are ignored;
    paths have no trailing slash; events without a root, path or time are ignored."""
    at = F.col("ts").cast("long") if fevents.schema["ts"].dataType.typeName() == "long" else F.unix_micros(F.col("ts").cast("timestamp"))
    log = fevents.select("root", "path", "op", "new_path", at.alias("at"), F.col("seq").cast("long").alias("seq")).where("root is not null and path is not null and at is not null and seq is not null")
    log = materialize(log.where("op in ('create', 'delete') or op = 'rename' and new_path is not null"), "tree-events")
    changes = log.where("op <> 'create'")
    entries = log.where("op = 'create'").select("root", "path", "at", "seq").distinct()
    settled = []
    while True:
        step = materialize(next_changes(entries, changes), "tree-steps")
        settled.append(step.where("next is null").select("root", "path"))
        moved = step.where("next.op = 'rename'")
        if moved.isEmpty():
            break
        rest = F.substring("path", F.length("next.old_path") + 1, F.length("path"))
        entries = moved.select("root", F.concat("next.new_path", rest).alias("path"), F.col("next.at").alias("at"), F.col("next.seq").alias("seq")).distinct()
    paths = settled[0]
    for s in settled[1:]:
        paths = paths.union(s)
    return paths.distinct()


def open_events(events: DataFrame) -> DataFrame:
    """(root, path, op, ts, seq) replayed from ``events``: views and clicks open
    a folder three levels deep, purchases close it, errors close the one above."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.col("event_type")
    top = F.concat(F.lit("d"), F.floor(k / 10).cast("string"))
    path = F.when(kind == "error", top).otherwise(F.concat(top, F.lit("/s"), k.cast("string"), F.lit("/"), (k % 3).cast("string")))
    op = F.when(kind.isin("view", "click"), "open").when(kind.isin("purchase", "error"), "close")
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("root"), path.alias("path"), op.alias("op"), "ts", F.col("event_id").alias("seq")) \
        .where("op is not null and root is not null and path is not null")


def opened_paths(fevents: DataFrame) -> DataFrame:
    """(root, path, opens): folders that are open after the log.  Opening a
    folder opens those above it, closing one closes those below it: a folder is
    open if it, or one below it, was opened after the last closing of it or one
    above it.  ``opens`` counts those openings.  Latest closings are aggregated
    by path and reach the folders below by a join on ancestors."""
    when = F.struct("ts", "seq")
    opens = fevents.where("op = 'open'").select("root", when.alias("opened"), F.explode(ancestors(F.col("path"))).alias("path"))
    closes = fevents.where("op = 'close'").groupBy("root", F.col("path").alias("above")).agg(F.max(when).alias("closed"))
    paths = opens.select("root", "path").distinct()
    last = paths.select("root", "path", F.explode(ancestors(F.col("path"))).alias("above")).join(closes, ["root", "above"]) \
        .groupBy("root", "path").agg(F.max("closed").alias("closed"))
    return opens.join(last, ["root", "path"], "left").where("closed is null or opened > closed").groupBy("root", "path").agg(F.count("*").alias("opens"))
