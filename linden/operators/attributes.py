"""Name -> attribute co-occurrence: extraction, inference and the
order-dependent learning fold.

``attr_pairs`` finds ``name.attr`` pairs the way a repeated regex search does
when every new search starts at the attribute of the previous match (so
``a.b.c`` gives (a, b) and (b, c)).  A look-ahead for the attribute makes
``regexp_extract_all`` resume exactly there, so the whole chain is one
JVM-side expression per line.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

# --- fixed values: attribute pattern -----------------------------------------------
# groups: 1 name, 2 [..] suffix, 3 (..) suffix, 4 attribute, 5 "()" or "(" after it
ATTR_PATTERN = r"([\p{L}\p{N}_]+)(?:(\[.+\])|(\(.+\)))?\.(?=([\p{L}\p{N}_]+)(\(\)|\()?)"
# The same search without look-ahead (for engines that lack it): a lazy
# prefix locates the match start, and the caller resumes at the attribute.
ATTR_PATTERN_ANCHORED = r"^(.*?)([\p{L}\p{N}_]+)(?:(\[.+\])|(\(.+\)))?\.([\p{L}\p{N}_]+)(\(\)|\()?"


def attr_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, line, k, name, attr): name gets ``[]`` / ``()`` when it was
    indexed / called; attr gets ``()`` for an empty call, ``(`` for a call
    with arguments."""
    pat = F.lit(ATTR_PATTERN)
    d = lines.where(F.col("text").contains(".")).select(
        "doc_id", "line",
        *[F.regexp_extract_all("text", pat, i).alias(f"g{i}") for i in range(1, 6)],
    )
    d = d.where(F.size("g1") > 0).select(
        "doc_id", "line", F.posexplode(F.arrays_zip("g1", "g2", "g3", "g4", "g5")).alias("k", "z"))
    name = (
        F.when(F.col("z.g2") != "", F.concat(F.col("z.g1"), F.lit("[]")))
        .when(F.col("z.g3") != "", F.concat(F.col("z.g1"), F.lit("()")))
        .otherwise(F.col("z.g1"))
    )
    attr = F.concat(F.col("z.g4"), F.col("z.g5"))
    return d.select("doc_id", "line", "k", name.alias("name"), attr.alias("attr"))


def infer_attributes(pairs: DataFrame) -> DataFrame:
    """(doc_id, name, attr): the attributes inferred for a name are those of
    every name that shares at least one attribute with it (itself included).

    Planned through attribute co-occurrence: ``E(a, a2)`` = attributes seen
    on a common name, then ``P(n, a) JOIN E ON a``; both joins are equi-joins
    and intermediate pairs are made distinct before the next hop."""
    p = pairs.select("doc_id", "name", "attr").distinct()
    co = (
        p.alias("x").join(p.alias("y"), ["doc_id", "name"])
        .select("doc_id", F.col("x.attr").alias("attr"), F.col("y.attr").alias("attr2"))
        .distinct()
    )
    return (
        p.join(co, ["doc_id", "attr"])
        .select("doc_id", "name", F.col("attr2").alias("attr"))
        .distinct()
    )


def type_attr_maps(pairs: DataFrame) -> DataFrame:
    """(doc_id, side, key, n): distinct attributes per name and distinct
    names per attribute."""
    p = pairs.select("doc_id", "name", "attr").distinct()
    by_name = p.groupBy("doc_id", F.col("name").alias("key")).agg(F.count(F.lit(1)).alias("n")) \
        .select("doc_id", F.lit("name").alias("side"), "key", "n")
    by_attr = p.groupBy("doc_id", F.col("attr").alias("key")).agg(F.count(F.lit(1)).alias("n")) \
        .select("doc_id", F.lit("attr").alias("side"), "key", "n")
    return by_name.unionByName(by_attr)


BUILTIN = "!"  # first character of a built-in type's name


def fold_attributes(events, builtin=()):
    """Fold (name, attr) events in order; returns (groups, edges).

    Types live in numbered groups.  ``groups["name", n]`` and
    ``groups["attr", a]`` give the group of a name or attribute, a list of its
    types; a name that adopts an attribute's group shares it from then on.
    ``edges`` holds the (type, attr) pairs.  Rules, by what is known:

    * the name's types have the attribute: nothing changes;
    * they lack it: those that are not built in get it;
    * none of them can get it, or neither name nor attribute is known: a new
      type, called like the name, has this attribute alone;
    * only the attribute is known: the name adopts its group.
    """
    groups: dict[tuple[str, str], dict[str, None]] = {}
    attrs: dict[str, set[str]] = {}

    def attach(types, attr):
        groups.setdefault(("attr", attr), {}).update(dict.fromkeys(types))
        for t in types:
            attrs.setdefault(t, set()).add(attr)

    for t, attr in builtin:
        attach([t], attr)
    for name, attr in events:
        own = groups.get(("name", name)) or {}
        able = [t for t in own if not t.startswith(BUILTIN)]
        if any(attr in attrs[t] for t in own):
            continue
        if able:
            attach(able, attr)
        elif not own and groups.get(("attr", attr)):
            groups["name", name] = groups["attr", attr]
        else:
            attrs[name] = set()
            groups["name", name] = {name: None}
            attach([name], attr)
    return {k: list(types) for k, types in groups.items()}, {(t, attr) for t, own in attrs.items() for attr in own}


def attributes_of(folded, name) -> set:
    """Attributes of a name's types after the fold."""
    groups, edges = folded
    types = set(groups.get(("name", name), ()))
    return {a for t, a in edges if t in types}


LEARNED_SCHEMA = "doc_id long, name string, attr string"
LEARNED_ROWS = 1 << 14  # rows of an output batch, at least


def learned(pairs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(name, attr) pairs after folding one document's pairs in order."""
    groups, edges = fold_attributes(pairs)
    by_type: dict[str, set] = {}
    for t, attr in edges:
        by_type.setdefault(t, set()).add(attr)
    return [(n, attr) for (kind, n), types in groups.items() if kind == "name"
            for attr in sorted(set().union(*(by_type.get(t, ()) for t in types)))]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, name, attr) of batches whose rows are sorted by document."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "name", "attr")), strict=True)


def _learn_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    def out(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "name", "attr"])

    rows: list[tuple] = []
    for doc, own in groupby(_documents(batches), key=lambda r: r[0]):
        rows += [(doc, *pair) for pair in learned((name, attr) for _, name, attr in own)]
        if len(rows) >= LEARNED_ROWS:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)


def learn_attributes(pairs: DataFrame) -> DataFrame:
    """(doc_id, name, attr) after folding every pair of a document in
    (line, k) order.  Only the narrow pair rows reach Python, sorted by
    document, so that a batch holds many documents; a document's fold goes on
    from one batch to the next and holds its names and attributes, not its
    rows."""
    ordered = pairs.select("doc_id", "line", "k", "name", "attr").repartition("doc_id") \
        .sortWithinPartitions("doc_id", "line", "k", "name", "attr")
    return ordered.select("doc_id", "name", "attr").mapInArrow(_learn_sorted, LEARNED_SCHEMA)
