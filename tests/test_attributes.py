"""Attribute extraction and the learning fold (values from the reference's
own unit tests, rewritten as DataFrame inputs)."""

from linden.operators import attributes as at


def _pairs(spark, lines):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "doc_id long, line int, text string")
    return at.attr_pairs(df)


def test_chained_pairs(spark):
    got = [(r.name, r.attr) for r in _pairs(spark, [
        "a = b.c.d(e)", "zero = self.one.two()", "zero = three.four",
        "alpha[3 + 4].beta", "gamma(1, 2).delta"]).orderBy("line", "k").collect()]
    assert got == [("b", "c"), ("c", "d("), ("self", "one"), ("one", "two()"),
                   ("three", "four"), ("alpha[]", "beta"), ("gamma()", "delta")]


def test_learning_fold(spark):
    pairs = _pairs(spark, ["a = b.c.d(e)", "zero = self.one.two()", "zero = three.four",
                           "alpha[3 + 4].beta", "gamma(1, 2).delta"])
    learned = {}
    for r in at.learn_attributes(pairs).collect():
        learned.setdefault(r.name, set()).add(r.attr)
    assert learned["b"] == {"c"}
    assert learned["c"] == {"d("}
    assert learned["self"] == {"one"}
    assert learned["one"] == {"two()"}
    assert learned["three"] == {"four"}
    assert learned["alpha[]"] == {"beta"}
    assert learned["gamma()"] == {"delta"}


def test_shared_groups():
    events = [("t1", "a1"), ("t2", "a2"), ("t2", "a2"), ("t2", "a1")]
    folded = at.fold_attributes(events)
    assert at.attributes_of(folded, "t1") == {"a1"}
    assert at.attributes_of(folded, "t2") == {"a1", "a2"}
    folded = at.fold_attributes([*events, ("t3", "a2")])
    assert at.attributes_of(folded, "t3") == {"a1", "a2"}
    folded = at.fold_attributes([*events, ("t3", "a2"), ("t3", "a3")])
    assert at.attributes_of(folded, "t3") == {"a1", "a2", "a3"}
    assert at.attributes_of(folded, "t2") == {"a1", "a2", "a3"}
    assert at.attributes_of(folded, "t1") == {"a1"}


def test_builtin_types_are_adopted_and_never_changed():
    builtin = [("!list", "append"), ("!list", "pop"), ("!array", "shape"), ("!array", "ndim")]
    folded = at.fold_attributes([("arr", "shape"), ("lst", "append")], builtin)
    assert at.attributes_of(folded, "arr") == {"shape", "ndim"}
    assert at.attributes_of(folded, "lst") == {"append", "pop"}
    folded = at.fold_attributes([("arr", "shape"), ("arr", "a3")], builtin)
    assert at.attributes_of(folded, "arr") == {"a3"}


def test_documents_share_batches_and_batches_share_documents(spark):
    """One pass over rows sorted by document: no group is handed to Python on its own."""
    import pyarrow as pa

    rows = [(None, "n", "z"), (1, "a", "x"), (1, "b", "x"), (1, "a", "y"), (2, "a", "q")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "name", "attr"), r)) for r in part]) for part in (rows[:2], rows[2:3], rows[3:])]
    got = [tuple(r.values()) for b in at._learn_sorted(iter(batches)) for r in b.to_pylist()]
    assert got == [(None, "n", "z"), (1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y"), (2, "a", "q")]
    df = spark.createDataFrame([(d, i, 0, n, a) for i, (d, n, a) in enumerate(rows)], "doc_id long, line int, k int, name string, attr string")
    learned = at.learn_attributes(df)
    assert sorted(map(tuple, learned.collect()), key=str) == sorted(got, key=str)
    assert "FlatMapGroupsInPandas" not in learned._jdf.queryExecution().executedPlan().toString()
