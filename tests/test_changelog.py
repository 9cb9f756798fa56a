"""File trees with renames and opened folders against plain folds."""

import random

import pytest

from linden.sources.tables import table
from linden.streaming import changelog
from tests.conftest import SMALL

LOG = "root string, path string, op string, new_path string, ts long, seq long"


def fold_tree(ops):
    """(op, path, new_path) in order, applied to a set of paths."""
    paths = set()
    for op, path, new in ops:
        moved = lambda p: p == path or p.startswith(path + "/")  # noqa: E731, B023
        if op == "create":
            paths.add(path)
        elif op == "delete":
            paths = {p for p in paths if not moved(p)}
        elif op == "rename" and new:
            paths = {new + p[len(path):] if moved(p) else p for p in paths}
    return paths


def fold_opened(ops):
    """Nested dicts, as a client keeps them."""
    tree = {}
    for op, path in ops:
        *above, last = path.split("/")
        node = tree
        if op == "open":
            for part in [*above, last]:
                node = node.setdefault(part, {})
            continue
        for part in above:
            node = node.get(part)
            if node is None:
                break
        else:
            node.pop(last, None)
    found = set()

    def walk(node, prefix):
        for name, inner in node.items():
            found.add("/".join([*prefix, name]))
            walk(inner, [*prefix, name])

    walk(tree, [])
    return found


def states(df):
    return {(r.root, r.path) for r in df.collect()}


def test_directory_rename_moves_what_is_in_it(spark):
    ops = [("create", "p/a.py", None), ("create", "p/b/c.py", None), ("rename", "p/b", "p/d"),
           ("create", "p/e.py", None), ("delete", "p/e.py", None), ("delete", "p/a.py", None)]
    df = spark.createDataFrame([("p", path, op, new, i, i) for i, (op, path, new) in enumerate(ops)], LOG)
    assert states(changelog.tree_state_with_renames(df)) == {("p", "p/d/c.py")}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c"]
    path = lambda: "/".join(rng.choices(names, k=rng.randrange(1, 4)))
    logs, rows = {}, []
    for root in ("r", "s", "t"):
        ops = []
        for _ in range(120):
            op = rng.choices(["create", "rename", "delete", "modify"], [5, 3, 1, 1])[0]
            old = path()
            ops.append((op, old, rng.choice([path(), old + "/x", None, old]) if op == "rename" else None))
        logs[root] = ops
        rows += [(root, p, op, new, i // 3, i) for i, (op, p, new) in enumerate(ops)]
    rng.shuffle(rows)
    want = {(root, p) for root, ops in logs.items() for p in fold_tree(ops)}
    assert states(changelog.tree_state_with_renames(spark.createDataFrame(rows, LOG))) == want and len(want) > 5


def test_events_equal_the_folds(spark):
    log = changelog.rename_events(table(spark, SMALL, "events"))
    ops: dict = {}
    for r in log.orderBy("ts", "seq").collect():
        ops.setdefault(r.root, []).append((r.op, r.path, r.new_path))
    want = {(root, p) for root, own in ops.items() for p in fold_tree(own)}
    assert states(changelog.tree_state_with_renames(log)) == want and any(p.endswith("x") for _, p in want)
    log = changelog.open_events(table(spark, SMALL, "events"))
    ops = {}
    for r in log.orderBy("ts", "seq").collect():
        ops.setdefault(r.root, []).append((r.op, r.path))
    want = {(root, p) for root, own in ops.items() for p in fold_opened(own)}
    assert states(changelog.opened_paths(log)) == want and want


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], LOG)
    assert states(changelog.tree_state_with_renames(empty)) == states(changelog.opened_paths(empty)) == set()
    rows = [(None, "a", "create", None, 1, 1), ("r", None, "create", None, 1, 2), ("r", "a", "rename", None, 2, 3), ("r", "a", "create", None, None, 4)]
    assert states(changelog.tree_state_with_renames(spark.createDataFrame(rows, LOG))) == set()
