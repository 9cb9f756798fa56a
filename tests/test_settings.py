"""Nested settings and nearest rule files against plain Python."""

import json

from pyspark.sql import functions as F

from linden.operators import paths
from linden.operators import records as rec


def merge(primary, secondary):
    out = dict(primary)
    for k, v in secondary.items():
        section = out.get(k)
        out[k] = {**section, **v} if isinstance(v, dict) and isinstance(section, dict) else v
    return out


CASES = [({}, {}), ({"a": 1}, {}), ({}, {"a": {"b": None}}), ({"a": {"x": 1, "y": {"p": 1}}}, {"a": {"y": {"q": 2}, "z": [1, {"k": 2}]}}),
         ({"a": {"x": 1}}, {"a": 5}), ({"a": 5}, {"a": {"x": 1}}), ({"a": None, "b": "s"}, {"a": {"x": None}, "b": None}),
         ({"a": {"x": 1}}, {"a": {}}), ({"ä\"\\ b": {"é": "\n"}}, {"ä\"\\ b": {"c]": "\"q\""}}), ({"a": {"x": 1.5, "t": True}}, {"c": {"d": {"e": {}}}})]


def test_merge_equals_dicts(spark):
    df = spark.createDataFrame([(i, json.dumps(p), json.dumps(s)) for i, (p, s) in enumerate(CASES)], "i int, p string, s string")
    got = {r.i: json.loads(r.m) for r in df.select("i", rec.merge_configs(F.col("p"), F.col("s")).alias("m")).collect()}
    assert got == {i: merge(p, s) for i, (p, s) in enumerate(CASES)}


def test_broken_texts_are_empty(spark):
    df = spark.createDataFrame([(None, '{"a":1}'), ("[1]", '{"a":1}'), ("{bad", '{"a":1}'), ('{"a":1}', None), (None, None)], "p string, s string")
    assert sorted(r.m for r in df.select(rec.merge_configs(F.col("p"), F.col("s")).alias("m")).collect()) == ['{"a":1}'] * 4 + ["{}"]


def test_inner_rule_file_replaces_the_outer(spark):
    files = [("", 0, "*.log"), ("", 1, "build/"), ("src", 0, "# only this file counts below src"), ("src", 1, "*.tmp"), ("src", 2, "!keep.tmp"),
             ("src/gen", 0, "*"), ("src/gen", 1, "!*.py"), ("quiet", 0, "# nothing"), ("quiet", 1, None)]
    want = {"a.log": True, "build/x.py": True, "src/a.log": False, "src/a.tmp": True, "src/keep.tmp": False, "src/deep/b.tmp": True,
            "src/gen/a.txt": True, "src/gen/a.py": False, "quiet/a.log": False, "x/a.py": False, "": False,
            "1/2/3/4/a.log": True, "1/2/3/4/5/a.log": False, "src/2/3/4/5/a.tmp": True, "src/2/3/4/5/6/a.tmp": False}
    rows = [(p, f"d{p}") for p in [*want, None]]
    got = paths.nearest_ignored(spark.createDataFrame(rows, "rel string, dir string"), spark.createDataFrame(files, "dir string, n int, rule string"))
    assert got.columns == ["rel", "dir", "rule_dir", "ignored"]
    assert {r.rel: r.ignored for r in got.collect()} == {**want, None: False}
