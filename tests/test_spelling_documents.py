"""Scope flags and spelling of whole documents, without a shuffle of their
tokens, against the forms over token rows."""

import random

from pyspark.sql import functions as F

from linden.operators import retrieve as rt
from linden.operators import candidates as cd
from linden.operators import spelling as sp
from linden.sources import views

TEXTS = ["class SomethingWorng(base):", "import fooBar, os as zip", "from foo_bar import BazQux, wibbly", "def fn(self, valuee, other_nam=1):", "def open(xyz,", "  abcd, efgh",
         "):", "for itemm in items:", "for (keyy, vall)", "  in pairs: wobbly = 3", "x = 'strng wibbly Über über foob'", "# wibbly wobbly FOO foobar ünder", "flurbleGlonk = 2", "fooBarBaz = glonk", "",
         "import foobar, Glonk", "foob1_itemm2 = SOME_CONST", "as_ = import_ as wibbly", "1.5 = 'x'", "# flurble glonk itemm valuee bazqux qux", "wibbly = Wibbly"]
WORDS = ["foobar", "something", "items", "item", "constant", "base", "bazqux", "under", "xyz"]


def _docs(spark, seed=11):
    rnd = random.Random(seed)
    docs = []
    for d in range(8):
        codes = [rnd.choice(TEXTS) for _ in range(rnd.choice((1, 4, 12, 40)))]
        docs.append((d, codes, [(rnd.choice(["wibbly", "itemm", "glonk", "foo", "valuee"]), rnd.randrange(40)) for _ in range(rnd.choice((0, 2, 5)))]))
    docs += [(20, TEXTS, [("wibbly", 3), ("wibbly", 1)]), (21, [], []), (22, [""], [])]
    return spark.createDataFrame(docs, "doc_id long, codes array<string>, project array<struct<w:string,line:int>>")


def _lines(docs):
    return docs.select("doc_id", F.posexplode("codes").alias("line", "text"))


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_scope_flags_of_documents(spark):
    docs = _docs(spark)
    got = sp.document_scope_flags(docs.select("doc_id", "codes"))
    want = sp.scope_flags(views.tokens(_lines(docs)))
    assert got.columns == want.columns and _rows(got) == _rows(want) and got.where("def_ and for_").count() > 0
    assert _shuffles(got) == 0


def test_spelling_of_documents(spark):
    docs, words = _docs(spark), spark.createDataFrame([(w,) for w in WORDS], "w string")
    tokens = views.tokens(_lines(docs))
    got = sp.document_spelling(docs.select("doc_id", "codes"), words)
    want = sp.spelling(tokens, words)
    assert got.columns == want.columns and _rows(got) == _rows(want) and got.count() > 50
    project = docs.select("doc_id", F.explode("project").alias("p")).select("doc_id", "p.w", "p.line")
    with_project = _rows(sp.document_spelling(docs, words))
    assert with_project == _rows(sp.spelling(tokens, words, project=project)) != _rows(want)
    assert _shuffles(sp.document_checks(docs)) == 0


def test_import_of_a_dictionary_word_does_not_make_its_parts_known(spark):
    words = spark.createDataFrame([("foobar",)], "w string")
    docs = spark.createDataFrame([(1, ["import fooBar", "# barr fooo", "x = 1 # none", "a_barr = 2"]), (2, ["import glonkBarr", "x = '' # glonk barr"])], "doc_id long, codes array<string>")
    assert {(r.doc_id, r.token) for r in sp.document_spelling(docs, words).collect()} == {(1, "barr"), (1, "fooo"), (1, "none")}
    part = spark.createDataFrame([(1, ["import quuxBarr", "# quux"]), (2, ["import fooBarr", "# barr"]), (3, ["import fooBar", "# barr"])], "doc_id long, codes array<string>")
    known = spark.createDataFrame([("foobarr",)], "w string")
    assert {(r.doc_id, r.token) for r in sp.document_spelling(part, known).collect()} == {(2, "barr"), (3, "barr")}


def test_full_statements_of_documents(spark):
    docs = _docs(spark, 3).select("doc_id", "codes").union(spark.createDataFrame([(30, [f"{'for ' * (i % 3 > 1)}alpha{i % 50} = beta({i}, [x) # c" for i in range(130)])], "doc_id long, codes array<string>"))
    lines = _lines(docs)
    got = rt.document_full_statement(docs)
    want = rt.full_statement(cd.positions(views.tokens(lines)).select("doc_id", "line", "pos", "t"), lines)
    assert got.columns == want.columns and _rows(got) == _rows(want) and got.count() > 100
    assert _shuffles(got) == 0
