"""The code view keeps every word of a document."""

from collections import Counter

from pyspark.sql import functions as F

from linden.functions import lexicon as lx
from linden.plans.common import code_lines, doc_lines
from linden.sources import views
from tests.conftest import SMALL


def test_words_in_equal_words_out(spark):
    words = F.regexp_extract_all(F.lower("text"), F.lit(lx.WORD_PATTERN), 0)
    lines = doc_lines(spark, SMALL)
    comments = {(r.doc_id, r.line): r.ws for r in code_lines(spark, SMALL).where("line % 2 = 1").select("doc_id", "line", words.alias("ws")).collect()}
    total = 0
    for r in lines.select("doc_id", "line", words.alias("ws")).collect():
        used = views.CODE_WORDS[r.line % 8]
        assert comments[r.doc_id, 2 * r.line + 1] == r.ws[used:]
        total += len(r.ws)
    assert total > 50_000 and len(comments) == lines.count()


def test_code_line_holds_the_first_words(spark):
    texts = [f"a{'bcdefgh'[k]} ba ca da ea" for k in range(7)] + ["ah ba ca da ea", "x", ""]
    df = spark.createDataFrame([(0, i, t.replace("a", "q")) for i, t in enumerate(texts)], "doc_id long, line int, text string")
    got = views.code_lines(df).orderBy("line").collect()
    assert [r.line for r in got] == list(range(20))
    for i, t in enumerate(texts):
        out = Counter(w for r in got[2 * i:2 * i + 2] for w in r.text.lower().replace("_", " ").replace("(", " ").replace(")", " ").replace(".", " ")
                      .replace(",", " ").replace("qs:", "q ").replace("1 =", " ").replace("=1", " ").replace("[0]", " ").replace(":", " ").split())
        assert not Counter(t.replace("a", "q").split()) - out, (i, t)
