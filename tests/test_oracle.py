"""Every registered query against its SQL twin on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from linden.plans import QUERIES
from tests.conftest import SMALL
from tests.helpers import canon

ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql_twin(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = canon(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_every_query_has_a_twin_or_is_known():
    no_twin = set(QUERIES) - set(ORACLE)
    assert no_twin <= set(getattr(E, "ROWS_ONLY", no_twin))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["t2", "t1", "t0", "n"]
    assert df.count() >= 0
