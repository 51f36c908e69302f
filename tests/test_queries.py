from pathlib import Path

import oracle
import pytest

from tidewire.plans import hawkes_queries, model_queries, operator_queries, record_queries

FOLDER = "/root/testdata/sf0.001"
PARTS = [hawkes_queries, model_queries, operator_queries, record_queries]
QUERIES = {n: q for p in PARTS for n, q in p.QUERIES.items()}
SQL = {n: s for p in PARTS for n, s in p.SQL.items()}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name in SQL:
        assert oracle.compare(spark, con, name, QUERIES[name], SQL[name], FOLDER).startswith("same")
    else:
        df = QUERIES[name](spark, FOLDER)
        assert df.count() == df.distinct().count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
