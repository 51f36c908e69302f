from pathlib import Path

import oracle
import pytest

from tidewire.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

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
