"""The queries of this package that SQL can express, against that SQL on the smallest tables."""

from pathlib import Path

import pytest

import compare_oracles
from sheaf.llm.oracles import ORACLES
from sheaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare_oracles.open_duckdb(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert name in QUERIES
    verdict = compare_oracles.compare(spark, con, SF, name)
    assert verdict.startswith("ok"), verdict
