"""Every registered query against its DuckDB oracle at sf0.01 (the
driver's correctness gate), plus the entry() smoke check."""
import os

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = os.environ.get("LW_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "lineage_status" in df.columns
