"""Every registered query against its DuckDB oracle on the smallest scale factor."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from memoria.plans.verify import compare, duck

SF = "/root/testdata/sf0.001"
# the optional corpus queries have tests of their own
KEYS = sorted(k for k in oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    from memoria.plans.catalog import load_all
    assert set(load_all()) <= set(oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, SF, key, queries()[key], oracle_sql()[key])
    assert r["values_match"], r


def test_entry_runs(spark):
    df = entry(spark)
    assert set(df.columns) >= {"query_id", "rank", "id", "similarity"}
    assert df.count() > 0
