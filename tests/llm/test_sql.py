"""Corpus queries with oracle SQL against DuckDB on the smallest scale factor."""
import pytest

from memoria.llm.queries import QUERIES
from memoria.llm.sql import SQL
from memoria.plans.verify import compare, duck

SF = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, key):
    r = compare(spark, duck(SF), SF, key, QUERIES[key], SQL[key])
    assert r["values_match"], r
