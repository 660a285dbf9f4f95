"""Plan shape checks: no pair-emitting joins anywhere; top-k cuts pruned map-side."""
import pytest

from __spark_entry__ import queries
from memoria.plans.catalog import load_all

SF = "/root/testdata/sf0.001"
PAIR_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(spark, key):
    df = queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(load_all()))
def test_no_cross_or_nested_loop_joins(spark, key):
    plan = _plan(spark, key)
    for op in PAIR_JOINS:
        assert op not in plan, f"{key} plans {op}"


@pytest.mark.parametrize("key", ["recent_interactions", "key_preferences", "summarize_candidates",
                                 "endpoint_lookup", "cosine_similarity"])
def test_top_k_is_pruned_before_the_shuffle(spark, key):
    assert "WindowGroupLimit" in _plan(spark, key)


def test_scan_prunes_columns(spark):
    plan = _plan(spark, "doc_cost")
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan
