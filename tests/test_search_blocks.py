"""Blocked kNN: equal to brute force, skips far blocks, nothing through the driver."""
import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoria.operators import search
from memoria.operators.search import knn

V = "id string, agent_id string, vector array<double>"
Q = "query_id long, agent_id string, vector array<double>"


def unit(v):
    v = np.array(v, dtype=float)
    return v / np.linalg.norm(v)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(vecs, queries, k):
    out = []
    for qid, scope, q in queries:
        if scope is None or not usable(q):
            continue
        hits = [(-round(float(unit(q) @ unit(v)), 9), i) for i, s, v in vecs if s == scope and usable(v) and len(v) == len(q)]
        out += [(qid, i, -s) for s, i in sorted(hits)[:k]]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["id"], round(r["similarity"], 9)) for r in df.collect())


def clustered(n, dim=16, centres=12, spread=0.05, seed=1, scopes=("a", "a", "a", "b")):
    rng = random.Random(seed)
    mids = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(f"v{i:05d}", rng.choice(scopes), [m + rng.gauss(0, spread) for m in rng.choice(mids)]) for i in range(n)]


def test_equals_brute_force_and_skips_far_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(search, "BLOCKS_PER_VISIT", 3)
    vecs = clustered(1500)
    queries = [(i, s, v) for i, (_, s, v) in enumerate(clustered(120, seed=1)[:120])]
    vdf = spark.createDataFrame(vecs, V).repartition(5)
    qdf = spark.createDataFrame(queries, Q).repartition(3)
    assert got(knn(vdf, qdf, 7)) == brute(vecs, queries, 7)
    qb, vb = search.blocks(qdf, "query_id", "agent_id", [], "q"), search.blocks(vdf, "id", "agent_id", [], "v")
    pairs = search.block_pairs(qb, vb, 7, "agent_id")
    hits = search._meet(pairs.where("seed").withColumn("run", F.lit(0)), qb, vb, 7)
    total = pairs.count()
    met = pairs.where("seed").count() + search.remaining_pairs(pairs, hits, qb, 7).count()
    assert met < 0.6 * total        # clustered directions: far blocks are never shuffled


def test_bounds_hold_for_every_pair(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 16)
    vecs = clustered(200, dim=5, spread=0.5, scopes=("a",))
    df = spark.createDataFrame(vecs, V)
    b = search.blocks(df, "id", "agent_id", [], "v")
    rows = {r["block"]: (np.frombuffer(r["x"], "<f8").reshape(-1, 5), r["n"]) for r in b.collect()}
    assert sum(n for _, n in rows.values()) == 200 and all(n <= 16 for _, n in rows.values())
    for r in search.block_pairs(b, b, 3, "agent_id").collect():
        assert (rows[r["qblock"]][0] @ rows[r["vblock"]][0].T).max() <= r["bound"] + 1e-9


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_awkward_rows(spark, monkeypatch, block_rows):
    monkeypatch.setattr(search, "BLOCK_ROWS", block_rows)
    vecs = [("a1", "s", [1.0, 0.0]), ("a2", "s", [2.0, 0.0]), ("a2", "s", [4.0, 0.0]), ("a3", "s", [1.0, 1.0, 0.0]),
            ("n1", "s", None), ("n2", "s", []), ("n3", "s", [0.0, 0.0]), ("n4", "s", [1.0, None]),
            ("n5", "s", [float("nan"), 1.0]), ("n6", "s", [float("inf"), 1.0]), ("n7", None, [1.0, 0.0]),
            ("big", "s", [1e200, 1e200]), ("tiny", "s", [1e-200, -1e-200]), ("é", "s", [-1.0, 0.0])]
    queries = [(1, "s", [1.0, 0.0]), (1, "s", [1.0, 0.0]), (2, "s", [0.0, 0.0]), (3, "s", None), (4, None, [1.0, 0.0]),
               (5, "s", [1.0, 1.0, 1.0]), (6, "t", [1.0, 0.0]), (7, "s", [1.0, None]), (8, "s", [1.0])]
    vdf = spark.createDataFrame(vecs, V).withColumn("n", F.lit("clash")).withColumn("block", F.lit("clash"))
    qdf = spark.createDataFrame(queries, Q).withColumn("x", F.lit("clash")).withColumn("code", F.lit("clash"))
    scaled = [(i, s, [x / 1e200 for x in v] if i == "big" else [x * 1e200 for x in v] if i == "tiny" else v)
              for i, s, v in vecs]
    assert got(knn(vdf, qdf, 4)) == brute(scaled, queries, 4)
    assert knn(vdf.limit(0), qdf, 4).count() == 0 and knn(vdf, qdf.limit(0), 4).count() == 0


def test_equal_vectors_tie_by_id_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 8)
    v = [0.3, -0.7, 0.11]
    vecs = [(f"c{i:03d}", "s", [x * (1 + i % 3) for x in v]) for i in range(100)]
    df = spark.createDataFrame(vecs, V).repartition(4)
    q = spark.createDataFrame([(i, "s", v) for i in range(5)], Q)
    by = collections.defaultdict(set)
    for r in knn(df, q, 6).collect():
        by[r["query_id"]].add(r["id"])
    same = [i for i, _, x in vecs if x == v]
    for ids in by.values():
        assert len(ids) == 6 and min(ids) == "c000"
    assert len(same) == 34


def test_no_driver_or_broadcast_step_in_the_plan(spark):
    vecs = clustered(300)
    df = spark.createDataFrame(vecs, V)
    q = df.select(F.monotonically_increasing_id().alias("query_id"), "agent_id", "vector")
    plan = knn(df, q, 5)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "LocalTableScan"):
        assert bad not in plan
