"""Heap-ordered k-means against plain Lloyd rounds."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoria.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, [max(-2 ** 27, min(2 ** 27, math.floor(64 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    cents = [list(v) for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(cents)), key=lambda j: (far(v, cents[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                cents[j] = [sum(c) // len(members) for c in zip(*members)]
    own = assign()
    dist = [far(v, cents[o]) for (_, v), o in zip(kept, own)]
    per = {j: sum(d for d, o in zip(dist, own) if o == j) for j in range(len(cents))}
    top = 2 ** 63 - 1
    return sorted(((i, o, d, min(per[o], top), min(sum(dist), top),
                    hashlib.sha256(",".join(map(str, cents[o])).encode()).hexdigest())
                   for (i, _), o, d in zip(kept, own, dist)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                "centroid_sha256").collect()), key=str)


def groups(n, spread, seed=3, centres=9):
    rng = random.Random(seed)
    mids = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(mids)]) for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_equals_plain_lloyd(spark, spread):
    rows = groups(700, spread)
    assert got(clusters.cluster(frame(spark, rows), shard_rows=90)) == brute(rows)


def test_awkward_rows(spark):
    rows = groups(60, 0.3)
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [float("nan")] * 64),
             (105, [float("inf")] + [0.0] * 63), (None, rows[4][1]), (3, rows[5][1]), (3, rows[5][1]),
             (106, [1e30] * 64), (107, [-1e30] * 64), (108, [0.0] * 64), (109, [-0.0] * 64), (110, [-1e-9] * 64)]
    df = frame(spark, rows)
    for c in ("cluster", "distance", "v", "x", "ids", "key", "width"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(clusters.cluster(df)) == brute(rows)


def test_ties_and_repeats_and_few_rows(spark):
    same = [(i, [0.5] * 64) for i in range(40)]
    assert got(clusters.cluster(frame(spark, same))) == brute(same)
    line = [(i, [float(i % 5)] + [0.0] * 63) for i in range(50)]
    assert got(clusters.cluster(frame(spark, line), shard_rows=7)) == brute(line)
    for n in (1, 3):
        assert got(clusters.cluster(frame(spark, same[:n]))) == brute(same[:n])
    empty = clusters.cluster(frame(spark, same).limit(0))
    assert empty.count() == 0 and empty.columns == clusters.cluster(frame(spark, same)).columns


def test_long_run_scans_only_expired_gaps(spark):
    rows = groups(2000, 0.05, seed=5, centres=6)
    df = clusters.usable(frame(spark, rows))
    state, cents = clusters.fit(df, clusters.first_centroids(df), rounds=8)
    scanned = state.agg(F.sum("scanned")).first()[0]
    assert scanned < len(rows) / 2      # the last round leaves most vectors in their heaps
    flat = [(tuple(r["ids"]), np.frombuffer(r["cluster"], "<i2").tolist()) for r in state.collect()]
    own = {i: c for ids, cs in flat for i, c in zip(ids, cs)}
    x = clusters.integers(np.array([v for _, v in rows]))
    assert [own[i] for i, _ in rows] == clusters.distances(x, cents).argmin(axis=1).tolist()
