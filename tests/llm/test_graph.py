"""Connected components against a plain union of sets."""
import random

from memoria.llm.graph import contract


def components(edges):
    label = {v: v for e in edges for v in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        for v in label:
            if label[v] == high:
                label[v] = low
    return label


def test_contract_paths(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 6)] + [(i, i + 1) for i in range(100, 250)]
    for k in range(80):
        ids = list(range(1000 + 40 * k, 1000 + 40 * k + rng.randint(2, 40)))
        rng.shuffle(ids)
        edges += [tuple(sorted(e)) for e in zip(ids, ids[1:])]
    # a star whose centre has the largest id
    edges += [(i, 9999) for i in range(9000, 9030)]
    want = components(edges)
    labels = spark.createDataFrame([(v, v) for v in want], "node long, label long")
    got = contract(labels, spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == want


def test_contract_keeps_earlier_classes(spark):
    labels = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (6, 6), (7, 7)], "node long, label long")
    got = contract(labels, spark.createDataFrame([(3, 5), (5, 6)], "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 7}
    got = contract(labels, spark.createDataFrame([], "a long, b long"))
    assert sorted(got.collect()) == sorted(labels.collect())
