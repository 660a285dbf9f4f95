"""Nearest neighbours by inner product with vantage-point trees per shard.

The largest inner product becomes a smallest distance in one more dimension:
a vector x of a shard is lifted to (x, sqrt(M^2 - |x|^2)), M the largest norm
of the shard, and a query to (q, 0). Every shard of bounded size gets a
vantage-point tree over its lifted vectors. The index is a table with one row
per shard; blocks of queries visit every shard and descend the tree together,
each query to its nearer child first. A child is skipped for a query if
|d - mu| * factor exceeds its distance to the k-th best, so factor one is the
exact triangle inequality and a larger factor prunes more. Candidates are
scored on the original vectors in double precision.
"""
from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
FACTOR = 1.0
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LEAF_ROWS = 512
BLOCKS_PER_TASK = 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): vectors that are not null, empty or zero and hold no null or non-finite component."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"),
                          (finite & F.exists(v, lambda x: x != 0)).alias("_ok"))
    return rows.where("_ok and vec_id is not null").select("vec_id", "v", F.size("v").alias("dim"))


class Tree:
    """Vantage-point tree over the lifted vectors of one shard, kept as flat arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        norms = (self.x * self.x).sum(axis=1)
        self.lift = np.sqrt(np.maximum(norms.max() - norms, 0.0))
        self.nodes: list[tuple] = []   # (vantage, mu, near, far) or (None, rows)
        self.root = self._build(np.arange(len(ids)), leaf_rows)

    def dump(self) -> bytes:
        return pickle.dumps((self.ids, self.x, self.lift, self.nodes, self.root))

    @classmethod
    def load(cls, blob: bytes) -> "Tree":
        tree = cls.__new__(cls)
        tree.ids, tree.x, tree.lift, tree.nodes, tree.root = pickle.loads(blob)
        return tree

    def _distance(self, rows: np.ndarray, vantage: int) -> np.ndarray:
        d = self.x[rows] - self.x[vantage]
        return np.sqrt((d * d).sum(axis=1) + (self.lift[rows] - self.lift[vantage]) ** 2)

    def _build(self, rows: np.ndarray, leaf_rows: int) -> int:
        if len(rows) <= leaf_rows:
            self.nodes.append((None, np.sort(rows)))
            return len(self.nodes) - 1
        # the row furthest from the first one sees the others under the widest spread of distances
        vantage = int(rows[np.argmax(self._distance(rows, int(rows[0])))])
        d = self._distance(rows, vantage)
        half = np.argsort(d, kind="stable")
        cut = len(rows) // 2
        mu = float(d[half[cut]])
        near, far = rows[half[:cut]], rows[half[cut:]]
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (vantage, mu, self._build(near, leaf_rows), self._build(far, leaf_rows))
        return at

    def search(self, qids: np.ndarray, q: np.ndarray, k: int, factor: float):
        """(query number, id, score) of the k best of every query, ties to the smaller id."""
        n = len(qids)
        qq = (q * q).sum(axis=1)
        top2 = float((self.x * self.x).sum(axis=1).max())
        best = np.full((n, k), -np.inf)      # scores so far, unordered
        found: list[tuple] = []

        def leaf(rows, live):
            s = q[live] @ self.x[rows].T
            s[self.ids[rows][None, :] == qids[live][:, None]] = -np.inf
            merged = np.concatenate([best[live], s], axis=1)
            merged = -np.partition(-merged, k - 1, axis=1)[:, :k]
            best[live] = merged
            floor = merged.min(axis=1)
            slack = 1e-9 * np.sqrt(qq[live] * top2) + 1e-300
            i, j = np.nonzero((s >= (floor - slack)[:, None]) & np.isfinite(s))
            if len(i):
                found.append((live[i], rows[j]))

        def visit(at, live):
            if not len(live):
                return
            node = self.nodes[at]
            if node[0] is None:
                leaf(node[1], live)
                return
            vantage, mu, near, far = node
            d = q[live] - self.x[vantage]
            d = np.sqrt((d * d).sum(axis=1) + self.lift[vantage] ** 2)
            inner = d < mu
            visit(near, live[inner])
            visit(far, live[~inner])
            floor = best[live].min(axis=1)
            # distance of the k-th best in the lifted space
            tau = np.sqrt(np.maximum(qq[live] + top2 - 2 * floor, 0.0)) * (1 + 1e-9) + 1e-9
            reach = np.abs(d - mu) * factor <= tau
            visit(far, live[inner & reach])
            visit(near, live[~inner & reach])

        visit(self.root, np.arange(n))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        qi = np.concatenate([f[0] for f in found])
        xi = np.concatenate([f[1] for f in found])
        # the measure itself, added in one fixed order so that equal vectors score the same
        score = np.zeros(len(qi))
        for c in range(q.shape[1]):
            score += q[qi, c] * self.x[xi, c]
        ids = self.ids[xi]
        order = np.lexsort((ids, -score, qi))
        qi, ids, score = qi[order], ids[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = rank < k
        return qi[keep], ids[keep], score[keep]


def _blob(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["vec_id"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy()
    return ids, flat.reshape(len(ids), -1)


def _gather(table: pa.Table) -> pa.Table:
    """One row (dim, part, rows, ids, x) of a group of queries."""
    table = table.sort_by("row")
    ids, x = _blob(table)
    return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int64()),
                     "rows": pa.array([table["row"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                     "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                     "x": pa.array([np.ascontiguousarray(x, dtype="<f8").tobytes()], pa.binary())})


def _index(leaf_rows: int):
    def run(table: pa.Table) -> pa.Table:
        ids, x = _blob(table)
        tree = Tree(ids, x, leaf_rows)
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()),
                         "part": pa.array([table["part"][0].as_py()], pa.int64()),
                         "tree": pa.array([tree.dump()], pa.binary())})
    return run


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(dim, part, tree): a vantage-point tree for every shard of every dimension, as a table."""
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(math.ceil(n / shard_rows))) for d, n in counts.items()],
                        F.lit(1))
    # equal rows are dealt over the shards too
    rows = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), shards))
    return materialize(rows.groupBy("dim", "part").applyInArrow(
        _index(leaf_rows), "dim int, part long, tree binary"), "trees")


def search(index: DataFrame, queries: DataFrame, n_queries: int, k: int = K, factor: float = FACTOR,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every query row over all shards.

    ``queries`` is a table of (vec_id, v, dim); its rows are numbered, so that rows of one id are queries of their own.
    """
    blocks = max(1, math.ceil(n_queries / block_rows))
    q = queries.withColumn("row", F.monotonically_increasing_id())
    q = q.withColumn("part", F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks)))
    q = materialize(q.groupBy("dim", "part").applyInArrow(
        _gather, "dim int, part long, rows binary, ids binary, x binary"), "blocks")
    # the grid of (shard, run of blocks): a tree meets a bounded number of blocks in a task
    shards = index.groupBy("dim").agg(F.max("part").alias("_last"))
    left = index.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS_PER_TASK))))
    right = q.join(shards, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("part"),
        F.floor(F.col("part") / BLOCKS_PER_TASK).cast("int").alias("run"), "rows", "ids", "x")

    def visit(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if trees.num_rows:
            tree = Tree.load(trees["tree"][0].as_py())
            for rows, ids, x in zip(asked["rows"], asked["ids"], asked["x"]):
                qids = np.frombuffer(ids.as_py(), "<i8")
                vec = np.frombuffer(x.as_py(), "<f8").reshape(len(qids), -1)
                qi, vid, score = tree.search(qids, vec, k, factor)
                for col, v in zip(out, (np.frombuffer(rows.as_py(), "<i8")[qi], qids[qi], vid, score)):
                    col.append(v)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(out, kinds)],
                        names=["row", "query_id", "vec_id", "score"])

    key = ["dim", "part", "run"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        visit, "row long, query_id long, vec_id long, score double")
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = K, factor: float = FACTOR, every: int = 20,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The k nearest of every vector whose id is divisible by ``every``, among all others.

    Returns query_id, rank (from 1), vec_id, score. Null, zero, empty or
    non-finite vectors and null ids take no part; vectors of another dimension
    are never neighbours; equal scores go to the smaller id; a query with fewer
    than k candidates gets all; an empty table gives an empty result; other
    columns are not read. Rows that repeat an id are queries of their own, each
    with its own ranks, and candidates of their own, except for queries of that id.
    """
    rows = materialize(usable(vectors), "vectors")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    return search(build_index(rows, shard_rows, leaf_rows), queries, queries.count(), k, factor, block_rows)
