"""Lloyd's k-means on integer vectors with heap-ordered bounds.

Vectors are kept in shards, table rows of at most ``SHARD_ROWS`` vectors made
from consecutive rows of the input, so no vector is ever shuffled. A vector's
gap is its distance to the second nearest centroid less that to its own. When
centroids move, the gap of a vector of cluster j shrinks by at most the drift of
centroid j plus the largest drift of any other; every cluster accumulates that
sum, and its heap orders the vectors by gap plus the sum at the time of their
last scan. A round pops from a heap as long as the top does not exceed the
cluster's sum: only those vectors may have changed sides. They are scanned
exactly, against all centroids in 64-bit integers, and pushed again. A round
writes the shards anew; what passes the driver is k centroids and their sums.
"""
from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

DIM = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
SHARD_ROWS = 8192
# components beyond are held at the limit: squared distances of 64 components still fit 64 bits
LIMIT = 2 ** 27
# part of the distances by which rounding may err; a gap that small counts as expired
SLACK = 1e-9
_MAX_LONG = 2 ** 63 - 1

STATE = ("ids array<long>, x binary, width int, cluster binary, heap_keys binary, heap_rows binary, "
         "heap_sizes array<int>, distance binary, scanned int")
_FIELDS = ["ids", "x", "width", "cluster", "heap_keys", "heap_rows", "heap_sizes", "distance", "scanned"]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dim`` components, none null or non-finite, as double."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size(v) == dim) & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * v), held within LIMIT."""
    return np.clip(np.floor(v * scale), -LIMIT, LIMIT).astype(np.int64)


def first_centroids(rows: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``1:<vec_id>`` (a null id is written as nothing)."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return integers(np.array([r["v"] for r in top], dtype=float))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    out = np.empty((len(x), len(centroids)), dtype=np.int64)
    x = x.astype(np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Shard:
    """Vectors of one table row, their clusters and one heap of (gap key, row) per cluster."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.cluster, self.heaps, self.scanned = x, cluster, heaps, 0

    @classmethod
    def new(cls, x: np.ndarray, centroids: np.ndarray) -> "Shard":
        shard = cls(x, np.zeros(len(x), np.int16), [[] for _ in centroids])
        shard.scan(np.arange(len(x)), centroids, np.zeros(len(centroids)))
        return shard

    def scan(self, rows: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> None:
        """Assign ``rows`` exactly (ties to the smaller number) and push them with their gaps."""
        if not len(rows):
            return
        d = distances(self.x[rows], centroids)
        own = d.argmin(axis=1)
        self.cluster[rows] = own
        near = np.sqrt(d[np.arange(len(rows)), own].astype(float))
        d[np.arange(len(rows)), own] = _MAX_LONG
        far = np.sqrt(d.min(axis=1).astype(float)) if len(centroids) > 1 else np.full(len(rows), np.inf)
        key = far - near - SLACK * (near + np.where(np.isinf(far), 0.0, far) + 1.0) + moved[own]
        for k, r, j in zip(key.tolist(), rows.tolist(), own.tolist()):
            heapq.heappush(self.heaps[j], (k, r))
        self.scanned += len(rows)

    def update(self, centroids: np.ndarray, moved: np.ndarray) -> None:
        """Pop the vectors whose gap has expired and scan them again."""
        expired = []
        for heap, limit in zip(self.heaps, moved.tolist()):
            while heap and heap[0][0] <= limit:
                expired.append(heapq.heappop(heap)[1])
        self.scan(np.array(sorted(expired), dtype=np.int64), centroids, moved)

    def own_distances(self, centroids: np.ndarray) -> np.ndarray:
        d = self.x.astype(np.int64) - centroids[self.cluster]
        return np.einsum("ij,ij->i", d, d)

    def dump(self, ids: pa.Array, distance: np.ndarray | None = None) -> pa.RecordBatch:
        flat = [item for heap in self.heaps for item in heap]
        one = lambda v, t: pa.array([v], t)
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            one(np.ascontiguousarray(self.x).tobytes(), pa.binary()), one(self.x.dtype.itemsize, pa.int32()),
            one(self.cluster.astype("<i2").tobytes(), pa.binary()),
            one(np.array([f[0] for f in flat], "<f8").tobytes(), pa.binary()),
            one(np.array([f[1] for f in flat], "<i4").tobytes(), pa.binary()),
            one([len(h) for h in self.heaps], pa.list_(pa.int32())),
            one(b"" if distance is None else distance.astype("<i8").tobytes(), pa.binary()),
            one(self.scanned, pa.int32())], _FIELDS)

    @classmethod
    def load(cls, row: dict, dim: int) -> "Shard":
        x = np.frombuffer(row["x"].as_py(), f"<i{row['width'].as_py()}").reshape(-1, dim)
        keys = np.frombuffer(row["heap_keys"].as_py(), "<f8").tolist()
        rows = np.frombuffer(row["heap_rows"].as_py(), "<i4").tolist()
        heaps, at = [], 0
        for n in row["heap_sizes"].as_py():
            heaps.append(list(zip(keys[at:at + n], rows[at:at + n])))
            at += n
        return cls(x, np.frombuffer(row["cluster"].as_py(), "<i2").copy(), heaps)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(np.abs(x).max()) if x.size else 0
    return x.astype("<i1" if top < 2 ** 7 else "<i2" if top < 2 ** 15 else "<i4")


def _start(centroids: np.ndarray, shard_rows: int, last: bool):
    def run(batches):
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for at in range(0, b.num_rows, shard_rows):
                shard = Shard.new(_narrow(integers(v[at:at + shard_rows])), centroids)
                yield shard.dump(b.column("vec_id").slice(at, shard_rows),
                                 shard.own_distances(centroids) if last else None)
    return run


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(name)[i] for name in b.schema.names}


def _step(centroids: np.ndarray, moved: np.ndarray, last: bool):
    def run(batches):
        for row in _rows(batches):
            shard = Shard.load(row, centroids.shape[1])
            shard.update(centroids, moved)
            yield shard.dump(row["ids"].values, shard.own_distances(centroids) if last else None)
    return run


def _sums(k: int, dim: int):
    """(cluster, item, value): per task the sum of every component and, as item -1, the number of vectors."""
    def run(batches):
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for row in _rows(batches):
            x = np.frombuffer(row["x"].as_py(), f"<i{row['width'].as_py()}").reshape(-1, dim)
            own = np.frombuffer(row["cluster"].as_py(), "<i2")
            for j in np.unique(own):
                members = x[own == j]
                total[j] += members.sum(axis=0, dtype=np.int64)
                count[j] += len(members)
        live = np.nonzero(count)[0]
        value = np.concatenate([count[live, None], total[live]], axis=1)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(live, dim + 1).astype(np.int32)),
            pa.array(np.tile(np.arange(-1, dim, dtype=np.int32), len(live))),
            pa.array(value.ravel())], ["cluster", "item", "value"])
    return run


def _inertia(k: int):
    """(cluster, high, low): sums of the distances' parts above and below 31 bits, per task."""
    def run(batches):
        high, low = [0] * k, [0] * k
        for row in _rows(batches):
            own = np.frombuffer(row["cluster"].as_py(), "<i2")
            d = np.frombuffer(row["distance"].as_py(), "<i8")
            for j in np.unique(own):
                high[j] += int((d[own == j] >> 31).sum())
                low[j] += int((d[own == j] & 0x7FFFFFFF).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(high, pa.int64()),
                                          pa.array(low, pa.int64())], ["cluster", "high", "low"])
    return run


def _explode(batches):
    for row in _rows(batches):
        yield pa.RecordBatch.from_arrays([
            row["ids"].values, pa.array(np.frombuffer(row["cluster"].as_py(), "<i2").astype(np.int32)),
            pa.array(np.frombuffer(row["distance"].as_py(), "<i8"))], ["vec_id", "cluster", "distance"])


def _new_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    k, dim = centroids.shape
    parts = state.select("x", "width", "cluster").mapInArrow(_sums(k, dim), "cluster int, item int, value long")
    sums = parts.groupBy("cluster", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    value = {(r["cluster"], r["item"]): int(r["value"]) for r in sums}
    out = centroids.copy()
    for j in range(k):
        if (j, -1) in value:
            out[j] = [value[j, i] // value[j, -1] for i in range(dim)]
    return out


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much the gap of a vector of every cluster can have shrunk."""
    step = np.sqrt(((new - old).astype(float) ** 2).sum(axis=1))
    others = np.array([np.delete(step, j).max(initial=0.0) for j in range(len(step))])
    return (step + others) * (1 + SLACK)


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS, shard_rows: int = SHARD_ROWS):
    """(state table, final centroids): ``rounds`` updates of the centroids, then a last assignment."""
    moved = np.zeros(len(centroids))
    state = materialize(rows.mapInArrow(_start(centroids, shard_rows, rounds == 0), STATE), "shards")
    for r in range(rounds):
        new = _new_centroids(state, centroids)
        moved = moved + drift(centroids, new)
        old, centroids = state, new
        state = materialize(old.mapInArrow(_step(centroids, moved, r == rounds - 1), STATE), "shards")
        discard(old)
    return state, centroids


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The cluster of every usable vector after ``rounds`` rounds of Lloyd's algorithm.

    Returns vec_id, cluster, distance (squared, to the final centroid),
    cluster_inertia, inertia and centroid_sha256. Vectors that are null, of
    another length or with null or non-finite components take no part; a null
    id is kept; rows that repeat an id are vectors of their own; fewer than k
    vectors make fewer clusters; ties go to the smaller number; a cluster
    without vectors keeps its centroid; components beyond 2^27 after scaling are
    held there and sums beyond 64 bits at the largest long; an empty table gives
    an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dim=dim)
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid_sha256 string")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    state, centroids = fit(rows, centroids, rounds, shard_rows)
    n = len(centroids)
    parts = state.select("cluster", "distance").mapInArrow(_inertia(n), "cluster int, high long, low long")
    total = [0] * n
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    for r in parts.groupBy("cluster").agg(*exact).collect():
        total[r["cluster"]] = (int(r["high"]) << 31) + int(r["low"])
    held = [min(t, _MAX_LONG) for t in total]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    flat = state.select("ids", "cluster", "distance").mapInArrow(_explode, "vec_id long, cluster int, distance long")
    return flat.select("vec_id", "cluster", "distance",
                       pick(held).cast("long").alias("cluster_inertia"),
                       F.lit(min(sum(total), _MAX_LONG)).cast("long").alias("inertia"),
                       pick(names).alias("centroid_sha256"))
