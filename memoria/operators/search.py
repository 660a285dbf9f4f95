"""Exact cosine nearest-neighbour search and the two-stage semantic search.

Design (neither side passes the driver or a broadcast, no pair rows are made):
* vectors and queries are laid out alike: unit vectors are range-partitioned by
  (scope, dimension, sign code of fixed random planes), so a large scope is
  spread over many ranges and near directions lie together; every range is cut
  into blocks of at most ``BLOCK_ROWS`` vectors with a centre and the angle
  that holds all of them;
* block pairs of one scope are compared by centre and angle alone. A query
  block first meets its nearest blocks, a full visit of them; what its worst
  query found there bounds the rest, and pairs whose angles cannot reach that
  similarity are skipped before any vector is shuffled;
* the remaining pairs meet in co-groups of one query block and a bounded run of
  vector blocks; a task multiplies them tile by tile (bounded memory), keeps the
  k best of each query and emits them once;
* similarities are summed in one fixed order, so equal vectors tie exactly, and
  ties go to the smaller id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit
from ..session import written

BLOCK_ROWS = 4096
# vector blocks that a query block meets in one task
BLOCKS_PER_VISIT = 16
# elements of one similarity tile (queries x vectors) held at once in a task
TILE_ELEMENTS = 4 << 20
CODE_BITS = 12
# a block ends where the code changes once it holds this part of BLOCK_ROWS
FILL = 8
# groups over which the block pairs of one scope are dealt
SCOPE_SALTS = 16
SLACK = 1e-9


def _matrix(arr: pa.Array, dim: int) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _usable(df: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: not null or empty, no null or non-finite component, not all zero."""
    v = F.col("vector")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.withColumn("vector", v.cast("array<double>")).where(ok).withColumn("dim", F.size("vector"))


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors, and the sides of fixed random planes on which they lie as a number."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            x = _matrix(part.column("vector"), int(dim))
            # scaled first, so that very large components do not overflow their squares
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            planes = np.random.default_rng(int(dim)).normal(size=(int(dim), CODE_BITS))
            code = ((x @ planes) > 0) @ (1 << np.arange(CODE_BITS))
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            names = [n for n in part.schema.names if n != "vector"]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], unit, pa.array(code.astype(np.int32))],
                                             [*names, "vector", "code"])


def _cut(scope: str, names: list[str], block_rows: int):
    """Sorted rows to blocks: one row (scope, dim, block, n, x, centre, radius, arrays of ``names``)."""
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, size, key, last = [], 0, None, None

        def close():
            nonlocal held, size, seq
            table = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(table["vector"].chunk(0), key[1])
            centre = x.mean(axis=0)
            norm = np.sqrt(centre @ centre)
            centre = x[0] if norm < SLACK else centre / norm
            radius = float(np.arccos(np.clip(x @ centre, -1.0, 1.0)).max()) + 1e-7
            one = lambda v, t=None: pa.array([v], t)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), table[n].chunk(0)) for n in names]
            out = pa.RecordBatch.from_arrays(
                [one(key[0], table.schema.field(scope).type), one(key[1], pa.int32()),
                 one(part << 32 | seq, pa.int64()), one(len(x), pa.int64()),
                 one(np.ascontiguousarray(x, "<f8").tobytes()), one(centre.tolist()), one(radius), *lists],
                [scope, "dim", "block", "n", "x", "centre", "radius", *names])
            held, size, seq = [], 0, seq + 1
            return out

        for b in batches:
            rows = list(zip(b.column(scope).to_pylist(), b.column("dim").to_pylist()))
            codes, at = b.column("code").to_pylist(), 0
            for i in range(b.num_rows):
                full = size + i - at
                if full and (rows[i] != key or full >= block_rows or (codes[i] != last and full * FILL >= block_rows)):
                    if i > at:
                        held.append(b.slice(at, i - at))
                    yield close()
                    at = i
                key, last = rows[i], codes[i]
            if at < b.num_rows:
                held.append(b.slice(at))
                size += b.num_rows - at
        if held:
            yield close()
    return run


def blocks(df: DataFrame, id_col: str, scope: str, extra: list[str], tag: str) -> DataFrame:
    """Blocks of the usable rows of ``df`` (id, scope, vector, extra), as a table in the shared folder."""
    kinds = dict(df.dtypes)
    rows = _usable(df.where(F.col(scope).isNotNull()))
    keep = [scope, "dim", id_col, *extra]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'int')}" for c in keep) + ", vector array<double>, code int"
    coded = rows.select(*keep, "vector").mapInArrow(_code, schema)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [scope, "dim", "code", id_col]
    names = [id_col, *extra]
    out = (f"`{scope}` {kinds[scope]}, dim int, block long, n long, x binary, centre array<double>, radius double, "
           + ", ".join(f"`{c}` array<{kinds[c]}>" for c in names))
    laid = coded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(laid.mapInArrow(_cut(scope, names, BLOCK_ROWS), out), tag)


def _filter_mask(qsess, qtypes, vsess, vtypes) -> np.ndarray | None:
    """(queries x vectors) mask of the optional per-query filters (FLT7), or None."""
    mask = None
    if qsess is not None:
        any_s = np.array([x is None for x in qsess])
        mask = (qsess[:, None] == vsess[None, :]) | any_s[:, None]
    if qtypes is not None:
        names, codes = np.unique(np.asarray([str(x) for x in vtypes]), return_inverse=True)
        allowed = np.array([[not ts or n in ts for n in names] for ts in qtypes], dtype=bool).reshape(len(qtypes), len(names))
        tmask = allowed[:, codes]
        mask = tmask if mask is None else mask & tmask
    return mask


def _best(slot: np.ndarray, sim: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` best (similarity desc, id asc) of every slot; the order is total, so merging stays exact."""
    place = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)
    order = np.lexsort((place, -sim, slot))
    s = slot[order]
    keep = order[np.arange(len(s)) - np.searchsorted(s, s) < k]
    return slot[keep], sim[keep], ids[keep]


def _visit(k: int, dim_col: str = "dim"):
    """One query block against a run of vector blocks: (qblock, slot, query_id, id, similarity)."""
    def objects(table, name, i):
        return None if name not in table.column_names else np.array(table[name][i].as_py() + [None], dtype=object)[:-1]

    def run(asked: pa.Table, met: pa.Table) -> pa.Table:
        out = pa.schema([("qblock", pa.int64()), ("slot", pa.int32()), ("query_id", pa.int64()), ("id", pa.string()),
                         ("similarity", pa.float64())])
        if not asked.num_rows or not met.num_rows:
            return out.empty_table()
        dim = asked[dim_col][0].as_py()
        q = np.frombuffer(asked["x"][0].as_py(), "<f8").reshape(-1, dim)
        qsess, qtypes = objects(asked, "session_id", 0), objects(asked, "memory_types", 0)
        slot, sim, ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        floor = np.full(len(q), -np.inf)
        for i in range(met.num_rows):
            v = np.frombuffer(met["x"][i].as_py(), "<f8").reshape(-1, dim)
            vid = objects(met, "id", i)
            vsess, vtypes = objects(met, "session_id", i), objects(met, "memory_type", i)
            step = max(1, TILE_ELEMENTS // len(v))
            found = [(slot, sim, ids)]
            for q0 in range(0, len(q), step):
                q1 = min(q0 + step, len(q))
                s = q[q0:q1] @ v.T
                mask = _filter_mask(None if qsess is None else qsess[q0:q1], None if qtypes is None else qtypes[q0:q1],
                                    vsess, vtypes)
                if mask is not None:
                    s = np.where(mask, s, -np.inf)
                least = floor[q0:q1]
                if s.shape[1] > k:
                    least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1])
                a, b = np.nonzero((s >= least[:, None] - SLACK) & np.isfinite(s))
                exact = np.zeros(len(a))
                for c in range(dim):
                    exact += q[q0 + a, c] * v[b, c]
                found.append((a + q0, exact, vid[b]))
            slot, sim, ids = _best(*(np.concatenate(c) for c in zip(*found)), k)
            # the last row of a slot that has k is its k-th best
            full = np.bincount(slot, minlength=len(q))[slot] == k
            last = np.nonzero(full & np.append(slot[1:] != slot[:-1], True)[:len(slot)])[0]
            floor[slot[last]] = sim[last]
        qid = np.array(asked["query_id"][0].as_py(), dtype=np.int64)
        return pa.table([pa.array(np.full(len(slot), asked["qblock"][0].as_py(), np.int64)),
                         pa.array(slot.astype(np.int32)), pa.array(qid[slot]), pa.array(ids, pa.string()),
                         pa.array(sim)], schema=out)
    return run


def _meet(pairs: DataFrame, qblocks: DataFrame, vblocks: DataFrame, k: int) -> DataFrame:
    """The k best hits per query over the vector blocks of ``pairs`` (qblock, run, vblock), for each run."""
    asked = qblocks.withColumnRenamed("block", "qblock").drop("centre", "radius", "n").join(
        pairs.select("qblock", "run").distinct(), "qblock")
    met = vblocks.withColumnRenamed("block", "vblock").drop("centre", "radius", "n").join(
        pairs.select(F.col("qblock").alias("by"), F.col("run").alias("visit"), "vblock"), "vblock")
    return asked.groupBy("qblock", "run").cogroup(met.groupBy("by", "visit")).applyInArrow(
        _visit(k), "qblock long, slot int, query_id long, id string, similarity double")


def block_pairs(qblocks: DataFrame, vblocks: DataFrame, k: int, scope: str) -> DataFrame:
    """(qblock, vblock, bound, seed): the blocks of one scope and dimension.

    ``bound`` is the largest similarity that any pair of their vectors can have;
    ``seed`` marks the nearest blocks of a query block: ``BLOCKS_PER_VISIT`` of
    them, and more until they hold k vectors.
    """
    q = qblocks.select(scope, "dim", F.col("block").alias("qblock"), F.col("centre").alias("qc"),
                       F.col("radius").alias("qr"), F.pmod(F.xxhash64("block"), F.lit(SCOPE_SALTS)).alias("_salt"))
    v = vblocks.select(scope, "dim", F.col("block").alias("vblock"), "centre", "radius", "n",
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SCOPE_SALTS - 1).cast("long"))).alias("_salt"))
    dot = F.aggregate(F.zip_with("centre", "qc", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    gap = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))
    free = F.col("gap") - F.col("radius") - F.col("qr")
    order = Window.partitionBy("qblock").orderBy("gap", "vblock")
    held = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = q.join(v, [scope, "dim", "_salt"]).withColumn("gap", gap)
    return met.select("qblock", "vblock", F.when(free > 0, F.cos(free)).otherwise(F.lit(1.0)).alias("bound"),
                      ((F.row_number().over(order) <= BLOCKS_PER_VISIT) | (held < k)).alias("seed"))


def remaining_pairs(pairs: DataFrame, hits: DataFrame, qblocks: DataFrame, k: int) -> DataFrame:
    """The pairs that may still better what the worst query of the block found in its seeds."""
    worst = hits.groupBy("qblock", "slot").agg(F.count(F.lit(1)).alias("c"), F.min("similarity").alias("s"))
    reached = worst.groupBy("qblock").agg(F.count_if(F.col("c") == k).alias("full"), F.min("s").alias("s"))
    floor = qblocks.select(F.col("block").alias("qblock"), "n").join(reached, "qblock", "left").select(
        "qblock", F.when(F.col("full") == F.col("n"), F.col("s")).otherwise(F.lit(-2.0)).alias("floor"))
    left = pairs.where("not seed").join(floor, "qblock").where(F.col("bound") >= F.col("floor") - SLACK)
    place = F.row_number().over(Window.partitionBy("qblock").orderBy("vblock"))
    return written(left.select("qblock", "vblock", F.floor((place - 1) / BLOCKS_PER_VISIT).cast("int").alias("run")),
                   "left-pairs")


def knn(vectors: DataFrame, queries: DataFrame, k: int, scope: str = "agent_id") -> DataFrame:
    """Exact top-``k`` vectors by cosine similarity per query, within ``scope``.

    vectors: (id string, ``scope``, vector array<double>[, session_id, memory_type])
    queries: (query_id long, ``scope``, vector array<double>[, session_id, memory_types])
    Optional query filters (FLT7, applied before ranking): ``session_id``
    (null: any) and ``memory_types`` (null or empty: any).
    Returns (query_id, id, similarity), at most k rows per query row (ties at the
    boundary broken by id). On both sides, rows with a null scope or a vector that
    is null, empty, zero or holds null or non-finite components take no part,
    and vectors of another length than the query's are no neighbours.
    """
    f_sess = "session_id" in queries.columns
    f_types = "memory_types" in queries.columns
    vectors = vectors.withColumn("id", F.col("id").cast("string"))
    queries = queries.withColumn("query_id", F.col("query_id").cast("long"))
    vblocks = blocks(vectors, "id", scope, ["session_id"] * f_sess + ["memory_type"] * f_types, "vector-blocks")
    qblocks = blocks(queries, "query_id", scope, ["session_id"] * f_sess + ["memory_types"] * f_types, "query-blocks")
    pairs = block_pairs(qblocks, vblocks, k, scope)
    seeds = _meet(pairs.where("seed").withColumn("run", F.lit(0)), qblocks, vblocks, k)
    if pairs.where("not seed").limit(1).count():
        seeds = written(seeds, "seed-hits")
        rest = remaining_pairs(pairs, seeds, qblocks, k)
        if rest.limit(1).count():
            seeds = seeds.unionByName(_meet(rest, qblocks, vblocks, k))
    w = Window.partitionBy("qblock", "slot").orderBy(F.desc("similarity"), F.asc("id"))
    return seeds.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select(
        "query_id", "id", "similarity")


def semantic_search(memories: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10,
                    min_score: float = 0.0, as_of=None, scope: str = "agent_id") -> DataFrame:
    """CMP1: scope -> nearest 2*limit -> min score -> join rows -> access +1 -> re-rank -> limit.

    Ranking is two-stage (trap T5): similarity picks the 2*limit candidates,
    sim*importance*confidence orders the survivors. Hits without a memory row
    are dropped. ``access_count`` is the raised value as of this query, and
    ``last_accessed`` is ``as_of`` for every returned hit.
    """
    hits = knn(vectors, queries, 2 * limit, scope).where(F.col("similarity") >= F.lit(float(min_score)))
    rows = memories.select("id", "content", "summary", "memory_type", "importance", "confidence",
                           "access_count", "created_at", "tags")
    j = hits.join(rows, "id", "inner")
    combined = F.col("similarity") * F.col("importance") * F.col("confidence")
    w = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), F.desc("similarity"), F.asc("id"))
    return (j.withColumn("combined_score", combined)
             .withColumn("access_count", (F.col("access_count") + 1).cast("int"))
             .withColumn("last_accessed", as_of_lit(as_of))
             .withColumn("rank", F.row_number().over(w))
             .where(F.col("rank") <= limit))


def search_hits(memories: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 10,
                min_score: float = 0.0, scope: str = "agent_id") -> DataFrame:
    """All joined hits of the search (before the final cut): the rows whose access
    count rises (JN7 input)."""
    hits = knn(vectors, queries, 2 * limit, scope).where(F.col("similarity") >= F.lit(float(min_score)))
    return hits.join(memories.select("id"), "id", "left_semi")


def recall_format(results: DataFrame) -> DataFrame:
    """PRJ14 (UD3): one text per query, hits in rank order joined by a blank line.

    Each hit reads ``[TYPE] <first 150 chars>... (Score: 0.000, Importance: 0.00)``.
    The per-query list is bounded by ``limit``.
    """
    line = F.format_string("[%s] %s... (Score: %.3f, Importance: %.2f)", F.upper("memory_type"),
                           F.substring("content", 1, 150), F.col("similarity"), F.col("importance"))
    per = results.select("query_id", "rank", line.alias("line"))
    agg = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("_l"))
    return agg.select("query_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n\n").alias("text"),
                      F.size("_l").alias("n_hits"))
