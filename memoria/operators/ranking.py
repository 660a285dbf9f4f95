"""Exact per-group row numbers that stay balanced when one group is huge.

``row_number().over(partitionBy(key))`` sends a whole key group to one task; if
one key holds a third of all rows, that task sorts a third of the data. For
small top-k cuts Spark's ``WindowGroupLimit`` already prunes map-side (use
:func:`top_k`). For unbounded ranks (quotas) :func:`group_row_number` works on
ranges of (key, order):

1. :func:`range_layout` range-partitions on (key, order) -- Spark samples the
   sort keys, so a hot key is split over many ranges -- keeps the range number
   as a column and checkpoints to the shared checkpoint folder;
2. rows are numbered inside each (key, range) by a native window;
3. the rows of the earlier ranges of the same key, one count per (key, range),
   are added through a null-safe join.

There is one path for every size; null keys form a group like any other.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order_cols(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_k(df: DataFrame, keys, order, k: int, out: str = "rn") -> DataFrame:
    """Rows with row_number <= k per key (map-side pruned by WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def range_layout(df: DataFrame, keys, order, num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``_range``: contiguous ranges of (keys, order), as a checkpointed table."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(k).asc_nulls_first() for k in keys] + _order_cols(order)
    return df.repartitionByRange(n, *ordered).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)


def join_ranges(rows: DataFrame, per_range: DataFrame, keys) -> DataFrame:
    """Left join on (keys, ``_range``), null keys matching each other."""
    other = per_range.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
                             *[c for c in per_range.columns if c not in (*keys, "_range")])
    match = F.col("_range") == F.col("_k_range")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(other, match, "left").drop("_k_range", *[f"_k_{k}" for k in keys])


def group_row_number(df: DataFrame, keys, order, out: str = "rank",
                     num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based row_number within ``keys`` by ``order``, skew-safe and null-safe."""
    keys = list(keys)
    s = range_layout(df, keys, order, num_partitions)
    local = s.withColumn("_lpos", F.row_number().over(
        Window.partitionBy(*keys, "_range").orderBy(*_order_cols(order))).cast("long"))
    per = s.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, "_range", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    j = join_ranges(local, offsets, keys)
    return j.withColumn(out, F.col("_lpos") + F.coalesce(F.col("_off"), F.lit(0))).drop("_lpos", "_range", "_off")
