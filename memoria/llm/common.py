"""Helpers shared by the corpus operators.

``WS`` is the word separator of every operator here: the six ASCII characters
``\\x20 \\x09-\\x0D``. Words are maximal runs of anything else.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

WS = " \t\n\x0b\f\r"
WS_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

# A side with at most this many rows of a few hundred bytes may be broadcast.
BROADCAST_ROWS = 50_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"llm-{tag}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with a table that survives lost executors. The shuffle
    files behind the table are of no further use and are dropped with the write.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``limit`` rows, else unchanged (shuffle join)."""
    return F.broadcast(df) if df.count() <= limit else df


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column) -> Column:
    """Array of words of a non-null text (empty array if it has none)."""
    body = F.btrim(c, F.lit(WS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS_RE))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_RE)).cast("long")


def doc_key() -> list[Column]:
    """A total order key for documents: ``doc_id`` with nulls as the smallest value."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(2 ** 63)))]


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                tag: str = "ranged") -> DataFrame:
    """Exact running sum of ``value`` within ``keys`` by ``order``, also for keys of any size.

    The rows are range-partitioned by (keys, order), so a hot key is spread over
    many ranges; sums run inside (key, range) groups and the offsets come from
    the per-range totals, at most one row per key and range. All joins are
    null-safe. Rows that tie in ``order`` must be interchangeable.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in [*keys, *order]]
    ranged = materialize(df.repartitionByRange(n, *cols).withColumn("_range", F.spark_partition_id()), tag)
    per = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value).over(own))
    match = F.col("_range") == F.col("_k_range")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (local.join(offsets, match)
            .withColumn(out, F.col("_local") + F.col("_offset"))
            .drop("_local", "_offset", "_range", "_k_range", *[f"_k_{k}" for k in keys]))
