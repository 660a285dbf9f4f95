"""ST5: key/value store entries with a per-entry time to live, fed by a stream.

The entries are a keyed table with a change log (:mod:`memoria.streaming.changelog`)
ordered by ``created_at``: the newest value of a (prefix, key) replaces the older
ones, however late these arrive. An entry expires ``ttl_minutes`` after its
creation; expiry is decided on read, at the latest creation time the table has
seen or at a given time, so no state is held per key and a replayed stream gives
the same table. :func:`sweep` removes expired entries for good.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit, epoch_millis, from_epoch_millis
from . import changelog

KEY = ["prefix", "key"]


def expires_at() -> Column:
    """Millisecond time at which an entry ends; null if it never does."""
    return from_epoch_millis(epoch_millis(F.col("created_at")) + F.col("ttl_minutes").cast("long") * 60_000)


def store_ttl_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, schema,
                     max_files_per_trigger: int | None = None) -> None:
    """Append everything landed (availableNow) to the entries' log."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def sink(batch: DataFrame, epoch: int):
        changelog.append(batch, out, epoch, KEY, order="created_at")

    reader.parquet(landing).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()


def _now(entries: DataFrame, as_of) -> Column:
    if as_of is not None:
        return as_of_lit(as_of)
    latest = entries.agg(F.max("created_at").alias("t"))
    return from_epoch_millis(epoch_millis(latest.select("t").scalar()))


def live_entries(spark: SparkSession, out: str, schema, as_of=None) -> DataFrame:
    """Newest entry per (prefix, key) that has not expired, with ``expires_at``."""
    entries = changelog.read_latest(spark, out, KEY, schema).withColumn("expires_at", expires_at())
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > _now(entries, as_of)))


def sweep(spark: SparkSession, out: str, as_of) -> int:
    """Fold the log and drop the entries expired at ``as_of``; their time does not come back."""
    return changelog.compact(spark, out, KEY, drop=expires_at() <= as_of_lit(as_of))
