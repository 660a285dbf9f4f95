"""Structured Streaming jobs.

* ST1 message roll-up: landed agent events -> messages -> running count and
  length per conversation (stateful aggregation in update mode, state in the
  checkpoint).
* ST2/ST3 sync: landed change files -> keyed upsert into the published table,
  continuous (processing-time trigger) or triggered (availableNow); the newest
  row per key by an order column wins, whatever order rows arrive in.
* ST4 snapshot: the change log folded into a new base behind an atomic pointer.
* ST6 maintenance gate: per-thread gate evaluated on each micro-batch, on a store
  bucketed by thread of which only touched buckets are rewritten.

Keyed sinks are change logs (:mod:`memoria.streaming.changelog`): a micro-batch
writes only its own rows, so write cost is O(batch), not O(table).

All state and output paths live under the shared ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit, seconds_between
from ..session import ensure_checkpoint_dir
from . import changelog
from .changelog import read_latest


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "runs", f"{name}-{uuid.uuid4().hex[:12]}")


def land(df: DataFrame, path: str) -> str:
    """Write ``df``, in its own partitions, as parquet files into a landing folder (the stream's source)."""
    df.write.mode("error").parquet(path)
    return path


def _source(spark: SparkSession, landing: str, schema, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(landing)


def _finish(query, trigger: dict) -> None:
    if trigger.get("availableNow"):
        query.awaitTermination()
    else:
        query.processAllAvailable()
        query.stop()


# ------------------------------------------------------------ ST1
def message_rollup(events: DataFrame) -> DataFrame:
    """Flatten events carrying a message array and roll up per conversation."""
    msgs = events.select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.*")
    return msgs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"),
                                       F.sum(F.length("text")).cast("long").alias("conversation_length"))


def stream_messages(spark: SparkSession, landing: str, out: str, checkpoint: str, schema,
                    max_files_per_trigger: int | None = None) -> None:
    """ST1: run the roll-up over everything landed (availableNow). Update mode:
    each micro-batch emits only the conversations it changed, appended to the
    change log; ``read_latest(out, "conv_id", ...)`` is the current table."""
    def sink(batch: DataFrame, epoch: int):
        changelog.append(batch, out, epoch, "conv_id")

    trigger = {"availableNow": True}
    rolled = message_rollup(_source(spark, landing, schema, max_files_per_trigger))
    _finish(rolled.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start(), trigger)


# ------------------------------------------------------------ ST2 / ST3 / ST4
def sync_stream(spark: SparkSession, base: DataFrame, landing: str, out: str, checkpoint: str, key,
                schema, trigger: dict, max_files_per_trigger: int | None = None, order: str | None = None,
                deleted: Column | None = None) -> None:
    """ST2 (processingTime) / ST3 (availableNow): upsert every micro-batch into the table.

    The base becomes the table's first version; every micro-batch is appended to
    the change log. ``published(spark, out, key, schema)`` reads the table:
    the row with the largest ``order`` per key; of equals (all, without
    ``order``) the later epoch, a source row winning over the base (SET4). Rows
    for which ``deleted`` holds remove their key.
    """
    changelog.start(base, out, order)

    def upsert(batch: DataFrame, epoch: int):
        changelog.append(batch, out, epoch, key, order, deleted)

    _finish(_source(spark, landing, schema, max_files_per_trigger).writeStream.foreachBatch(upsert)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start(), trigger)


def published(spark: SparkSession, out: str, key, schema) -> DataFrame:
    """The table a sync stream publishes: base plus change log, newest row per key."""
    return read_latest(spark, out, key, schema)


def sync_snapshot(spark: SparkSession, out: str, key, schema) -> DataFrame:
    """ST4: fold the change log into a new base, then read the table from it."""
    changelog.compact(spark, out, key)
    return published(spark, out, key, schema)


# ------------------------------------------------------------ ST6
GATE_SECONDS = 3600
GATE_FILL = 0.9


def maintenance_gate(state: DataFrame, max_memories: int, as_of=None) -> DataFrame:
    """ST6: run maintenance when more than an hour passed (total seconds, days included)
    since the last run, or the memory count exceeds 0.9 * max_memories."""
    since = seconds_between(as_of_lit(as_of), F.col("last_maintenance"))
    return state.withColumn("seconds_since", since).withColumn(
        "run_maintenance", (F.col("seconds_since") > GATE_SECONDS) | (F.col("memory_count") > F.lit(GATE_FILL * max_memories)))


# ------------------------------------------------------------ the maintained store
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("thread_id"), F.lit(buckets)).cast("int")


def _state_path(out: str, epoch: int) -> str:
    return os.path.join(out, "states", f"epoch={epoch:012d}")


def store_state(spark: SparkSession, out: str, epoch: int) -> dict:
    """What the store is before micro-batch ``epoch``: {"as_of", "buckets": {bucket: epoch that wrote it}}.

    Only the first micro-batch starts without one; later, a missing state is an
    error and not an empty store.
    """
    path = _state_path(out, epoch)
    if changelog.exists(spark, path):
        return changelog.read_json(spark, path)
    if epoch == 0:
        return {"as_of": None, "buckets": {}}
    raise FileNotFoundError(f"the store lost its state before micro-batch {epoch}: {path}")


def _read_buckets(spark: SparkSession, out: str, table: str, state: dict, schema, only=None) -> DataFrame:
    """Rows of ``table`` in the buckets of a state (``only`` some of them)."""
    paths = [os.path.join(out, table, f"epoch={e:012d}", f"_bucket={b}") for b, e in state["buckets"].items()
             if only is None or int(b) in only]
    # a bucket that lost all its rows has no folder; the epoch's mark says that it was written
    for e in {e for b, e in state["buckets"].items() if only is None or int(b) in only}:
        if not changelog.exists(spark, os.path.join(out, table, f"epoch={e:012d}", "_SUCCESS")):
            raise FileNotFoundError(f"the store lost version {e} of {table}")
    paths = [p for p in paths if changelog.exists(spark, p)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, out: str, schema, epoch: int | None = None) -> DataFrame:
    """The maintained store after the newest micro-batch, or before micro-batch ``epoch``."""
    if epoch is None:
        found = [n for n in changelog.names(spark, os.path.join(out, "states")) if n.startswith("epoch=")]
        if not found:
            return spark.createDataFrame([], schema)
        epoch = int(found[-1].split("=")[1])
    return _read_buckets(spark, out, "store", store_state(spark, out, epoch), schema)


def maintenance_step(spark: SparkSession, batch: DataFrame, epoch: int, out: str, schema, max_memories: int,
                     as_of_col: str = "created_at", buckets: int = BUCKETS, all_threads: bool = False) -> None:
    """One micro-batch: append the new experiences and maintain (CMP4) the threads whose gate opens.

    Only the buckets that the batch touches are read and written again, all of
    them with ``all_threads`` (an hourly sweep); the state of the next
    micro-batch names, for every bucket, the epoch that wrote it last, and is
    written once, after the data.
    """
    from ..operators.summaries import maintenance
    from ..session import written

    state = store_state(spark, out, epoch)
    cols = [f.name for f in schema.fields]
    gate_schema = "thread_id long, last_maintenance timestamp_ntz"
    new = written(batch.select(*cols).withColumn("_bucket", _bucket(buckets)), "arrived")
    # at most ``buckets`` numbers and one time
    got = new.agg(F.collect_set("_bucket").alias("b"), F.max(as_of_col).cast("string").alias("t")).first()
    touched = set(got["b"]) | ({int(b) for b in state["buckets"]} if all_threads else set())
    as_of = max(t for t in (state["as_of"], got["t"], "") if t is not None) or None
    if touched:
        store = _read_buckets(spark, out, "store", state, schema, touched).unionByName(new.drop("_bucket"))
        last = _read_buckets(spark, out, "gate", state, gate_schema, touched)
        now = as_of_lit(as_of)
        counted = store.groupBy("thread_id").agg(F.count(F.lit(1)).alias("memory_count"),
                                                 F.min(as_of_col).alias("_first")) \
            .join(last, "thread_id", "left") \
            .withColumn("last_maintenance", F.coalesce("last_maintenance", "_first")).drop("_first")
        gate = written(maintenance_gate(counted, max_memories, as_of).select(
            "thread_id", "last_maintenance", "run_maintenance"), "gate")
        due = gate.where("run_maintenance").select("thread_id")
        done = maintenance(store.join(due, "thread_id", "left_semi"), max_memories, as_of).select(*cols)
        after = store.join(due, "thread_id", "left_anti").unionByName(done)
        times = gate.select("thread_id", F.when(F.col("run_maintenance"), now)
                            .otherwise(F.col("last_maintenance")).alias("last_maintenance"))
        for table, rows in (("store", after), ("gate", times)):
            rows.withColumn("_bucket", _bucket(buckets)).write.mode("overwrite").partitionBy("_bucket").parquet(
                os.path.join(out, table, f"epoch={epoch:012d}"))
    following = _state_path(out, epoch + 1)
    if changelog.exists(spark, following):   # a retried micro-batch
        changelog.remove(spark, following)
    changelog.write_once(spark, following, {
        "as_of": as_of, "buckets": {**state["buckets"], **{str(b): epoch for b in sorted(touched)}}})


def maintenance_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, schema,
                       max_memories: int, trigger: dict | None = None, as_of_col: str = "created_at",
                       buckets: int = BUCKETS, max_files_per_trigger: int | None = None) -> None:
    """ST6 as a stream: :func:`maintenance_step` on every micro-batch.

    ``as_of`` of a batch is the latest ``created_at`` seen so far. In production
    the trigger is ``processingTime="1 hour"``. A thread's gate is looked at when
    its bucket is touched.
    """
    trigger = trigger or {"availableNow": True}

    def step(batch: DataFrame, epoch: int):
        maintenance_step(spark, batch, epoch, out, schema, max_memories, as_of_col, buckets)

    _finish(_source(spark, landing, schema, max_files_per_trigger).writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start(), trigger)
