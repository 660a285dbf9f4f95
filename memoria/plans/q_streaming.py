"""Streaming queries: each runs the stream to completion on data landed from the
base tables, then returns the sink table."""
from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sources import derived as d
from ..sources.tables import Tables
from ..streaming import jobs
from .catalog import query

ORDER_KEY = "o_orderkey"


@query("stream_messages")
def q_stream_messages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = d.classified_conversations(t)
    # one event per (conversation, turn) carrying its message list, as an agent stream emits them
    events = c.select("conv_id", F.array(F.struct("turn", "role", "text")).alias("messages"))
    run = jobs.run_folder(spark, "stream_messages")
    landing = jobs.land(events, os.path.join(run, "landing"))
    out = os.path.join(run, "out")
    jobs.stream_messages(spark, landing, out, os.path.join(run, "checkpoint"), events.schema)
    return jobs.read_latest(spark, out, "conv_id", "conv_id long, message_count long, conversation_length long")


def _sync(spark, sf_dir, trigger, triggered_runs: bool):
    """Changes of three arrivals, repeated and out of order, on top of the base; newest order wins."""
    t = Tables(spark, sf_dir)
    base = d.orders_old(t).withColumn("change_seq", F.lit(-1).cast("long"))
    changes = d.order_changes(t)
    schema = changes.drop("arrival").schema
    run = jobs.run_folder(spark, "sync")
    landing, out = os.path.join(run, "landing"), os.path.join(run, "out")

    def go():
        jobs.sync_stream(spark, base, os.path.join(landing, "*"), out, os.path.join(run, "checkpoint"), ORDER_KEY, schema,
                         trigger, order="change_seq", deleted=F.col("gone"))
    arrivals = [changes.where(F.col("arrival") == a).drop("arrival") for a in range(3)]
    for a, rows in enumerate(arrivals):
        jobs.land(rows, os.path.join(landing, f"arrival-{a}"))
        if triggered_runs:   # one run per arrival, each going on where the last one ended
            go()
    if not triggered_runs:
        go()
    return out, d.orders_old(t).schema


@query("sync_triggered")
def q_sync_triggered(spark, sf_dir):
    out, schema = _sync(spark, sf_dir, {"availableNow": True}, True)
    return jobs.published(spark, out, ORDER_KEY, schema)


@query("sync_continuous")
def q_sync_continuous(spark, sf_dir):
    out, schema = _sync(spark, sf_dir, {"processingTime": "1 second"}, False)
    return jobs.published(spark, out, ORDER_KEY, schema)


@query("sync_snapshot")
def q_sync_snapshot(spark, sf_dir):
    out, schema = _sync(spark, sf_dir, {"availableNow": True}, True)
    return jobs.sync_snapshot(spark, out, ORDER_KEY, schema)


@query("maintenance_gate")
def q_gate(spark, sf_dir):
    from .q_retention import MAX_MEMORIES
    e = d.experiences(Tables(spark, sf_dir))
    state = e.groupBy("thread_id").agg(F.count(F.lit(1)).alias("memory_count"),
                                       F.max("created_at").alias("last_maintenance"))
    g = jobs.maintenance_gate(state, MAX_MEMORIES)
    return g.select("thread_id", "memory_count", F.round("seconds_since", 6).alias("seconds_since"), "run_maintenance")


@query("store_ttl_stream")
def q_store_ttl_stream(spark, sf_dir):
    from ..streaming.ttl import live_entries, store_ttl_stream
    entries = d.store_entries(Tables(spark, sf_dir)).select("prefix", "key", "value", "created_at", "ttl_minutes")
    run = jobs.run_folder(spark, "store_ttl")
    landing = jobs.land(entries, os.path.join(run, "landing"))
    out = os.path.join(run, "out")
    store_ttl_stream(spark, landing, out, os.path.join(run, "checkpoint"), entries.schema)
    return live_entries(spark, out, entries.schema).select("prefix", "key", "expires_at")
