"""Queries over checkpoints, the key/value store and observability tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracing as tr
from ..sources import derived as d
from ..sources.tables import Tables
from .catalog import query


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


@query("checkpoint_parent")
def q_parent(spark, sf_dir):
    r = tr.checkpoint_parent(d.checkpoints_in(_t(spark, sf_dir)))
    return r.withColumn("gap_seconds", F.round("gap_seconds", 6))


@query("step_gap")
def q_step_gap(spark, sf_dir):
    r = tr.checkpoint_parent(d.checkpoints_in(_t(spark, sf_dir)))
    return r.where(F.col("parent_step").isNotNull()).select("thread_id", "step", F.round("gap_seconds", 6).alias("gap_seconds"))


@query("latest_checkpoint")
def q_latest(spark, sf_dir):
    return tr.latest_checkpoint(d.checkpoints_in(_t(spark, sf_dir)))


@query("checkpoint_writes_join")
def q_writes_join(spark, sf_dir):
    t = _t(spark, sf_dir)
    return tr.checkpoint_writes_join(d.checkpoints_in(t), d.checkpoint_writes(t))


@query("thread_activity")
def q_thread_activity(spark, sf_dir):
    r = tr.thread_activity(d.checkpoints_in(_t(spark, sf_dir)))
    return r.withColumn("duration_seconds", F.round("duration_seconds", 6))


@query("channel_activity")
def q_channel_activity(spark, sf_dir):
    w = d.checkpoint_writes(_t(spark, sf_dir))
    blobs = w.select("thread_id", "checkpoint_ns", "channel", "version").distinct()
    return tr.channel_activity(w, blobs)


@query("store_prefix_scan")
def q_prefix(spark, sf_dir):
    s = tr.prefix_scan(d.store_entries(_t(spark, sf_dir)), "episodes.")
    return s.groupBy("prefix").agg(F.count(F.lit(1)).alias("entries"))


@query("store_ttl")
def q_store_ttl(spark, sf_dir):
    return tr.store_ttl(d.store_entries(_t(spark, sf_dir))).select("prefix", "key", "expires_at")


@query("store_values")
def q_store_values(spark, sf_dir):
    return tr.store_values(d.store_entries(_t(spark, sf_dir)))


@query("message_latency")
def q_latency(spark, sf_dir):
    r = tr.message_latency(d.agent_messages(_t(spark, sf_dir)))
    return r.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6)).withColumn("max_latency_ms", F.round("max_latency_ms", 6))


@query("orchestration_cost")
def q_cost(spark, sf_dir):
    r = tr.orchestration_cost(d.agent_metrics(_t(spark, sf_dir)))
    return r.withColumn("cpu_ms", F.round("cpu_ms", 6)).withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 6))


@query("memory_access_audit")
def q_audit(spark, sf_dir):
    r = tr.memory_access_audit(d.access_log(_t(spark, sf_dir)))
    return r.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("coordination_events")
def q_coord(spark, sf_dir):
    r = tr.coordination_events(d.coordination(_t(spark, sf_dir)))
    return r.withColumn("success_rate", F.round("success_rate", 6)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("orchestration_join")
def q_orch(spark, sf_dir):
    t = _t(spark, sf_dir)
    r = tr.orchestration_join(d.orchestrations(t), d.execution_nodes(t), d.agent_metrics(t), d.agent_messages(t),
                              d.coordination(t), d.trace_map(t))
    return r.withColumn("cost_usd", F.round(F.col("cost_usd").cast("double"), 6))


@query("trace_closure")
def q_trace_closure(spark, sf_dir):
    return tr.trace_closure(d.trace_map(_t(spark, sf_dir)))


@query("trace_stitch")
def q_trace(spark, sf_dir):
    t = _t(spark, sf_dir)
    records = tr.trace_records(d.execution_nodes(t), d.agent_messages(t), d.coordination(t), d.spans(t))
    # sums by trace and kind stitch like the records; dealt by trace, they join without a second shuffle
    sums = records.repartition("trace_id").groupBy("trace_id", "kind").agg(
        F.count(F.lit(1)).alias("records"), F.sum("value").alias("value"))
    r = tr.trace_stitch(d.trace_map(t), sums)
    return r.groupBy("correlation_id", "root_trace_id", "kind").agg(
        F.sum("records").alias("records"), F.round(F.sum("value"), 6).alias("value"), F.max("depth").alias("max_depth"))


@query("point_in_time")
def q_pit(spark, sf_dir):
    from ..operators.asof import asof_join
    t = _t(spark, sf_dir)
    return asof_join(d.pit_labels(t), d.pit_features(t), "user_id", "label_ts", "feature_ts", tiebreak="feature_id")
