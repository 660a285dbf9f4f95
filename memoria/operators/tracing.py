"""Agent checkpoints, key/value store and multi-agent observability roll-ups.

Joins follow the keys of the checkpoint tables ((thread, namespace, id),
(thread, namespace, channel, version)) and the orchestration id of the
observability tables. Each child table is aggregated per orchestration before
it is joined, so no fan-out rows are built.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonfn import parse_python_literal
from ..functions.timefn import as_of_lit, seconds_between

CKPT_KEYS = ["thread_id", "checkpoint_ns"]
# a trace closure goes this many levels one by one, then distances double
LEVELS = 8
# a list of traces with at most this many rows may be broadcast
BROADCAST_ROWS = 50_000
METADATA_T = T.StructType([T.StructField("source", T.StringType()), T.StructField("step", T.LongType()),
                           T.StructField("writes", T.StringType())])


def with_metadata(checkpoints: DataFrame) -> DataFrame:
    """Parse the Python-style metadata text into (source, step)."""
    m = parse_python_literal(F.col("metadata"), METADATA_T)
    return checkpoints.withColumn("source", m["source"]).withColumn("step", m["step"])


def checkpoint_parent(checkpoints: DataFrame) -> DataFrame:
    """JN8 (+ WN5): each checkpoint with its parent in the same thread and namespace,
    step of both and the seconds between them. Roots keep null parent columns.

    The parent pointer is the previous checkpoint of the chain, so the gap is an
    equi-join on (thread, namespace, id) -- no per-thread window is needed.
    """
    c = with_metadata(checkpoints)
    p = c.select(*CKPT_KEYS, F.col("checkpoint_id").alias("parent_checkpoint_id"),
                 F.col("step").alias("parent_step"), F.col("ts").alias("parent_ts"))
    j = c.join(p, CKPT_KEYS + ["parent_checkpoint_id"], "left")
    return j.select(*CKPT_KEYS, "checkpoint_id", "parent_checkpoint_id", "step", "parent_step", "source",
                    seconds_between(F.col("ts"), F.col("parent_ts")).alias("gap_seconds"))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """WN4: newest checkpoint per (thread, namespace); ids sort in time order.

    ``max`` over a struct led by the id is a partial aggregate: a thread with
    many checkpoints is reduced map-side.
    """
    c = with_metadata(checkpoints)
    best = F.max(F.struct("checkpoint_id", "step", "ts")).alias("_m")
    return c.groupBy(*CKPT_KEYS).agg(best).select(*CKPT_KEYS, F.col("_m.checkpoint_id").alias("checkpoint_id"),
                                                 F.col("_m.step").alias("step"), F.col("_m.ts").alias("ts"))


def checkpoint_writes_join(checkpoints: DataFrame, writes: DataFrame) -> DataFrame:
    """JN9: checkpoints with their pending writes (1:N) on the three key columns."""
    c = with_metadata(checkpoints).select(*CKPT_KEYS, "checkpoint_id", "step", "source")
    return c.join(writes.select(*CKPT_KEYS, "checkpoint_id", "task_id", "idx", "channel"),
                  CKPT_KEYS + ["checkpoint_id"], "inner")


def thread_activity(checkpoints: DataFrame) -> DataFrame:
    """AG20: per thread: checkpoints, step range, first/last time, count by source."""
    c = with_metadata(checkpoints)
    return c.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("checkpoints"), F.min("step").alias("min_step"), F.max("step").alias("max_step"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("source") == "input").alias("input_steps"),
        F.count_if(F.col("source") == "loop").alias("loop_steps"),
    ).withColumn("duration_seconds", seconds_between(F.col("last_ts"), F.col("first_ts")))


def channel_activity(writes: DataFrame, blobs: DataFrame) -> DataFrame:
    """AG21: per thread and channel: writes, blobs and the latest (zero-padded) version."""
    w = writes.groupBy("thread_id", "channel").agg(F.count(F.lit(1)).alias("writes"))
    b = blobs.groupBy("thread_id", "channel").agg(F.count(F.lit(1)).alias("blobs"),
                                                  F.max("version").alias("latest_version"))
    return w.join(b, ["thread_id", "channel"], "full_outer").select(
        "thread_id", "channel", F.coalesce("writes", F.lit(0)).alias("writes"),
        F.coalesce("blobs", F.lit(0)).alias("blobs"), "latest_version")


def prefix_scan(store: DataFrame, prefix: str) -> DataFrame:
    """SRC8: namespace scan; ``startswith`` is pushed to parquet as StringStartsWith."""
    return store.where(F.col("prefix").startswith(prefix))


def store_expiry(store: DataFrame) -> DataFrame:
    """expires_at = created_at + ttl_minutes (null when there is no TTL)."""
    exp = F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("ttl_minutes"))
    return store.withColumn("expires_at", F.when(F.col("ttl_minutes").isNotNull(), exp))


def store_ttl(store: DataFrame, as_of=None) -> DataFrame:
    """ST5 (batch): entries alive at ``as_of``; no TTL means no expiry."""
    out = store_expiry(store)
    return out.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of_lit(as_of)))


VALUE_T = T.StructType([T.StructField("content", T.StructType([
    T.StructField("k", T.LongType()), T.StructField("note", T.StringType()), T.StructField("kind", T.StringType())]))])


def store_values(store: DataFrame) -> DataFrame:
    """SC17 on the store: parse Python-style values."""
    v = parse_python_literal(F.col("value"), VALUE_T)
    return store.select("prefix", "key", v["content"]["k"].alias("k"), v["content"]["kind"].alias("kind"),
                        v["content"]["note"].isNull().alias("note_is_null"))


# ------------------------------------------------------------ observability
def message_latency(messages: DataFrame) -> DataFrame:
    """AG17: per sender, receiver and type. Latency = stored latency_ms, else delivered - sent."""
    lat = F.coalesce(F.col("latency_ms").cast("double"),
                     seconds_between(F.col("delivered_at"), F.col("sent_at")) * F.lit(1000.0))
    return messages.groupBy("sender_agent_id", "receiver_agent_id", "message_type").agg(
        F.count(F.lit(1)).alias("messages"), F.avg(lat).alias("avg_latency_ms"), F.max(lat).alias("max_latency_ms"),
        F.sum("payload_bytes").cast("long").alias("total_bytes"),
        F.count_if(F.col("delivered_at").isNull()).alias("undelivered"))


def orchestration_cost(metrics: DataFrame, by: str = "agent_id") -> DataFrame:
    """AG16: per agent (or orchestration): cpu, tokens, cost (decimal), errors."""
    return metrics.groupBy(by).agg(
        F.sum("cpu_ms").alias("cpu_ms"), F.sum("tokens_in").cast("long").alias("tokens_in"),
        F.sum("tokens_out").cast("long").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"),
        F.sum("error_count").cast("long").alias("errors"))


def memory_access_audit(log: DataFrame) -> DataFrame:
    """AG18: per access type: accesses, lock wait, mean duration, conflicts."""
    return log.groupBy("access_type").agg(
        F.count(F.lit(1)).alias("accesses"), F.sum("lock_wait_ms").cast("long").alias("lock_wait_ms"),
        F.avg("duration_ms").alias("avg_duration_ms"), F.count_if("conflict_detected").alias("conflicts"))


def coordination_events(events: DataFrame) -> DataFrame:
    """AG19: per coordination type: events, success rate, mean latency, max anomaly score."""
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.max("anomaly_score").alias("max_anomaly_score"))


def orchestration_join(orch: DataFrame, nodes: DataFrame, metrics: DataFrame, messages: DataFrame,
                       events: DataFrame, trace_map: DataFrame) -> DataFrame:
    """JN10: orchestration with per-child aggregates (1:N children pre-aggregated, then left joins) and its trace map."""
    k = "orchestration_id"
    n = nodes.groupBy(k).agg(F.count(F.lit(1)).alias("nodes"))
    m = metrics.groupBy(k).agg(F.sum("tokens_in").cast("long").alias("tokens_in"), F.sum("cost_usd").alias("cost_usd"))
    g = messages.groupBy(k).agg(F.count(F.lit(1)).alias("messages"))
    c = events.groupBy(k).agg(F.count(F.lit(1)).alias("coordination_events"),
                              F.count_if(~F.col("success")).alias("failed_events"),
                              F.max("anomaly_score").alias("max_anomaly_score"))
    # one map per orchestration; of several the one with the smallest correlation id
    t = trace_map.where(F.col(k).isNotNull()).groupBy(k).agg(
        F.min(F.struct("correlation_id", "root_trace_id")).alias("_t"))
    j = orch.join(n, k, "left").join(m, k, "left").join(g, k, "left").join(c, k, "left").join(t, k, "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return j.select(k, "status", "workflow_id", zero("nodes"), zero("tokens_in"), "cost_usd", zero("messages"),
                    zero("coordination_events"), zero("failed_events"), "max_anomaly_score",
                    F.col("_t.correlation_id").alias("correlation_id"), F.col("_t.root_trace_id").alias("root_trace_id"))


def trace_closure(trace_map: DataFrame) -> DataFrame:
    """(root_trace_id, trace_id, depth): every trace that a mapped root reaches, itself (depth 0) included.

    Child traces may be roots of maps of their own, to any depth. Each round goes
    on from the traces reached last that are roots themselves, ``LEVELS`` rounds
    by one level, then by all that is reached, so distances double; depth is the
    least one. A trace with one parent is reached from a root in one way and needs
    no comparison; others are compared with those reached before. Cycles add
    nothing new and end.
    """
    from ..session import written
    pair = ["root_trace_id", "trace_id"]
    root = F.col("root_trace_id")
    listed = F.coalesce(F.from_json("child_trace_ids", T.ArrayType(T.StringType())), F.array().cast("array<string>"))
    maps = trace_map.where("root_trace_id is not null").select(
        root, F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != root))).alias("_children"))
    # one row per trace named; kind is 0 for a child, 1 for a root, 2 for a root with children
    own = F.struct(root.alias("trace_id"), F.lit(None).cast("string").alias("parent"),
                   F.when(F.size("_children") > 0, 2).otherwise(1).alias("kind"))
    below = F.transform("_children", lambda x: F.struct(x.alias("trace_id"), root.alias("parent"), F.lit(0).alias("kind")))
    named = maps.select(F.inline(F.concat(F.array(own), below)))
    nodes = written(named.repartition("trace_id").groupBy("trace_id").agg(
        F.min("parent").alias("root_trace_id"), F.max("kind").alias("kind"),
        F.coalesce(F.min("parent") != F.max("parent"), F.lit(False)).alias("many")), "nodes")
    roots = nodes.where("kind > 0").select(F.col("trace_id").alias("root_trace_id"), "trace_id", F.lit(0).cast("long").alias("depth"))
    columns = [*pair, F.lit(1).cast("long").alias("depth"), (F.col("kind") == 2).alias("leads"), "many"]
    edges = nodes.where("root_trace_id is not null and not many").select(*columns)
    several = nodes.where("many").drop("root_trace_id")
    n = several.count()
    if n:
        parents = maps.select(root, F.explode("_children").alias("trace_id"))
        shared = parents.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "trace_id").select(*columns)
        edges = edges.unionByName(written(shared.distinct(), "edges"))
    found, last, depth = [edges], edges, 1
    while True:
        front = last.where("leads").where(F.col("depth") == depth)
        if front.isEmpty():
            break
        reached = reduce(DataFrame.unionByName, found)
        one = depth < LEVELS
        # packed files look small to the planner, so the join is named
        further = (edges.drop("depth") if one else reached).withColumnRenamed("root_trace_id", "_via").hint("merge")
        more = F.lit(1) if one else F.col("depth")
        last = front.select("root_trace_id", F.col("trace_id").alias("_via")).join(further, "_via").where(
            "root_trace_id != trace_id").select(*pair, (more + depth).cast("long").alias("depth"), "leads", "many")
        if n or not one:
            last = written(last, "steps")
            sure = F.lit(one) & ~F.col("many")
            least = last.where(~sure).groupBy(*pair).agg(
                F.min("depth").alias("depth"), F.bool_or("leads").alias("leads"), F.bool_or("many").alias("many"))
            last = last.where(sure).unionByName(least.join(reached.where(~sure).select(*pair), pair, "left_anti"))
        last = written(last, "traces")
        found.append(last)
        depth += 1 if one else depth
    return roots.unionByName(reduce(DataFrame.unionByName, found).select(*pair, "depth"))


def trace_records(nodes: DataFrame, messages: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """(trace_id, kind, value, at) of the four kinds of records that name a trace.

    ``events`` name it inside their ``trace_context`` JSON.
    """
    value = lambda c: F.col(c).cast("double").alias("value")
    parts = [
        nodes.select("trace_id", F.lit("node").alias("kind"), value("tokens_in"), F.lit(None).cast("timestamp_ntz").alias("at")),
        messages.select("trace_id", F.lit("message").alias("kind"), value("payload_bytes"), F.col("sent_at").alias("at")),
        events.select(F.get_json_object("trace_context", "$.trace_id").alias("trace_id"), F.lit("event").alias("kind"),
                      value("anomaly_score"), F.col("occurred_at").alias("at")),
        spans.select("trace_id", F.lit("span").alias("kind"), value("quantity"), F.col("span_ts").alias("at"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("trace_id is not null")


def trace_stitch(trace_map: DataFrame, records: DataFrame) -> DataFrame:
    """JN11: correlation id -> root trace -> child traces of any depth -> their records.

    Records meet traces before correlation ids, which then join on the root only
    the traces that have records.
    """
    found = trace_closure(trace_map).join(records, "trace_id")
    maps = trace_map.select("correlation_id", "root_trace_id").where("root_trace_id is not null")
    # dealt by the root before repeats are dropped: the join needs no second shuffle
    maps = maps.repartition("root_trace_id").distinct()
    rest = [c for c in found.columns if c not in ("trace_id", "root_trace_id")]
    return found.join(maps, "root_trace_id").select("trace_id", "root_trace_id", "correlation_id", *rest)
