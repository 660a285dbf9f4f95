"""Operator inputs derived from the base tables (FIXTURES.md part 3).

Every input is computed by Spark from the given tables, so its size grows with
them. The same inputs are written independently in DuckDB SQL for the oracle
(``memoria.plans.oracle``); the two must agree row for row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit, plus_days
from ..operators.memory import expiry_rule, persistence_rule
from ..functions.textfn import summary_or_truncate
from .tables import Tables

# --- fixed values of the fixtures ------------------------------------------
# event_type -> memory_type of the memory store
EVENT_TO_MEMORY_TYPE = {"click": "conversation", "view": "scratch", "purchase": "fact",
                        "signup": "user_preference", "error": "observation"}
# event_type -> memory_type of the experience store
EVENT_TO_EXPERIENCE_TYPE = {"signup": "preference", "purchase": "fact", "click": "interaction",
                            "view": "skill", "error": "error"}
# doc_id % 6 -> memory_type of a memory request
REQUEST_TYPES = ("fact", "conversation", "scratch", "plan", "observation", "reflection")
# conv_id % 5 -> suffix appended to conversation text
CONVERSATION_SUFFIXES = (" remember this", " It FAILED", " tutorial", " unlikely", "")
N_AGENTS = 5
# ---------------------------------------------------------------------------


def _map_values(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def _tenth(c):
    return c.cast("double") / F.lit(10.0)


def agent_of(user_id):
    return F.concat(F.lit("agent_"), (user_id % N_AGENTS).cast("string"))


def memories(t: Tables) -> DataFrame:
    e = t.events
    eid = F.col("event_id")
    mtype = _map_values(F.col("event_type"), EVENT_TO_MEMORY_TYPE)
    content = F.concat(F.col("event_type"), F.lit(" "), F.col("props"))
    base = e.select(
        eid.cast("string").alias("id"),
        eid.alias("seq"),
        agent_of(F.col("user_id")).alias("agent_id"),
        F.concat(F.lit("s_"), F.col("user_id").cast("string")).alias("session_id"),
        mtype.alias("memory_type"),
        content.alias("content"),
        _tenth(eid % 10).alias("importance"),
        _tenth(eid % 6 + 5).alias("confidence"),
        (eid % 4).cast("int").alias("access_count"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        plus_days(F.col("ts"), eid % 20).alias("last_accessed"),
        (eid % 7 == 0).alias("is_summarized"),
    )
    persist = persistence_rule(F.lit(None).cast("boolean"), F.col("memory_type"))
    return base.select(
        "*",
        summary_or_truncate(F.lit(None).cast("string"), F.col("content")).alias("summary"),
        persist.alias("is_persistent"),
        expiry_rule(persist, F.col("memory_type"), F.col("created_at")).alias("expires_at"),
        F.create_map().cast("map<string,string>").alias("meta_data"),
        F.array().cast("array<string>").alias("tags"),
    )


def deleted_ids(t: Tables) -> DataFrame:
    e = t.events.where(F.col("event_id") % 23 == 0)
    wrong = F.col("event_id") % 46 == 0
    agent = F.when(wrong, agent_of(F.col("user_id") + 1)).otherwise(agent_of(F.col("user_id")))
    return e.select(F.col("event_id").cast("string").alias("id"), agent.alias("agent_id"))


def memory_change_batch(t: Tables) -> DataFrame:
    """One action per event id: delete (%31), update importance 0.9 (%29), create id+1e6 (%37)."""
    m = memories(t)
    eid = F.col("seq")
    action = F.when(eid % 31 == 0, "delete").when(eid % 29 == 0, "update").when(eid % 37 == 0, "create")
    b = m.withColumn("action", action).where(F.col("action").isNotNull())
    return b.withColumn("id", F.when(F.col("action") == "create", (eid + 1_000_000).cast("string")).otherwise(F.col("id"))) \
        .withColumn("seq", F.when(F.col("action") == "create", eid + 1_000_000).otherwise(eid)) \
        .withColumn("importance", F.when(F.col("action") == "update", F.lit(0.9)).otherwise(F.col("importance")))


def memory_requests(t: Tables) -> DataFrame:
    d = t.documents
    did = F.col("doc_id")
    mtype = F.element_at(F.array(*[F.lit(x) for x in REQUEST_TYPES]), (did % 6 + 1).cast("int"))
    return d.select(
        did.cast("string").alias("id"),
        F.when(did % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("session_id"),
        mtype.alias("memory_type"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("summary"),
        F.array().cast("array<string>").alias("tags"),
    )


def memory_vectors(t: Tables) -> DataFrame:
    """Vector rows with the metadata the vector store keeps (agent, session, type)."""
    v = t.embeddings.select(F.col("vec_id").cast("string").alias("id"),
                            F.col("embedding").cast("array<double>").alias("vector"))
    m = memories(t).select("id", "agent_id", "session_id", "memory_type")
    return v.join(m, "id", "inner")


def query_vectors(t: Tables) -> DataFrame:
    """Every embedding is also a query, scoped to agent (vec_id % 5)."""
    return t.embeddings.select(
        F.col("vec_id").alias("query_id"),
        agent_of(F.col("vec_id")).alias("agent_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def relationships(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type")
    tgt = t.events.select((F.col("event_id") - 7).alias("event_id"), F.col("event_id").alias("target"))
    j = e.join(tgt, "event_id", "inner")
    return j.select(
        F.concat(F.lit("r_"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_id").cast("string").alias("source_id"),
        F.col("target").cast("string").alias("target_id"),
        F.col("event_type").alias("relationship_type"),
        _tenth(F.col("event_id") % 10).alias("strength"),
    )


def reflections(t: Tables) -> DataFrame:
    """One reflection per signup event (whole table)."""
    e = t.events.where(F.col("event_type") == "signup")
    return e.select(F.concat(F.lit("rf_"), F.col("event_id").cast("string")).alias("id"),
                    agent_of(F.col("user_id")).alias("agent_id"), F.col("ts").alias("created_at"))


def tasks(t: Tables) -> DataFrame:
    """One task per error event (whole table)."""
    e = t.events.where(F.col("event_type") == "error")
    return e.select(F.concat(F.lit("tk_"), F.col("event_id").cast("string")).alias("id"),
                    agent_of(F.col("user_id")).alias("agent_id"), F.col("ts").alias("created_at"))


def experiences(t: Tables, as_of=None) -> DataFrame:
    e = t.events
    eid = F.col("event_id")
    created = plus_days(F.col("ts"), -(eid % 100))
    return e.select(
        F.col("user_id").alias("thread_id"),
        eid.alias("seq"),
        F.concat(F.lit("episodes."), F.col("user_id").cast("string")).alias("prefix"),
        eid.cast("string").alias("key"),
        (eid % 4 + 1).cast("int").alias("importance"),
        _map_values(F.col("event_type"), EVENT_TO_EXPERIENCE_TYPE).alias("memory_type"),
        F.concat(F.col("event_type"), eid.cast("string")).alias("observation"),
        F.lit("derived from event").alias("reasoning"),
        F.concat(F.lit("act_"), eid.cast("string")).alias("action"),
        created.alias("created_at"),
        F.least(plus_days(created, eid % 60), as_of_lit(as_of)).alias("last_accessed"),
        (eid % 5 + 1).cast("int").alias("access_count"),
        F.lit(1.0).alias("decay_factor"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("outcome"),
        F.array(F.col("event_type")).alias("tags"),
    )


def classified_conversations(t: Tables) -> DataFrame:
    c = t.conversations
    suffix = F.element_at(F.array(*[F.lit(s) for s in CONVERSATION_SUFFIXES]), (F.col("conv_id") % 5 + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(F.col("text"), suffix).alias("text"))


def turn_pairs(t: Tables) -> DataFrame:
    """A user turn and the assistant turn right after it in the same conversation."""
    c = t.conversations
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                        F.col("text").alias("assistant_text"))
    return u.join(a, ["conv_id", "turn"], "inner")


def reflection_requests(t: Tables) -> DataFrame:
    """Topic, insights (0-3 items) and action items (0-2 items) per document."""
    d = t.documents
    did = F.col("doc_id")
    insights = F.array(F.col("lang"), F.col("source"), F.concat(F.lit("n_chars="), F.col("n_chars").cast("string")))
    actions = F.array(F.concat(F.lit("review "), F.col("lang")), F.concat(F.lit("recheck "), F.col("source")))
    return d.select(
        did.cast("string").alias("id"),
        F.col("source").alias("topic"),
        F.slice(insights, 1, (did % 4).cast("int")).alias("insights"),
        F.slice(actions, 1, (did % 3).cast("int")).alias("action_items"),
    )


# ------------------------------------------------------------ documents
DOC_MODELS = ("prebuilt-layout", "prebuilt-read", "prebuilt-invoice")
API_VERSION = "2024-02-29-preview"
CHARS_PER_PAGE = 3000


def analysis_results(t: Tables) -> DataFrame:
    d = t.documents
    did = F.col("doc_id")
    n_pages = F.ceil(F.col("n_chars") / F.lit(CHARS_PER_PAGE)).cast("int")
    pages = F.when(n_pages > 0, F.transform(F.sequence(F.lit(1), n_pages), lambda x: F.struct(x.alias("pageNumber")))) \
        .otherwise(F.array().cast("array<struct<pageNumber:int>>"))
    conf = (did % 100).cast("double") / F.lit(100.0)

    def field(v):
        return F.struct(v.cast("string").alias("content"), conf.alias("confidence"))
    fields = F.create_map(F.lit("lang"), field(F.col("lang")), F.lit("source"), field(F.col("source")),
                          F.lit("n_chars"), field(F.col("n_chars")))
    return d.select(
        did.alias("doc_id"),
        F.when(did % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit(API_VERSION)).alias("apiVersion"),
        F.element_at(F.array(*[F.lit(m) for m in DOC_MODELS]), (did % 3 + 1).cast("int")).alias("model_id"),
        F.col("text").alias("content"),
        pages.alias("pages"),
        F.array(F.struct(fields.alias("fields"))).alias("documents"),
        (did % 12).cast("int").alias("month"),
    )


# ------------------------------------------------------------ endpoint migration
GATEWAY_VALUES = (None, "", "None", "null", " ", '{"x":1}')


def endpoints(t: Tables) -> DataFrame:
    """Endpoint list as landed from the API (nested parts as JSON text) + workspace facts."""
    c = t.customer
    k = F.col("c_custkey")
    seg = F.lower(F.col("c_mktsegment"))
    prefix = F.when(k % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit('"t'), k.cast("string"), F.lit('"')))
    enabled = F.when(k % 4 == 0, F.lit(',"enabled":false')).when(k % 4 == 1, F.lit(',"enabled":null')).otherwise(F.lit(""))
    acc = F.concat(F.lit('{"catalog_name":"main","schema_name":"'), seg, F.lit('","table_name_prefix":'), prefix,
                   enabled, F.lit("}"))
    ents = F.when(k % 9 == 0, F.lit("[]")).otherwise(F.concat(
        F.lit('[{"entity_name":"model_'), k.cast("string"), F.lit('","entity_version":"'),
        F.col("c_nationkey").cast("string"), F.lit('","environment_vars":{"SEGMENT":"'), seg,
        F.lit('","DEBUG":null},"workload_size":"Small","scale_to_zero_enabled":true}]')))
    gw = F.element_at(F.array(*[F.lit(v).cast("string") for v in GATEWAY_VALUES]), (k % 6 + 1).cast("int"))
    return c.select(
        k.alias("seq"), F.col("c_name").alias("name"), gw.alias("ai_gateway"),
        acc.alias("auto_capture_config"), ents.alias("served_entities"),
        F.when(k % 2 == 0, F.col("c_name")).alias("description"),
        F.when(k % 3 == 0, F.lit(True)).alias("route_optimized"),
        F.concat(F.lit('[{"key":"segment","value":"'), seg, F.lit('"}]')).alias("tags"),
        (k % 13 != 0).alias("exists_in_workspace"), (k % 7 != 0).alias("table_exists"),
        F.when(k % 17 == 0, F.lit(400)).otherwise(F.lit(200)).alias("create_status"),
        F.when(k % 17 == 0, F.lit("Bad request")).alias("create_error"),
    )


def requested_endpoints(t: Tables) -> DataFrame:
    """All endpoint names, plus a name that is not in the list for every tenth customer."""
    c = t.customer
    real = c.select((F.col("c_custkey") * 2).alias("request_seq"), F.col("c_name").alias("endpoint_name"))
    ghost = c.where(F.col("c_custkey") % 10 == 0).select(
        (F.col("c_custkey") * 2 + 1).alias("request_seq"),
        F.concat(F.lit("ghost_"), F.col("c_custkey").cast("string")).alias("endpoint_name"))
    return real.unionByName(ghost)


def migration_configs(t: Tables) -> DataFrame:
    """One configuration per supplier, broken in one field by s_suppkey % 5."""
    s = t.supplier
    k = F.col("s_suppkey")
    b = k % 5
    ks = k.cast("string")
    return s.select(
        k.alias("config_id"),
        F.when(b == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("main.legacy.ot_"), ks)).alias("legacy_online_table"),
        F.when(b == 4, F.lit("")).otherwise(F.concat(F.lit("store_"), ks)).alias("online_store_name"),
        F.when(b == 2, F.concat(F.lit("main.t_"), ks)).otherwise(F.concat(F.lit("main.features.t_"), ks)).alias("target_table"),
        F.when(b == 3, F.lit("CU_3")).when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("CU_4")).alias("capacity"),
        (k % 2 == 0).alias("streaming"),
        F.lit(15).alias("timeout_minutes"),
    )


def name_lists(t: Tables) -> DataFrame:
    """JSON texts that should be lists of names: lists, empty lists, objects, texts, no JSON, null."""
    k = F.col("s_suppkey")
    name = lambda n: F.concat(F.lit('"ep_'), (k + n).cast("string"), F.lit('"'))
    value = F.when(k % 6 == 0, F.concat(F.lit("["), name(0), F.lit(", "), name(1), F.lit(", null]"))) \
        .when(k % 6 == 1, F.lit("[]")).when(k % 6 == 2, F.concat(F.lit('{"name": '), name(0), F.lit("}"))) \
        .when(k % 6 == 3, F.lit("[broken")).when(k % 6 == 4, name(0))
    return t.supplier.select(k.alias("list_id"), value.alias("value"))


def table_properties(t: Tables) -> DataFrame:
    """Property maps of tables: a provider in several spellings, another one, none."""
    k = F.col("p_partkey")
    provider = F.element_at(F.array(*[F.lit(x) for x in ("delta", "DELTA", "parquet", "Iceberg")]), (k % 4 + 1).cast("int"))
    return t.part.select(k.alias("table_id"), F.when(k % 5 == 0, F.create_map(F.lit("owner"), F.lit("x")))
                         .otherwise(F.create_map(F.lit("owner"), F.lit("x"), F.lit("provider"), provider)).alias("properties"))


def catalog_dependencies(t: Tables) -> DataFrame:
    e = t.supplier.select(F.lit("endpoint").alias("kind"), F.col("s_suppkey").alias("id"),
                          F.when(F.col("s_suppkey") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("name"),
                          F.when(F.col("s_suppkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("READY")).alias("state"))
    j = t.part.select(F.lit("job").alias("kind"), F.col("p_partkey").alias("id"),
                      F.when(F.col("p_partkey") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("name"),
                      F.when(F.col("p_partkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("ACTIVE")).alias("state"))
    return e.unionByName(j)


def orders_old(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey") % 19 != 0)


def orders_new(t: Tables) -> DataFrame:
    o = t.orders.where(F.col("o_orderkey") % 17 != 0)
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1)
                        .otherwise(F.col("o_totalprice")))


def order_changes(t: Tables) -> DataFrame:
    """Changes of orders: one to three versions per order, some of them deletions, in three arrivals.

    Versions of even orders arrive together, those of odd ones apart and not in order.
    """
    o = t.orders.where(F.col("o_orderkey") % 17 != 0)
    k = F.col("o_orderkey")
    v = F.explode(F.sequence(F.lit(0).cast("long"), k % 3)).alias("change_seq")
    o = o.select("*", v)
    return o.withColumn("o_totalprice", F.col("o_totalprice") + F.col("change_seq")) \
        .withColumn("gone", (k % 23 == 0) & (F.col("change_seq") == 1)) \
        .withColumn("arrival", F.when(k % 2 == 0, k % 3).otherwise((k + 2 - F.col("change_seq")) % 3))


def dependency_edges(t: Tables) -> DataFrame:
    """A tree: every part depends on part p_partkey / 2 (integer division)."""
    k = F.col("p_partkey")
    return t.part.select(k.alias("node"), F.when(k > 0, F.floor(k / 2)).cast("long").alias("upstream"))


# ------------------------------------------------------------ agent checkpoints
CHANNELS = ("messages", "branch:to:agent", "__start__")


def checkpoints_in(t: Tables) -> DataFrame:
    """One checkpoint per conversation turn; metadata and body as Python-style literal text."""
    c = t.conversations
    conv, turn = F.col("conv_id"), F.col("turn")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") \
        + F.make_dt_interval(F.lit(0), conv.cast("int"), F.lit(0), (turn * (conv % 5 + 7)).cast("int"))
    cid = F.lpad(turn.cast("string"), 6, "0")
    source = F.when(F.col("role") == "user", F.lit("input")).otherwise(F.lit("loop"))
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.select(
        F.concat(F.lit("thread_"), conv.cast("string")).alias("thread_id"),
        F.lit("").alias("checkpoint_ns"),
        cid.alias("checkpoint_id"),
        F.when(turn > 0, F.lpad((turn - 1).cast("string"), 6, "0")).alias("parent_checkpoint_id"),
        F.concat(F.lit("{'v': 4, 'id': '"), cid, F.lit("', 'ts': '"), iso, F.lit("'}")).alias("checkpoint"),
        F.concat(F.lit("{'source': '"), source, F.lit("', 'step': "), (turn - 1).cast("string"),
                 F.lit(", 'writes': None, 'parents': {}}")).alias("metadata"),
        ts.alias("ts"),
    )


def checkpoint_writes(t: Tables) -> DataFrame:
    """Pending writes: turn % 3 + 1 writes per checkpoint, channels in a fixed cycle."""
    c = t.conversations
    conv, turn = F.col("conv_id"), F.col("turn")
    w = c.select(conv, turn, F.explode(F.sequence(F.lit(0), (turn % 3).cast("int"))).alias("idx"))
    return w.select(
        F.concat(F.lit("thread_"), conv.cast("string")).alias("thread_id"), F.lit("").alias("checkpoint_ns"),
        F.lpad(turn.cast("string"), 6, "0").alias("checkpoint_id"),
        F.concat(F.lit("task_"), conv.cast("string"), F.lit("_"), turn.cast("string")).alias("task_id"),
        F.col("idx").cast("int").alias("idx"),
        F.element_at(F.array(*[F.lit(x) for x in CHANNELS]), F.col("idx").cast("int") + 1).alias("channel"),
        F.lit("msgpack").alias("type"), F.lit("").alias("task_path"),
        F.concat(F.lpad(turn.cast("string"), 8, "0"), F.lit("."), F.col("idx").cast("string")).alias("version"),
    )


def store_entries(t: Tables) -> DataFrame:
    """Key/value store rows: two namespaces, Python-style values, optional TTL."""
    e = t.events
    eid = F.col("event_id")
    prefix = F.when(eid % 3 == 0, F.concat(F.lit("profiles."), F.col("user_id").cast("string"))) \
        .otherwise(F.concat(F.lit("episodes."), F.col("user_id").cast("string")))
    value = F.concat(F.lit("{'content': {'k': "), F.get_json_object("props", "$.k"), F.lit(", 'note': None, 'kind': '"),
                     F.col("event_type"), F.lit("'}}"))
    ttl = F.when(eid % 4 == 0, F.lit(None).cast("int")).otherwise(((eid % 1440) * 60).cast("int"))
    return e.select(prefix.alias("prefix"), eid.cast("string").alias("key"), value.alias("value"),
                    F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), ttl.alias("ttl_minutes"))


# ------------------------------------------------------------ observability
ACCESS_TYPES = {"click": "read", "view": "read", "purchase": "write", "signup": "create", "error": "delete"}
COORDINATION_TYPES = {"click": "consensus", "view": "handoff", "purchase": "vote", "signup": "election",
                      "error": "conflict"}


def agent_messages(t: Tables) -> DataFrame:
    e = t.events
    eid = F.col("event_id")
    lat = (eid % 500).cast("long")
    return e.select(
        eid.alias("message_id"), eid.alias("orchestration_id"),
        F.concat(F.lit("agent_"), (F.col("user_id") % 7).cast("string")).alias("sender_agent_id"),
        F.concat(F.lit("agent_"), ((F.col("user_id") + eid) % 7).cast("string")).alias("receiver_agent_id"),
        F.col("event_type").alias("message_type"), F.col("ts").alias("sent_at"),
        F.when(eid % 3 != 0, lat).alias("latency_ms"),
        F.when(eid % 50 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), lat / F.lit(1000.0)))
        .alias("delivered_at"),
        F.length("props").cast("long").alias("payload_bytes"),
        F.concat(F.lit("t"), eid.cast("string")).alias("trace_id"),
    )


def agent_metrics(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("metric_id"),
        F.concat(F.lit("agent_"), F.col("l_suppkey").cast("string")).alias("agent_id"),
        F.col("l_orderkey").alias("orchestration_id"),
        (F.col("l_discount") * 1000).alias("cpu_ms"),
        F.col("l_quantity").cast("long").alias("tokens_in"),
        (F.col("l_linenumber") * 10).cast("long").alias("tokens_out"),
        (F.col("l_extendedprice") / 1000).cast("decimal(18,6)").alias("cost_usd"),
        F.when(F.col("l_returnflag") == "R", F.lit(1)).otherwise(F.lit(0)).alias("error_count"),
    )


def access_log(t: Tables) -> DataFrame:
    e = t.events
    eid = F.col("event_id")
    return e.select(
        eid.alias("access_id"), F.concat(F.lit("pool_"), (F.col("user_id") % 3).cast("string")).alias("pool_id"),
        _map_values(F.col("event_type"), ACCESS_TYPES).alias("access_type"),
        (eid % 50).cast("long").alias("lock_wait_ms"), F.col("value").alias("duration_ms"),
        (eid % 9 == 0).alias("conflict_detected"), F.col("ts").alias("accessed_at"))


def coordination(t: Tables) -> DataFrame:
    e = t.events
    eid = F.col("event_id")
    return e.select(
        eid.alias("event_id"), _map_values(F.col("event_type"), COORDINATION_TYPES).alias("event_type"),
        (eid % 4 != 0).alias("success"), F.col("value").alias("latency_ms"),
        ((eid % 100).cast("double") / F.lit(100.0)).alias("anomaly_score"), F.col("ts").alias("occurred_at"),
        eid.alias("orchestration_id"),
        F.concat(F.lit('{"trace_id": "t'), eid.cast("string"), F.lit("_"), (eid % 7 + 1).cast("string"), F.lit('"}'))
        .alias("trace_context"))


def orchestrations(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(F.col("o_orderkey").alias("orchestration_id"), F.col("o_orderstatus").alias("status"),
                    F.col("o_orderpriority").alias("workflow_id"), F.col("o_orderdate").alias("started_at"))


def trace_map(t: Tables) -> DataFrame:
    """One map per orchestration with its first three lines, and nested maps: line 3 has 4 and 5 below, line 5 has 6 and 7."""
    o = t.orders
    key = F.col("o_orderkey")
    k = key.cast("string")

    def one(prefix, root, kids, orchestration):
        names = F.concat(F.lit('["'), F.array_join(F.array(*[F.concat(F.lit("t"), k, F.lit(f"_{n}")) for n in kids]), '","'),
                         F.lit('"]'))
        return F.struct(F.concat(F.lit(prefix), k).alias("correlation_id"),
                        F.concat(F.lit("t"), k, F.lit(root)).alias("root_trace_id"), names.alias("child_trace_ids"),
                        orchestration.alias("orchestration_id"))
    none = F.lit(None).cast("long")
    maps = F.array(one("c", "", (1, 2, 3), key), one("d", "_3", (4, 5), none), one("e", "_5", (6, 7), none))
    return o.select(F.explode(maps).alias("_m")).select("_m.*")


def execution_nodes(t: Tables) -> DataFrame:
    """Workflow execution nodes: one per order line, traced under the order's root."""
    li = t.lineitem
    return li.select(F.col("l_orderkey").alias("orchestration_id"),
                     F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("trace_id"),
                     F.col("l_linenumber").cast("long").alias("tokens_in"))


def spans(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string"), F.lit("_"),
                              F.col("l_linenumber").cast("string")).alias("trace_id"),
                     F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("span_ts"))


def pit_labels(t: Tables) -> DataFrame:
    e = t.events.where(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("label_id"), "user_id", F.col("ts").alias("label_ts"))


def pit_features(t: Tables) -> DataFrame:
    e = t.events.where(F.col("event_type") == "view")
    return e.select("user_id", F.col("ts").alias("feature_ts"), F.col("value").alias("feature_value"),
                    F.col("event_id").alias("feature_id"))
