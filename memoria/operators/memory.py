"""Agent-memory table operators: enrichment, validation, predicates, views.

Every function maps DataFrames to a DataFrame and takes ``as_of`` explicitly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit, plus_days, plus_hours
from ..functions.textfn import summary_or_truncate

# --- fixed values (must equal the reference) -------------------------------
# Memory types that are persistent when the caller does not say otherwise.
PERSISTENT_MEMORY_TYPES = ("fact", "knowledge", "reflection", "goal", "learned_skill", "user_preference")
# Memory types that are temporary by default.
TEMPORARY_MEMORY_TYPES = ("conversation", "scratch", "plan", "temporary", "task", "observation")
# Lifetime of a non-persistent memory: scratch 1 hour, conversation 7 days,
# plan 3 days, any other type 30 days.
EXPIRY_HOURS_SCRATCH = 1
EXPIRY_DAYS = {"conversation": 7, "plan": 3}
EXPIRY_DAYS_OTHER = 30
# Defaults of a new memory row.
DEFAULT_AGENT = "default_agent"
DEFAULT_IMPORTANCE = 0.5
DEFAULT_CONFIDENCE = 1.0
# ---------------------------------------------------------------------------

MEMORY_COLUMNS = (
    "id", "session_id", "agent_id", "memory_type", "content", "summary", "importance",
    "confidence", "access_count", "last_accessed", "created_at", "updated_at",
    "is_persistent", "expires_at", "is_summarized", "meta_data", "tags",
)


def persistence_rule(is_persistent: Column, memory_type: Column) -> Column:
    """PRJ2: given flag, else type in the persistent set."""
    return F.coalesce(is_persistent, memory_type.isin(*PERSISTENT_MEMORY_TYPES))


def expiry_rule(is_persistent: Column, memory_type: Column, now: Column) -> Column:
    """PRJ3: expiry of a temporary memory; null for persistent ones."""
    exp = F.when(memory_type == "scratch", plus_hours(now, EXPIRY_HOURS_SCRATCH))
    for t, d in EXPIRY_DAYS.items():
        exp = exp.when(memory_type == t, plus_days(now, d))
    exp = exp.otherwise(plus_days(now, EXPIRY_DAYS_OTHER))
    return F.when(~is_persistent, exp)


def _col_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def validity(df: DataFrame) -> Column:
    """FLT1: session_id, memory_type and content all present and non-empty."""
    def ok(c):
        return F.col(c).isNotNull() & (F.col(c).cast("string") != F.lit(""))
    return ok("session_id") & ok("memory_type") & ok("content")


def validate(requests: DataFrame) -> DataFrame:
    """FLT1 as a split marker: adds ``is_valid``; callers keep or route rows."""
    return requests.withColumn("is_valid", validity(requests))


def enrich(requests: DataFrame, as_of=None, agent_id: str | None = None,
           now_col: str | None = None) -> DataFrame:
    """PRJ1: new-memory rows from requests (PRJ2 + PRJ3 + PRJ4, casts, defaults).

    ``now_col`` names a column holding the creation time of each request; when
    absent the creation time is ``as_of``. Invalid requests (FLT1) are dropped;
    use :func:`validate` to see them.
    """
    now = F.col(now_col).cast("timestamp_ntz") if now_col else as_of_lit(as_of)
    df = requests.where(validity(requests))
    mtype = F.col("memory_type").cast("string")
    persist = persistence_rule(F.col("is_persistent") if "is_persistent" in df.columns else F.lit(None).cast("boolean"), mtype)
    agent = _col_or(df, "agent_id", F.lit(agent_id or DEFAULT_AGENT))
    content = F.col("content").cast("string")
    summary = F.col("summary").cast("string") if "summary" in df.columns else F.lit(None).cast("string")
    if "id" in df.columns:
        mid = F.col("id").cast("string")
    else:
        mid = F.sha2(F.concat_ws("|", agent, F.col("session_id").cast("string"), mtype, content, now.cast("string")), 256)
    return df.select(
        mid.alias("id"),
        F.col("session_id").cast("string").alias("session_id"),
        agent.alias("agent_id"),
        mtype.alias("memory_type"),
        content.alias("content"),
        summary_or_truncate(summary, content).alias("summary"),
        _col_or(df, "importance", F.lit(DEFAULT_IMPORTANCE)).cast("double").alias("importance"),
        _col_or(df, "confidence", F.lit(DEFAULT_CONFIDENCE)).cast("double").alias("confidence"),
        F.lit(0).alias("access_count"),
        now.alias("last_accessed"),
        now.alias("created_at"),
        now.alias("updated_at"),
        persist.alias("is_persistent"),
        expiry_rule(persist, mtype, now).alias("expires_at"),
        F.lit(False).alias("is_summarized"),
        _col_or(df, "meta_data", F.create_map().cast("map<string,string>")).alias("meta_data"),
        _col_or(df, "tags", F.array().cast("array<string>")).alias("tags"),
    )


# --- predicates --------------------------------------------------------------

def expired_predicate(as_of=None) -> Column:
    """FLT3: not persistent and expires_at before now (null expiry never expires)."""
    now = as_of_lit(as_of)
    return (F.col("is_persistent") == F.lit(False)) & F.col("expires_at").isNotNull() & (F.col("expires_at") < now)


def low_value_predicate(as_of=None) -> Column:
    """FLT4: not persistent, never accessed, older than a day, importance*confidence < 0.3."""
    now = as_of_lit(as_of)
    return ((F.col("is_persistent") == F.lit(False)) & (F.col("access_count") == 0)
            & (F.col("created_at") < plus_days(now, -1))
            & (F.col("importance") * F.col("confidence") < F.lit(0.3)))


def forget_flag(as_of=None) -> Column:
    """FLT3 or FLT4, null-safe (null counts as keep)."""
    return F.coalesce(expired_predicate(as_of) | low_value_predicate(as_of), F.lit(False))


def cleanup_expired(memories: DataFrame, as_of=None) -> DataFrame:
    """FLT5: rows that survive the stored cleanup (expires_at < now and not persistent)."""
    now = as_of_lit(as_of)
    pred = F.col("expires_at").isNotNull() & (F.col("expires_at") < now) & (F.col("is_persistent") == F.lit(False))
    return memories.where(~F.coalesce(pred, F.lit(False)))


def cleanup_expired_count(memories: DataFrame, as_of=None) -> DataFrame:
    """FLT5 / UD1 result: one row with the number of deleted rows, per agent and total."""
    now = as_of_lit(as_of)
    pred = F.col("expires_at").isNotNull() & (F.col("expires_at") < now) & (F.col("is_persistent") == F.lit(False))
    return memories.groupBy("agent_id").agg(F.count_if(F.coalesce(pred, F.lit(False))).alias("deleted_count"))


def scope(memories: DataFrame, agent_id: str | None = None, session_id: str | None = None,
          memory_types=None) -> DataFrame:
    """FLT7: conjunctive search scope applied before ranking."""
    out = memories
    if agent_id is not None:
        out = out.where(F.col("agent_id") == agent_id)
    if session_id:
        out = out.where(F.col("session_id") == session_id)
    if memory_types:
        out = out.where(F.col("memory_type").isin(*memory_types))
    return out


def delete_memories(memories: DataFrame, deletes: DataFrame) -> DataFrame:
    """FLT12: drop rows by (id, agent_id); ids given for another agent stay."""
    keys = deletes.select("id", "agent_id").distinct()
    return memories.join(keys, ["id", "agent_id"], "left_anti")


def cascade_delete(edges: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    """JN4: drop relationships whose source or target memory was deleted."""
    ids = deleted_ids.select(F.col("id").alias("_gone")).distinct()
    kept = edges.join(ids, edges["source_id"] == ids["_gone"], "left_anti")
    return kept.join(ids, kept["target_id"] == ids["_gone"], "left_anti")


def mark_summarized(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """JN6: set is_summarized where the id is listed (ids may repeat)."""
    hit = ids.select(F.col("id").alias("_hit_id")).distinct().withColumn("_hit", F.lit(True))
    joined = memories.join(hit, memories["id"] == hit["_hit_id"], "left")
    return joined.withColumn("is_summarized", F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("is_summarized"))) \
        .drop("_hit_id", "_hit")


def access_update(memories: DataFrame, hits: DataFrame, as_of=None) -> DataFrame:
    """JN7: access_count + number of hits, last_accessed = now for every hit row."""
    n = hits.groupBy(F.col("id").alias("_hid")).agg(F.count(F.lit(1)).alias("_n"))
    joined = memories.join(n, memories["id"] == n["_hid"], "left")
    return joined.withColumn("access_count", (F.col("access_count") + F.coalesce(F.col("_n"), F.lit(0))).cast("int")) \
        .withColumn("last_accessed", F.when(F.col("_n").isNotNull(), as_of_lit(as_of)).otherwise(F.col("last_accessed"))) \
        .drop("_hid", "_n")


# --- monitoring views ------------------------------------------------------------

def memory_statistics(memories: DataFrame) -> DataFrame:
    """AG1: per agent totals; null averages and sums become 0."""
    return memories.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total_memories"),
        F.count_if(F.col("is_persistent")).alias("persistent_count"),
        F.count_if(~F.col("is_persistent")).alias("temporary_count"),
        F.coalesce(F.avg("importance"), F.lit(0.0)).alias("avg_importance"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum("access_count"), F.lit(0)).cast("bigint").alias("total_accesses"),
    )


def memory_distribution(memories: DataFrame) -> DataFrame:
    """AG2 + SRT5: by agent and type, ordered by agent, count desc."""
    return memories.groupBy("agent_id", "memory_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("is_persistent")).alias("persistent"),
        F.count_if(~F.col("is_persistent")).alias("temporary"),
        F.avg("importance").alias("avg_importance"),
        F.sum("access_count").cast("bigint").alias("total_accesses"),
        F.max("last_accessed").alias("last_accessed"),
    ).orderBy("agent_id", F.desc("count"), "memory_type")


def memory_lifecycle(memories: DataFrame, as_of=None) -> DataFrame:
    """AG3 + SRT6: by agent and creation date, ordered by agent, date desc."""
    now = as_of_lit(as_of)
    return memories.groupBy("agent_id", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("created"),
        F.count_if(F.col("is_persistent")).alias("persistent_created"),
        F.count_if(F.col("expires_at") < now).alias("expired"),
        F.count_if(F.col("is_summarized")).alias("summarized"),
    ).orderBy("agent_id", F.desc("date"))


def _exact(a: Column, b: Column, c: Column) -> Column:
    """Product of three counts as decimal(38,0), wide enough for counts up to 10^12 each."""
    wide = a.cast("decimal(12,0)") * b.cast("decimal(12,0)") * c.cast("decimal(12,0)")
    return wide.cast("decimal(38,0)")


def agent_activity(memories: DataFrame, reflections: DataFrame, tasks: DataFrame) -> DataFrame:
    """AG4 / JN2 with the literal fan-out numbers of the two LEFT JOINs.

    memories LEFT JOIN reflections LEFT JOIN tasks on agent_id, then COUNT(...)
    multiplies: with M memory rows, R reflections, T tasks of an agent the
    counts are M*max(1,R)*max(1,T), M*R*max(1,T) and M*max(1,R)*T. Each side is
    aggregated per agent first (partial aggregation, no row blow-up) and the
    counts are multiplied, so the cost is linear in the inputs.
    """
    m = memories.groupBy("agent_id").agg(
        F.countDistinct("session_id").alias("unique_sessions"),
        F.count("id").alias("_m"),
        F.max("created_at").alias("last_activity"),
    )
    r = reflections.groupBy("agent_id").agg(F.count("id").alias("_r"), F.count(F.lit(1)).alias("_rrows"))
    t = tasks.groupBy("agent_id").agg(F.count("id").alias("_t"), F.count(F.lit(1)).alias("_trows"))
    j = m.join(r, "agent_id", "left").join(t, "agent_id", "left")
    rrows = F.greatest(F.coalesce(F.col("_rrows"), F.lit(0)), F.lit(1))
    trows = F.greatest(F.coalesce(F.col("_trows"), F.lit(0)), F.lit(1))
    return j.select(
        "agent_id", "unique_sessions",
        _exact(F.col("_m"), rrows, trows).alias("total_memories"),
        _exact(F.col("_m"), F.coalesce(F.col("_r"), F.lit(0)), trows).alias("total_reflections"),
        _exact(F.col("_m"), rrows, F.coalesce(F.col("_t"), F.lit(0))).alias("total_tasks"),
        "last_activity",
    )


def vector_count(vectors: DataFrame) -> DataFrame:
    """AG13: vectors per agent."""
    return vectors.groupBy("agent_id").agg(F.count(F.lit(1)).alias("vector_count"))


# --- request builders (tools of the reference as batch operators) -------------------
# fixed values: tool constants
CURRENT_SESSION = "current_session"
REFLECTION_IMPORTANCE = 0.8
REFLECTION_TAGS = ("reflection", "self_improvement")
INTERACTION_IMPORTANCE = 0.5
USER_MESSAGE_TAGS = ("conversation", "user_message")
AI_RESPONSE_TAGS = ("conversation", "ai_response")


def _str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def reflection_requests_to_memories(req: DataFrame, as_of=None) -> DataFrame:
    """PRJ12 (UD4): 'Reflection on {topic}' + optional insight / action lines."""
    ins, act = F.col("insights"), F.col("action_items")
    content = F.concat(
        F.lit("Reflection on "), F.col("topic"),
        F.when(F.size(ins) > 0, F.concat(F.lit("\nInsights: "), F.array_join(ins, ", "))).otherwise(F.lit("")),
        F.when(F.size(act) > 0, F.concat(F.lit("\nActions: "), F.array_join(act, ", "))).otherwise(F.lit("")),
    )
    meta = F.create_map(F.lit("insights"), F.to_json(F.coalesce(ins, F.array().cast("array<string>"))),
                        F.lit("action_items"), F.to_json(F.coalesce(act, F.array().cast("array<string>"))))
    rows = req.select(
        F.col("id"), F.lit(CURRENT_SESSION).alias("session_id"), F.lit("reflection").alias("memory_type"),
        content.alias("content"), F.lit(REFLECTION_IMPORTANCE).alias("importance"),
        F.lit(True).alias("is_persistent"), _str_array(REFLECTION_TAGS).alias("tags"), meta.alias("meta_data"))
    return enrich(rows, as_of)


def remember_fact(req: DataFrame, as_of=None) -> DataFrame:
    """PRJ13 (UD2): type fact when persistent else temporary, session current_session."""
    rows = req.select(
        "id", F.lit(CURRENT_SESSION).alias("session_id"),
        F.when(F.col("is_persistent"), F.lit("fact")).otherwise(F.lit("temporary")).alias("memory_type"),
        "content", F.coalesce(F.col("importance"), F.lit(DEFAULT_IMPORTANCE)).alias("importance"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"), "is_persistent")
    return enrich(rows, as_of)


def save_interaction(pairs: DataFrame, as_of=None) -> DataFrame:
    """PRJ15: one turn pair -> a 'Human: ' row and an 'Assistant: ' row."""
    both = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("Human: "), F.col("user_text")).alias("content"),
                 _str_array(USER_MESSAGE_TAGS).alias("tags")),
        F.struct(F.lit(1).alias("k"), F.concat(F.lit("Assistant: "), F.col("assistant_text")).alias("content"),
                 _str_array(AI_RESPONSE_TAGS).alias("tags")),
    )
    rows = pairs.select("session_id", "pair_id", F.explode(both).alias("m")).select(
        F.concat_ws("_", F.col("pair_id"), F.col("m.k").cast("string")).alias("id"),
        "session_id", F.lit("conversation").alias("memory_type"), F.col("m.content").alias("content"),
        F.lit(INTERACTION_IMPORTANCE).alias("importance"), F.lit(False).alias("is_persistent"),
        F.col("m.tags").alias("tags"))
    return enrich(rows, as_of)


def memory_neighbors(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """JN5: related memories of each memory, outgoing and incoming, with edge data.

    Edges whose ends both exist are joined with the type of each end once;
    one explode emits both directions (no union re-reading the inputs).
    """
    m = memories.select("id", "memory_type")
    e = edges.select("source_id", "target_id", "relationship_type", "strength")
    j = e.join(m.select(F.col("id").alias("source_id"), F.col("memory_type").alias("_st")), "source_id", "inner") \
         .join(m.select(F.col("id").alias("target_id"), F.col("memory_type").alias("_tt")), "target_id", "inner")
    dirs = F.array(
        F.struct(F.col("source_id").alias("memory_id"), F.col("target_id").alias("neighbor_id"),
                 F.lit("outgoing").alias("direction"), F.col("_tt").alias("neighbor_type")),
        F.struct(F.col("target_id").alias("memory_id"), F.col("source_id").alias("neighbor_id"),
                 F.lit("incoming").alias("direction"), F.col("_st").alias("neighbor_type")))
    x = j.select("relationship_type", "strength", F.explode(dirs).alias("d"))
    return x.select("d.memory_id", "d.neighbor_id", "d.direction", "relationship_type", "strength", "d.neighbor_type")
