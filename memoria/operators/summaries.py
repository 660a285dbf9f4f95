"""Summaries of the two stores: conversation summaries (CMP3) and the
experience-store maintenance (CMP4/CMP5) with its gates.

Text that the reference sends to a language model is replaced by the
extracted text itself (no model call); all grouping, ordering and gating is
as in the reference. Per-group lists are bounded by a ``top_k`` window
(map-side pruned) wherever the reference keeps only the first n items.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit, iso_text, plus_days
from .ranking import top_k
from .retention import CRITICAL, HIGH, age_days, forget_ranking

# --- fixed values (must equal the reference) -------------------------------
SUMMARY_MIN_MESSAGES = 10          # HAVING COUNT(*) >= 10
SUMMARY_CUTOFF_DAYS = 3            # created more than 3 days ago
SUMMARY_MAX_SESSIONS = 5           # LIMIT 5
SUMMARY_MAX_ITEMS = 50             # first 50 messages per session
SUMMARY_IMPORTANCE = 0.7
SUMMARY_TAGS = ("conversation_summary", "auto_generated")
EXPERIENCE_SUMMARY_DAYS = 14       # summary_threshold_days
EXPERIENCE_GATE_OLD = 10           # more than 10 old memories
EXPERIENCE_GATE_SUMMARIZABLE = 5   # more than 5 summarizable ones
PREFERENCE_ITEMS = 5
INTERACTION_ITEMS = 3
SUMMARY_REASONING = "Consolidated multiple memories to reduce storage and improve retrieval"
SUMMARY_ACTION = "memory_summarization"
SUMMARY_TAG = "summary"
# ---------------------------------------------------------------------------


# ------------------------------------------------------------ conversation store
def summarize_candidates(memories: DataFrame, as_of=None, min_messages: int = SUMMARY_MIN_MESSAGES,
                         max_sessions: int | None = SUMMARY_MAX_SESSIONS) -> DataFrame:
    """AG5 + SRT3 + SRT4: sessions with >= min open conversation messages older than 3 days.

    Per (agent, session): full message count, first 50 ids and contents in
    created_at order (ties by seq). Sessions are taken oldest first, at most
    ``max_sessions`` per agent (None: all).
    """
    cutoff = plus_days(as_of_lit(as_of), -SUMMARY_CUTOFF_DAYS)
    open_ = memories.where((F.col("memory_type") == "conversation") & (F.col("is_summarized") == F.lit(False))
                           & (F.col("created_at") < cutoff))
    keys = ["agent_id", "session_id"]
    stats = open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("message_count"),
                                     F.min("created_at").alias("first_created"))
    stats = stats.where(F.col("message_count") >= min_messages)
    if max_sessions is not None:
        stats = top_k(stats, ["agent_id"], [F.asc("first_created"), F.asc("session_id")], max_sessions, "session_rank")
    first = top_k(open_, keys, [F.asc("created_at"), F.asc("seq")], SUMMARY_MAX_ITEMS, "pos")
    first = first.join(stats.select(*keys), keys, "left_semi")
    items = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "content"))).alias("_items"))
    return stats.join(items, keys, "inner").select(
        *keys, "message_count", "first_created",
        F.transform("_items", lambda x: x["id"]).alias("memory_ids"),
        F.transform("_items", lambda x: x["content"]).alias("contents"))


def summarize_conversations(memories: DataFrame, as_of=None):
    """CMP3: one summary memory per candidate session, originals (first 50) marked.

    Returns (summary_rows, updated_memories). The summary text is the dialogue
    of the first 50 messages (model call not built).
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(memories.sparkSession)
    # used for the summary rows and the marks: written once (eager), bounded per session
    cand = summarize_candidates(memories, as_of).checkpoint()
    now = as_of_lit(as_of)
    summaries = cand.select(
        F.sha2(F.concat_ws("|", F.lit("summary"), "agent_id", "session_id", now.cast("string")), 256).alias("id"),
        "session_id", "agent_id", F.lit("summary").alias("memory_type"),
        F.array_join("contents", "\n").alias("content"),
        F.lit(SUMMARY_IMPORTANCE).alias("importance"), F.lit(True).alias("is_persistent"),
        F.array(*[F.lit(t) for t in SUMMARY_TAGS]).alias("tags"),
        F.create_map(F.lit("source_memory_ids"), F.to_json("memory_ids"),
                     F.lit("message_count"), F.col("message_count").cast("string")).alias("meta_data"),
        F.col("message_count"))
    marked = cand.select(F.explode("memory_ids").alias("id"))
    from .memory import mark_summarized
    return summaries, mark_summarized(memories, marked)


# ------------------------------------------------------------ experience store
def maintenance_plan(experiences: DataFrame, max_memories: int = 1000, as_of=None,
                     threshold_days: int = EXPERIENCE_SUMMARY_DAYS, materialize: bool = True) -> dict:
    """CMP4 building blocks per thread: forgotten rows, remaining rows, gate, summarizable rows.

    The remaining rows and the summarizable rows feed several branches (gate,
    per-type texts, the next snapshot); each is written once with a reliable
    checkpoint to the shared folder, so the store is scanned and ranked once
    instead of once per branch (eager: two jobs). ``materialize=False`` skips
    the checkpoints for callers that use one branch only (the gate).
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(experiences.sparkSession)
    forgotten = forget_ranking(experiences, max_memories, as_of)
    gone = forgotten.select("thread_id", "seq", F.lit(True).alias("_gone"))
    remaining = experiences.join(gone, ["thread_id", "seq"], "left").where(F.col("_gone").isNull()) \
        .drop("_gone").withColumn("age_days", age_days(as_of))
    if materialize:
        remaining = remaining.checkpoint()
    age = F.col("age_days")
    gate = remaining.groupBy("thread_id").agg(
        F.count_if(age > threshold_days).alias("old_count"),
        F.count_if((age > threshold_days) & (F.col("importance") != CRITICAL)).alias("summarizable_count"))
    gate = gate.withColumn("should_summarize", F.col("old_count") > EXPERIENCE_GATE_OLD) \
               .withColumn("will_summarize", F.col("should_summarize")
                           & (F.col("summarizable_count") > EXPERIENCE_GATE_SUMMARIZABLE))
    summarizable = remaining.where((age > threshold_days) & (F.col("importance") != CRITICAL)) \
        .join(gate.where("will_summarize").select("thread_id"), "thread_id", "left_semi")
    if materialize:
        summarizable = summarizable.checkpoint()
    return {"forgotten": forgotten, "remaining": remaining.drop("age_days"), "gate": gate,
            "summarizable": summarizable.drop("age_days")}


def memory_groups(rows: DataFrame, thread: str = "thread_id") -> DataFrame:
    """AG6: per thread and memory type: count, first seq, group order by first appearance."""
    g = rows.groupBy(thread, "memory_type").agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"))
    return g.withColumn("group_order", F.row_number().over(Window.partitionBy(thread).orderBy("first_seq")))


# rows of one partial text in the two-level ordered string aggregation
TEXT_BLOCK_ROWS = 1 << 16


def ordered_join(rows: DataFrame, keys, order_col: str, value_col: str, sep: str = ", ",
                 block: int | None = None) -> DataFrame:
    """Text of each key group in ``order_col`` order, joined by ``sep``.

    With ``block`` (an integer ``order_col``) the text is built in two levels:
    partial texts per (key, order_col div block) -- a hot key is spread over
    many tasks -- then the partials are joined in block order. Only the final
    string (the result itself) is held per key.
    """
    keys = list(keys)
    if block is None:
        return rows.groupBy(*keys).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, value_col))),
                                     lambda x: x[value_col]), sep).alias("text"))
    part = rows.groupBy(*keys, F.floor(F.col(order_col) / F.lit(block)).alias("_blk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, value_col))),
                                 lambda x: x[value_col]), sep).alias("_part"))
    return part.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_part"))),
                                 lambda x: x["_part"]), sep).alias("text"))




def summary_text(summarizable: DataFrame, thread: str = "thread_id") -> DataFrame:
    """CMP5: summary text per thread, groups in first-seen order.

    header ``\\n{Type} Memories ({n}):`` then for preference the first 5
    observations, for interaction the actions of the 3 newest, for skill all
    observations; fact and error get the header only. Parts joined by newline.
    """
    groups = memory_groups(summarizable, thread)
    pref = top_k(summarizable.where(F.col("memory_type") == "preference"), [thread], [F.asc("seq")],
                 PREFERENCE_ITEMS, "pos")
    pref_line = ordered_join(pref, [thread], "pos", "observation") \
        .select(thread, F.lit("preference").alias("memory_type"),
                F.concat(F.lit("Key preferences: "), "text").alias("line"))
    inter = top_k(summarizable.where(F.col("memory_type") == "interaction"), [thread],
                  [F.desc("created_at"), F.asc("seq")], INTERACTION_ITEMS, "pos")
    inter_line = ordered_join(inter, [thread], "pos", "action") \
        .select(thread, F.lit("interaction").alias("memory_type"),
                F.concat(F.lit("Recent interactions focused on: "), "text").alias("line"))
    skill = summarizable.where(F.col("memory_type") == "skill")
    skill_line = ordered_join(skill, [thread], "seq", "observation", block=TEXT_BLOCK_ROWS) \
        .select(thread, F.lit("skill").alias("memory_type"),
                F.concat(F.lit("Demonstrated skills: "), "text").alias("line"))
    lines = pref_line.unionByName(inter_line).unionByName(skill_line)
    parts = groups.join(lines, [thread, "memory_type"], "left").select(
        thread, "group_order", "count",
        F.concat(F.lit("\n"), F.initcap("memory_type"), F.lit(" Memories ("), F.col("count").cast("string"),
                 F.lit("):"), F.when(F.col("line").isNotNull(), F.concat(F.lit("\n"), "line")).otherwise(F.lit("")))
        .alias("part"), "memory_type")
    return parts.groupBy(thread).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_order", "part"))), lambda x: x["part"]),
                     "\n").alias("summary_content"),
        F.sum("count").alias("original_memory_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("group_order", "memory_type"))),
                    lambda x: x["memory_type"]).alias("memory_types_included"))


def summary_records(text: DataFrame, schema, as_of=None, thread: str = "thread_id") -> DataFrame:
    """The stored record of each summary (one per thread), in the columns of ``schema``.

    ``key`` is a hash of thread and time, ``seq`` the time in microseconds, so a
    summary stands behind what it replaces and a later cycle can forget or
    replace it like any other row. The outcome map holds the replaced rows'
    number, the time, the types in order of appearance and the text. Columns of
    the store that a summary has no value for are null.
    """
    now = as_of_lit(as_of)
    values = {
        thread: F.col(thread),
        "seq": F.unix_micros(now.cast("timestamp")),
        "prefix": F.concat(F.lit("episodes."), F.col(thread).cast("string")),
        "key": F.md5(F.concat_ws("|", F.lit("summary"), F.col(thread).cast("string"), iso_text(now))),
        "observation": F.concat(F.lit("Summary of "), F.col("original_memory_count").cast("string"), F.lit(" memories")),
        "reasoning": F.lit(SUMMARY_REASONING), "action": F.lit(SUMMARY_ACTION),
        "outcome": F.create_map(
            F.lit("original_memory_count"), F.col("original_memory_count").cast("string"),
            F.lit("summary_created_at"), iso_text(now),
            F.lit("memory_types_included"), F.array_join("memory_types_included", ","),
            F.lit("summary_content"), F.col("summary_content")),
        "importance": F.lit(HIGH), "memory_type": F.lit("fact"),
        "tags": F.array(F.lit(SUMMARY_TAG)),
        "created_at": now, "last_accessed": now, "access_count": F.lit(1), "decay_factor": F.lit(1.0),
    }
    return text.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def maintenance_cycle(experiences: DataFrame, max_memories: int = 1000, as_of=None) -> tuple[DataFrame, DataFrame]:
    """CMP4 + SET1: (next store, lineage) of one maintenance run.

    Forgotten rows and summarized rows are removed; one summary row per
    summarized thread is added (importance HIGH, type fact, tags [summary]). The
    store has the columns it came with. ``lineage`` has thread_id, the key
    (``seq``) of the summary and ``replaces``, the ``seq`` of a row it stands for.
    """
    plan = maintenance_plan(experiences, max_memories, as_of)
    rows = summary_records(summary_text(plan["summarizable"]), experiences.schema, as_of)
    kept = plan["remaining"].join(plan["summarizable"].select("thread_id", "seq"), ["thread_id", "seq"], "left_anti")
    lineage = plan["summarizable"].select("thread_id", F.unix_micros(as_of_lit(as_of).cast("timestamp")).alias("seq"),
                                          F.col("seq").alias("replaces"))
    return kept.select(*experiences.columns).unionByName(rows), lineage


def maintenance(experiences: DataFrame, max_memories: int = 1000, as_of=None) -> DataFrame:
    """CMP4 + SET1: next snapshot of the experience store, see :func:`maintenance_cycle`."""
    return maintenance_cycle(experiences, max_memories, as_of)[0]


def maintenance_cycles(experiences: DataFrame, times, max_memories: int = 1000) -> DataFrame:
    """The store after maintenance at each of ``times``, every run on the store the one before it wrote."""
    from ..session import written
    store = experiences
    for as_of in times:
        store = written(maintenance(store, max_memories, as_of), "store")
    return store
