"""Queries of the memory-store family."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefn
from ..operators import memory as mem
from ..sources import derived as d
from ..sources.tables import Tables
from .catalog import query


def _r6(c):
    return F.round(c, 6)


@query("memory_distribution")
def q_memory_distribution(spark, sf_dir):
    out = mem.memory_distribution(d.memories(Tables(spark, sf_dir)))
    return out.withColumn("avg_importance", _r6(F.col("avg_importance")))


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


@query("memory_enrich")
def q_memory_enrich(spark, sf_dir):
    out = mem.enrich(d.memory_requests(_t(spark, sf_dir)))
    return out.select("id", "session_id", "agent_id", "memory_type", "summary", "importance", "confidence",
                      "access_count", "created_at", "is_persistent", "expires_at", "is_summarized",
                      F.size("tags").alias("n_tags"), F.length("content").cast("bigint").alias("content_chars"))


@query("memory_validate")
def q_memory_validate(spark, sf_dir):
    return mem.validate(d.memory_requests(_t(spark, sf_dir))).select("id", "is_valid")


@query("expired_memories")
def q_expired(spark, sf_dir):
    m = d.memories(_t(spark, sf_dir))
    return m.where(mem.expired_predicate()).select("id", "agent_id", "memory_type", "expires_at")


@query("low_value_memories")
def q_low_value(spark, sf_dir):
    m = d.memories(_t(spark, sf_dir))
    return m.where(mem.low_value_predicate()).select("id", "agent_id", "importance", "confidence")


@query("cleanup_expired")
def q_cleanup(spark, sf_dir):
    m = d.memories(_t(spark, sf_dir))
    kept = mem.cleanup_expired(m).groupBy("agent_id").agg(F.count(F.lit(1)).alias("remaining_count"))
    return mem.cleanup_expired_count(m).join(kept, "agent_id", "left") \
        .select("agent_id", "deleted_count", F.coalesce("remaining_count", F.lit(0)).alias("remaining_count"))


@query("memory_statistics")
def q_statistics(spark, sf_dir):
    out = mem.memory_statistics(d.memories(_t(spark, sf_dir)))
    return out.withColumn("avg_importance", _r6(F.col("avg_importance"))) \
              .withColumn("avg_confidence", _r6(F.col("avg_confidence")))


@query("memory_lifecycle")
def q_lifecycle(spark, sf_dir):
    return mem.memory_lifecycle(d.memories(_t(spark, sf_dir)))


@query("agent_activity")
def q_activity(spark, sf_dir):
    t = _t(spark, sf_dir)
    r = mem.agent_activity(d.memories(t), d.reflections(t), d.tasks(t))
    return r.withColumns({c: F.col(c).cast("bigint") for c in ("total_memories", "total_reflections", "total_tasks")})


@query("forget_count")
def q_forget_count(spark, sf_dir):
    m = d.memories(_t(spark, sf_dir))
    return m.groupBy("agent_id").agg(F.count_if(mem.forget_flag()).alias("forgotten"))


@query("vector_count")
def q_vector_count(spark, sf_dir):
    return mem.vector_count(d.memory_vectors(_t(spark, sf_dir)))


@query("scoped_candidates")
def q_scoped(spark, sf_dir):
    m = d.memories(_t(spark, sf_dir))
    return mem.scope(m, agent_id="agent_1", memory_types=["conversation", "fact"]) \
        .select("id", "session_id", "memory_type")


@query("delete_memory")
def q_delete(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mem.delete_memories(d.memories(t), d.deleted_ids(t)).select("id", "agent_id")


def _actually_deleted(t):
    m = d.memories(t)
    return m.join(d.deleted_ids(t), ["id", "agent_id"], "left_semi").select("id")


@query("cascade_delete")
def q_cascade(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mem.cascade_delete(d.relationships(t), _actually_deleted(t)).select("id", "source_id", "target_id")


@query("memory_neighbors")
def q_neighbors(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mem.memory_neighbors(d.memories(t), d.relationships(t))


@query("mark_summarized")
def q_mark(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mem.mark_summarized(d.memories(t), d.deleted_ids(t)).select("id", "is_summarized")


@query("access_update")
def q_access(spark, sf_dir):
    t = _t(spark, sf_dir)
    hits = d.relationships(t).select(F.col("target_id").alias("id"))
    return mem.access_update(d.memories(t), hits).select("id", "access_count", "last_accessed")


@query("reflection_content")
def q_reflection(spark, sf_dir):
    out = mem.reflection_requests_to_memories(d.reflection_requests(_t(spark, sf_dir)))
    return out.select("id", "session_id", "memory_type", "content", "summary", "importance",
                      "is_persistent", "expires_at", F.size("tags").alias("n_tags"))


@query("remember_fact")
def q_remember(spark, sf_dir):
    req = d.memory_requests(_t(spark, sf_dir)).select(
        "id", "content", F.lit(None).cast("double").alias("importance"),
        F.array().cast("array<string>").alias("tags"),
        (F.col("id").cast("bigint") % 2 == 0).alias("is_persistent"))
    out = mem.remember_fact(req)
    return out.select("id", "session_id", "memory_type", "summary", "importance", "is_persistent", "expires_at")


@query("save_interaction")
def q_save_interaction(spark, sf_dir):
    p = d.turn_pairs(_t(spark, sf_dir)).select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        "user_text", "assistant_text")
    out = mem.save_interaction(p)
    return out.select("id", "session_id", "memory_type", "content", "summary", "importance",
                      "is_persistent", "expires_at", F.array_join("tags", ",").alias("tags"))


@query("forgetting_policy")
def q_forgetting_policy(spark, sf_dir):
    from ..operators.retention import forgetting_policy
    t = _t(spark, sf_dir)
    m, e, v = forgetting_policy(d.memories(t), d.relationships(t), d.memory_vectors(t))
    return m.select(F.lit("memories").alias("table_name"), "id") \
        .unionByName(e.select(F.lit("relationships").alias("table_name"), "id")) \
        .unionByName(v.select(F.lit("vectors").alias("table_name"), "id"))


@query("time_texts")
def q_time_texts(spark, sf_dir):
    """SC3 + SC6: ISO text and time ids."""
    m = d.memories(_t(spark, sf_dir))
    return m.select("id", timefn.iso_text(F.col("created_at")).alias("created_iso"),
                    timefn.time_id(F.col("created_at"), "summary_").alias("time_id"))


# fixed parameters of the recall tool
RECALL_LIMIT, RECALL_MIN_SCORE = 5, 0.3


def _search(spark, sf_dir):
    from ..operators.search import semantic_search
    t = _t(spark, sf_dir)
    return semantic_search(d.memories(t), d.memory_vectors(t), d.query_vectors(t),
                           limit=RECALL_LIMIT, min_score=RECALL_MIN_SCORE)


@query("semantic_search")
def q_semantic_search(spark, sf_dir):
    r = _search(spark, sf_dir)
    return r.select("query_id", "rank", "id", _r6(F.col("similarity")).alias("similarity"),
                    _r6(F.col("combined_score")).alias("combined_score"), "memory_type", "importance",
                    "confidence", "access_count")


@query("recall_format")
def q_recall_format(spark, sf_dir):
    from ..operators.search import recall_format
    return recall_format(_search(spark, sf_dir))


@query("search_access_update")
def q_search_access(spark, sf_dir):
    """CMP1 write-back: every joined hit of every search raises its memory's access count."""
    from ..operators.search import search_hits
    t = _t(spark, sf_dir)
    m = d.memories(t)
    hits = search_hits(m, d.memory_vectors(t), d.query_vectors(t), limit=RECALL_LIMIT, min_score=RECALL_MIN_SCORE)
    return mem.access_update(m, hits).select("id", "access_count", "last_accessed")


@query("cosine_similarity")
def q_cosine(spark, sf_dir):
    """SC22 through the kNN operator: nearest 10 vectors of every query, in scope."""
    from ..operators.search import knn
    t = _t(spark, sf_dir)
    r = knn(d.memory_vectors(t), d.query_vectors(t), 10)
    return r.select("query_id", "id", _r6(F.col("similarity")).alias("similarity"))
