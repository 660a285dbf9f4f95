"""Queries of the experience store: retention, quotas, maintenance, summaries."""
from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions.timefn import DEFAULT_AS_OF
from ..operators import retention as ret
from ..operators import summaries as summ
from ..operators.ranking import top_k
from ..sources import derived as d
from ..sources.tables import Tables
from .catalog import query

# fixed parameters of the fixtures: quota per thread
MAX_MEMORIES = 50


def _ex(spark, sf_dir):
    return d.experiences(Tables(spark, sf_dir))


@query("forget_predicate")
def q_forget_predicate(spark, sf_dir):
    return _ex(spark, sf_dir).select("thread_id", "seq", ret.age_days().alias("age_days"),
                                     ret.recency_days().alias("recency_days"),
                                     ret.should_forget().alias("should_forget"))


@query("forget_score")
def q_forget_score(spark, sf_dir):
    return _ex(spark, sf_dir).select("thread_id", "seq", F.round(ret.forget_score(), 6).alias("forget_score"))


@query("forget_ranking")
def q_forget_ranking(spark, sf_dir):
    r = ret.forget_ranking(_ex(spark, sf_dir), MAX_MEMORIES)
    return r.select("thread_id", "seq", "forget_rank", F.round("forget_score", 6).alias("forget_score"), "quota")


# a quota over all threads together
FORGET_TOTAL = 1500


@query("forget_top_n")
def q_forget_top_n(spark, sf_dir):
    r = ret.forget_top_n(_ex(spark, sf_dir), FORGET_TOTAL)
    return r.select("thread_id", "seq", "forget_rank", F.round("forget_score", 6).alias("forget_score"))


@query("old_memories")
def q_old(spark, sf_dir):
    e = _ex(spark, sf_dir)
    return e.where((ret.age_days() > summ.EXPERIENCE_SUMMARY_DAYS) & (F.col("importance") != ret.CRITICAL)) \
        .select("thread_id", "seq", ret.age_days().alias("age_days"))


@query("memory_search_filter")
def q_search_filter(spark, sf_dir):
    r = ret.search_filter(_ex(spark, sf_dir), memory_type="skill", min_importance=ret.HIGH)
    return r.select("thread_id", "seq", "importance", "access_count", "last_accessed")


@query("memory_groups")
def q_groups(spark, sf_dir):
    return summ.memory_groups(_ex(spark, sf_dir))


@query("summary_gate")
def q_gate(spark, sf_dir):
    return summ.maintenance_plan(_ex(spark, sf_dir), MAX_MEMORIES, materialize=False)["gate"]


@query("recent_interactions")
def q_recent(spark, sf_dir):
    e = _ex(spark, sf_dir).where(F.col("memory_type") == "interaction")
    r = top_k(e, ["thread_id"], [F.desc("created_at"), F.asc("seq")], summ.INTERACTION_ITEMS, "pos")
    return r.select("thread_id", "pos", "action")


@query("key_preferences")
def q_prefs(spark, sf_dir):
    e = _ex(spark, sf_dir).where(F.col("memory_type") == "preference")
    r = top_k(e, ["thread_id"], [F.asc("seq")], summ.PREFERENCE_ITEMS, "pos")
    return r.select("thread_id", "pos", "observation")


@query("memory_summary_text")
def q_summary_text(spark, sf_dir):
    plan = summ.maintenance_plan(_ex(spark, sf_dir), MAX_MEMORIES)
    t = summ.summary_text(plan["summarizable"])
    return t.select("thread_id", "summary_content", "original_memory_count",
                    F.array_join("memory_types_included", ",").alias("memory_types_included"))


@query("maintenance")
def q_maintenance(spark, sf_dir):
    m = summ.maintenance(_ex(spark, sf_dir), MAX_MEMORIES)
    return m.select("thread_id", "seq", "memory_type", "importance", "observation",
                    F.col("outcome")["summary_content"].alias("summary_content"), F.array_join("tags", ",").alias("tags"))


# a maintenance run at as_of and two more, 20 and 40 days later
CYCLE_DAYS = (0, 20, 40)


@query("maintenance_cycles")
def q_maintenance_cycles(spark, sf_dir):
    times = [DEFAULT_AS_OF + datetime.timedelta(days=n) for n in CYCLE_DAYS]
    m = summ.maintenance_cycles(_ex(spark, sf_dir), times, MAX_MEMORIES)
    o = F.col("outcome")
    return m.select("thread_id", "seq", "memory_type", "importance", "observation", "access_count",
                    o["summary_content"].alias("summary_content"), o["original_memory_count"].alias("original_memory_count"),
                    o["memory_types_included"].alias("memory_types_included"))


@query("maintenance_lineage")
def q_maintenance_lineage(spark, sf_dir):
    return summ.maintenance_cycle(_ex(spark, sf_dir), MAX_MEMORIES)[1]


@query("summarize_candidates")
def q_candidates(spark, sf_dir):
    c = summ.summarize_candidates(d.memories(Tables(spark, sf_dir)))
    return c.select("agent_id", "session_id", "message_count", "first_created",
                    F.array_join("memory_ids", ",").alias("memory_ids"), F.size("contents").alias("n_contents"))


@query("summarize_conversations")
def q_summarize(spark, sf_dir):
    s, marked = summ.summarize_conversations(d.memories(Tables(spark, sf_dir)))
    a = s.select("agent_id", "session_id", F.lit("summary").alias("kind"), F.col("message_count").alias("n"),
                 F.length("content").cast("bigint").alias("chars"))
    b = marked.groupBy("agent_id").agg(F.count_if("is_summarized").alias("n")) \
        .select("agent_id", F.lit(None).cast("string").alias("session_id"), F.lit("summarized").alias("kind"), "n",
                F.lit(None).cast("bigint").alias("chars"))
    return a.unionByName(b)
