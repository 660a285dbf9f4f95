"""Forgetting and retention: policy flags, scores, quotas.

Two stores with two importance scales (never mixed):
* memory store: importance 0.1-0.9 (float), expiry columns (FLT3/FLT4/CMP2);
* experience store: importance rank 1-4 (LOW..CRITICAL), age/recency rules
  (FLT2, SC21, SRT1).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit, days_between
from .memory import forget_flag

# --- fixed values (must equal the reference) -------------------------------
LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4
# retention days by importance rank (other: 30)
RETENTION_DAYS = {LOW: 7, MEDIUM: 30, HIGH: 90, CRITICAL: 365}
RETENTION_DAYS_OTHER = 30
# forget-score penalty by importance rank (other: 0)
IMPORTANCE_PENALTY = {LOW: 0, MEDIUM: -10, HIGH: -25, CRITICAL: -1000}
AGE_WEIGHT, RECENCY_WEIGHT, ACCESS_WEIGHT = 0.1, 0.2, 2
ERROR_BONUS, PREFERENCE_BONUS = 5, -10
STALE_RECENCY_DAYS, STALE_MIN_ACCESS = 30, 3
ERROR_MAX_AGE_DAYS = 7
# ---------------------------------------------------------------------------


def _lookup(key: Column, table: dict, default) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def age_days(as_of=None) -> Column:
    return days_between(as_of_lit(as_of), F.col("created_at"))


def recency_days(as_of=None) -> Column:
    return days_between(as_of_lit(as_of), F.col("last_accessed"))


def should_forget(as_of=None) -> Column:
    """FLT2: ordered retention test on the experience store (strict '>')."""
    imp = F.col("importance")
    age, rec = age_days(as_of), recency_days(as_of)
    return (F.when(imp == CRITICAL, F.lit(False))
            .when(age > _lookup(imp, RETENTION_DAYS, RETENTION_DAYS_OTHER), F.lit(True))
            .when((rec > STALE_RECENCY_DAYS) & (F.col("access_count") < STALE_MIN_ACCESS), F.lit(True))
            .when((F.col("memory_type") == "error") & (age > ERROR_MAX_AGE_DAYS), F.lit(True))
            .otherwise(F.lit(False)))


def forget_score(as_of=None) -> Column:
    """SC21: higher means more forgettable."""
    mt = F.col("memory_type")
    type_bonus = F.when(mt == "error", F.lit(ERROR_BONUS)).when(mt == "preference", F.lit(PREFERENCE_BONUS)) \
        .otherwise(F.lit(0))
    return (age_days(as_of) * F.lit(AGE_WEIGHT) + recency_days(as_of) * F.lit(RECENCY_WEIGHT)
            + _lookup(F.col("importance"), IMPORTANCE_PENALTY, 0)
            - F.col("access_count") * F.lit(ACCESS_WEIGHT) + type_bonus).cast("double")


def forgetting_policy(memories: DataFrame, edges: DataFrame, vectors: DataFrame, as_of=None):
    """CMP2: remove expired (FLT3) and low-value (FLT4) memories from all three tables.

    The forgotten id set is computed once and written with a reliable
    checkpoint (eager), so all three tables see the same set and the memory
    table is not rescanned per anti join.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(memories.sparkSession)
    gone = memories.where(forget_flag(as_of)).select(F.col("id").alias("_gone")).checkpoint()
    kept_m = memories.join(gone, memories["id"] == gone["_gone"], "left_anti")
    kept_e = edges.join(gone, edges["source_id"] == gone["_gone"], "left_anti")
    kept_e = kept_e.join(gone, kept_e["target_id"] == gone["_gone"], "left_anti")
    kept_v = vectors.join(gone, vectors["id"] == gone["_gone"], "left_anti")
    return kept_m, kept_e, kept_v


# rows of one thread and score are counted in blocks of this many consecutive ``seq``
SEQ_BLOCK = 1 << 16


def forget_ranking(experiences: DataFrame, max_memories: int = 1000, as_of=None,
                   thread: str = "thread_id") -> DataFrame:
    """SRT1 + WN3: per thread, the rows the quota forgets.

    quota = max(0, rows_of_thread - max_memories); CRITICAL rows count toward
    the total but are never ranked; the highest forget scores go first, ties
    in input order (``seq``).

    Ranks come from counts: rows per (thread, score, block of ``seq``) are
    counted map-side first; sums over the scores of a thread, then over the
    blocks of a score, give how many rows rank before a block. Threads within
    their quota end there, and of the others only blocks that start below the
    quota are met with their rows, at most ``SEQ_BLOCK`` distinct ``seq`` each;
    exact row numbers are taken inside these. No thread is sorted as a whole.
    """
    rankable = F.col("importance") != CRITICAL
    block = F.coalesce(F.floor(F.col("seq") / SEQ_BLOCK), F.lit(-(2 ** 60)))
    scored = experiences.withColumn("forget_score", F.when(rankable, forget_score(as_of))).withColumn("_block", block)
    counts = scored.groupBy(thread, "forget_score", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(thread).orderBy(F.desc("forget_score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = counts.groupBy(thread, "forget_score").agg(F.sum("_n").alias("_n"))
    scores = scores.select(
        thread, "forget_score", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"),
        F.greatest(F.lit(0).cast("long"), F.sum("_n").over(Window.partitionBy(thread)) - F.lit(max_memories)).alias("quota"))
    scores = scores.where(F.col("forget_score").isNotNull() & (F.col("_above") < F.col("quota")))
    earlier = Window.partitionBy(thread, "forget_score").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.join(scores, [thread, "forget_score"]).withColumn(
        "_above", F.col("_above") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(
        F.col("_above") < F.col("quota")).drop("_n")
    inside = Window.partitionBy(thread, "forget_score", "_block").orderBy("seq")
    ranked = scored.join(blocks, [thread, "forget_score", "_block"]).withColumn(
        "forget_rank", F.col("_above") + F.row_number().over(inside))
    return ranked.where(F.col("forget_rank") <= F.col("quota")).drop("_above", "_block")


def forget_top_n(experiences: DataFrame, n: int, as_of=None) -> DataFrame:
    """SRT1 with one global quota ``n``: the n most forgettable rows overall.

    The quota can be large, so no single-task ``limit``: a global exact rank
    from the range layout (every row in one group, spread over all partitions).
    """
    from .ranking import group_row_number
    cand = experiences.where(F.col("importance") != CRITICAL).withColumn("forget_score", forget_score(as_of)) \
        .withColumn("_all", F.lit(0))
    ranked = group_row_number(cand, ["_all"], [F.desc("forget_score"), F.asc("seq")], out="forget_rank")
    return ranked.where(F.col("forget_rank") <= n).drop("_all")


def search_filter(experiences: DataFrame, memory_type: str | None = None,
                  min_importance: int | None = None, as_of=None) -> DataFrame:
    """FLT6 + JN7 of the experience store: post-search filters, then access +1.

    Missing importance counts as LOW; the comparison is inclusive.
    """
    out = experiences
    if memory_type:
        out = out.where(F.col("memory_type") == memory_type)
    if min_importance:
        out = out.where(F.coalesce(F.col("importance"), F.lit(LOW)) >= min_importance)
    return out.withColumn("access_count", F.col("access_count") + 1) \
              .withColumn("last_accessed", as_of_lit(as_of))
