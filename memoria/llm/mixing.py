"""Mixing sources to target weights by entropy balancing (native columns only).

The mix takes document d of source s at a rate r_d in [0, 2]. Among all rates
that meet the token constraint of every source, sum(size_d * r_d) = target_s,
entropy balancing takes those closest to an even mix, which minimise
sum(r_d * (log r_d - 1)). The solution is exponentially tilted,
r_d = min(2, exp(lambda_s * size_d)), and the convex dual separates into one
multiplier per source, found by distributed Newton iterations: a histogram of
document sizes per source is the only input of an iteration, gradient and
curvature are two sums per source, and the multipliers live in a table. A
bracket around each root, kept beside it, halves whenever a Newton step leaves
it.

The rates are then rounded into whole copies: the integer part for certain, one
more for the documents whose hashed uniform number is furthest below the
fraction, as many as the words that are still missing allow, and one last
document whose size fits the rest best.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, running_sum, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
TOLERANCE = 1e-6
MAX_ROUNDS = 60


def targets(sizes: DataFrame, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size).

    Sources by code point, null last, weigh ``WEIGHTS`` in turn. A target stops
    at ``cap`` times its source's size; the excess goes to the others by weight
    until none is above. Sorted by capacity per weight, the capped sources are a
    prefix, so one pass of running sums replaces the rounds.
    """
    # the table of sources is the aggregate of the corpus: one row per source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    s = s.withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the first source whose share of what is left fits under its cap sets the level for all after it
    s = s.withColumn("_level", F.col("_left") / F.col("_wleft"))
    s = s.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    s = s.withColumn("_at", F.max(F.when(F.col("_fits"), F.col("_level"))).over(everything))
    return s.select("source", "source_size",
                    F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def solve(histogram: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, tilt, unit): the multiplier of every source; r = min(2, exp(tilt * size / unit)).

    ``histogram`` has (source, size, n), ``goal`` (source, source_size, target).
    Sources whose target is all they have (2 times their size) get a null tilt:
    every document is taken at the full rate.
    """
    full = F.col("target") >= MAX_COPIES * F.col("source_size") * (1 - 1e-12)
    mean = histogram.groupBy(F.col("source").alias("_s")).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    state = goal.join(mean, goal["source"].eqNullSafe(F.col("_s"))).drop("_s")
    state = state.select("source", "target", "unit", full.alias("full"), F.lit(0.0).alias("tilt"),
                         F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
                         F.lit(False).alias("done"))
    state = materialize(state.where("unit > 0"), "dual")
    h = histogram.select(F.col("source").alias("_s"), "size", "n")
    for _ in range(MAX_ROUNDS):
        z = F.col("size") / F.col("unit")
        rate = F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("tilt") * z, F.lit(2.0))))
        open_rows = h.join(state.where("not full and not done"), F.col("_s").eqNullSafe(F.col("source")))
        words = F.col("size") * F.col("n") * rate
        steps = open_rows.groupBy(F.col("source").alias("_s")).agg(
            F.sum(words).alias("_got"),
            F.sum(F.when(rate < MAX_COPIES, words * z).otherwise(0.0)).alias("_slope"))
        s = state.join(steps, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        gap = F.col("_got") - F.col("target")
        done = F.col("done") | F.coalesce(F.abs(gap) <= TOLERANCE * F.col("target"), F.col("_got").isNull())
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        s = s.withColumn("_low", low).withColumn("_high", high).withColumn("_done", done)
        newton = F.col("tilt") - gap / F.nullif(F.col("_slope"), F.lit(0.0))
        inside = (F.coalesce(newton > F.col("_low"), F.lit(True)) & F.coalesce(newton < F.col("_high"), F.lit(True))
                  & newton.isNotNull() & (F.abs(newton - F.col("tilt")) < 8))
        halved = (F.col("_low") + F.col("_high")) / 2
        away = F.when(gap < 0, F.greatest(F.lit(1.0), 2 * F.col("tilt"))).otherwise(
            F.least(F.lit(-1.0), 2 * F.col("tilt")))
        tilt = F.when(F.col("_done"), F.col("tilt")).when(inside, newton).otherwise(F.coalesce(halved, away))
        state = materialize(s.select("source", "target", "unit", "full", tilt.alias("tilt"),
                                     F.col("_low").alias("low"), F.col("_high").alias("high"),
                                     F.col("_done").alias("done")), "dual")
        if not state.agg(F.max(~F.col("full") & ~F.col("done"))).first()[0]:
            break
    return state.select("source", F.when(~F.col("full"), F.col("tilt")).alias("tilt"), "unit")


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("mix"), *cols), F.lit(1 << 40)) / float(1 << 40)


def entropy_mix(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """What the mix takes of every document.

    Returns one row per input row: doc_id, size, source_size, target, taken,
    source, rate, copies. ``taken`` is copies * size, copies is 0, 1 or 2. Null
    texts have size 0 and are taken at no word; a null source is a source of
    its own, last in order; equal rows may get different copies, but reruns
    agree on how many of each; an empty table gives an empty result; other
    columns are not read.
    """
    rows = materialize(docs.select("doc_id", "source", n_words(text_or_empty("text")).alias("size")), "sizes")
    return mix_rows(rows, share)


def mix_rows(rows: DataFrame, share: float = SHARE, more: list[str] = []) -> DataFrame:
    """:func:`entropy_mix` of a materialised table (doc_id, source, size); columns ``more`` go along."""
    tie = ["doc_id", "size", *more]
    hist = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = materialize(targets(sizes, share), "targets")
    tilts = solve(hist, goal)
    per = goal.join(tilts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    per = materialize(per.select(F.col("source").alias("_s"), "source_size", "target", "tilt", "unit"), "tilts")
    d = rows.join(per, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    z = F.col("size") / F.col("unit")
    rate = F.when(F.col("tilt").isNull(), F.lit(float(MAX_COPIES))).otherwise(
        F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.col("tilt") * z, F.lit(2.0)))))
    d = d.withColumn("rate", F.round(rate, 9)).withColumn("_sure", F.floor("rate").cast("long"))
    d = d.withColumn("_open", F.col("_sure") < MAX_COPIES)
    # one more copy in this order: first those whose uniform number is furthest below the fraction
    d = d.withColumn("_v", F.round(_uniform("doc_id", "size") - (F.col("rate") - F.col("_sure")), 12))
    d = d.withColumn("_more", F.when(F.col("_open"), F.col("size")).otherwise(F.lit(0)))
    d = running_sum(d.drop("tilt", "unit"), ["source"], ["_v", *tie], "_more", "_cum", "mix")
    d = materialize(d, "mix")
    sure = d.groupBy("source").agg((F.first("target") - F.sum(F.col("_sure") * F.col("size"))).alias("_need"))
    sure = materialize(sure.select(F.col("source").alias("_s"), "_need"), "need")
    d = d.join(sure, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.withColumn("_in", F.col("_open") & (F.col("size") > 0) & (F.col("_cum") <= F.col("_need")))
    rest = d.groupBy("source").agg(
        (F.first("_need") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0))).alias("_rest"))
    rest = materialize(rest.select(F.col("source").alias("_s"), "_rest"), "rest")
    # the best fitting further document, if it brings the total closer to the target
    spare = d.where("_open and not _in and size > 0").join(rest, F.col("source").eqNullSafe(F.col("_s")))
    off = F.abs(F.col("size") - F.col("_rest"))
    best = spare.where(off < F.abs(F.col("_rest"))).groupBy("_s").agg(
        F.min(F.struct(off.alias("off"), "_v", *tie, "_cum")).alias("_b"))
    best = materialize(best.select("_s", F.struct(*[f"_b.{c}" for c in ("_v", *tie, "_cum")]).alias("_b")), "best")
    d = d.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    chosen = F.struct("_v", *tie, "_cum").eqNullSafe(F.col("_b"))
    copies = F.col("_sure") + F.when(F.col("_in") | chosen, 1).otherwise(0)
    return d.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                    "source", "rate", copies.cast("int").alias("copies"), *more)


def repeat_rows(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns unchanged.

    Rows that repeat id, source and text are taken, in sum, as often as the mix
    takes them. Documents without words add nothing to any target and go.
    """
    t = text_or_empty("text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(t).alias("size"),
                         F.xxhash64(t).alias("_t"), F.xxhash64("doc_id", "source", t).alias("_k"))
    rows = materialize(packed.select("doc_id", "source", "size", "_t", "_k"), "sizes")
    times = mix_rows(rows, share, ["_t", "_k"]).where("size > 0 and copies > 0").groupBy("_t", "_k").agg(
        F.sum("copies").alias("_times"))
    times = materialize(times, "copies")
    # the row itself, once for all that repeat it
    once = packed.groupBy("_t", "_k").agg(F.first("_row").alias("_row"))
    return once.join(times, ["_t", "_k"]).select(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
