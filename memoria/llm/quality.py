"""Quality rules with host-level verdicts (native columns only).

Every document is measured against a list of rules, each with a hard and a soft
limit. Failures of the soft limit are aggregated by host (the ``source`` of a
document); the rate of each (host, rule) is shrunk towards the corpus with an
empirical beta prior fitted by the method of moments, so a host of a few
documents cannot be condemned by chance. A host whose shrunk rate stands out is
judged strictly: its verdict is joined back and its documents are held to the
soft limit of that rule, all others to the hard one. A clean document is inside
the soft limits and stays, whatever its host.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, materialize, small_side, text_or_empty, words

SHINGLE = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# rule -> (measure over 1000 units of its base, hard limit, soft limit); a document fails above the limit
RULES = {
    "symbols": ("n_symbols", "n_words", 100, 30),        # symbols per 1000 words
    "dup_lines": ("n_dup_lines", "n_lines", 500, 300),    # repeated lines per 1000 lines
    "capitals": ("n_upper", "word_chars", 500, 300),      # capital letters per 1000 word characters
    "long_words": ("word_chars", "n_words", 10_000, 9_000),  # characters per 1000 words
    "repeats": ("n_repeat_words", "n_words", 200, 100),   # words in repeated windows per 1000 words
}
# lines repeat by chance in short texts: fewer repeated lines than this never fail
MIN_DUP_LINES = 3
# a host is judged strictly if its shrunk failure rate exceeds both
HOST_RATE = 0.3
HOST_LIFT = 2.0
# documents of average kind that the prior counts for at least and at most
MIN_CONCENTRATION = 10.0
MAX_CONCENTRATION = 1e6


def measures(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per input row: ``_row`` (the named columns), ``_host`` and the counts behind the rules.

    A null text has no words. Repeated windows are compared by 64-bit hashes
    inside one text.
    """
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
                    F.col("source").alias("_host"), text_or_empty("text").alias("_t"))
    t = t.withColumn("_w", words(F.col("_t")))
    t = t.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD_RE)))
    t = t.withColumn("_h", F.expr(
        f"case when size(_w) >= {SHINGLE} then transform(sequence(0, size(_w) - {SHINGLE}), i -> xxhash64("
        + ", ".join(f"_w[i + {j}]" for j in range(SHINGLE)) + ")) end"))
    # most texts repeat no window: only the others are sorted
    t = t.withColumn("_p", F.expr(
        "case when size(array_distinct(_h)) < size(_h) then "
        "sort_array(transform(_h, (h, i) -> struct(h as h, i as i))) end"))
    t = t.withColumn("_q", F.expr(
        "sort_array(transform(filter(_p, (p, j) -> (j > 0 and _p[j - 1].h = p.h) "
        "or (j < size(_p) - 1 and _p[j + 1].h = p.h)), p -> p.i))"))
    return t.select(
        "_row", "_host",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"coalesce(aggregate(transform(_q, (p, j) -> case when j < size(_q) - 1 "
               f"then least({SHINGLE}, _q[j + 1] - p) else {SHINGLE} end), 0, (a, x) -> a + x), 0)")
        .cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _fails(rule: str, limit: int) -> Column:
    num, base, _, _ = RULES[rule]
    over = 1000 * F.col(num) > limit * F.col(base)
    return over & (F.col("n_dup_lines") >= MIN_DUP_LINES) if rule == "dup_lines" else over


def host_rates(measured: DataFrame) -> DataFrame:
    """(_host, rule, n, k, prior_rate, concentration, rate, strict): shrunk soft-failure rates by host."""
    sums = [F.sum(_fails(r, RULES[r][3]).cast("long")).alias(r) for r in RULES]
    per = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *sums)
    long = per.select("_host", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES])).alias("_x")).select(
        "_host", "n", "_x.rule", "_x.k")
    # moments of the rates over hosts, from integer sums: sum n, sum k, sum k^2 / n
    prior = long.groupBy("rule").agg(
        F.sum("n").alias("_n"), F.sum("k").alias("_k"),
        F.sum((F.col("k") * F.col("k")).cast("double") / F.col("n")).alias("_k2"))
    mean = F.col("_k") / F.col("_n")
    spread = F.col("_k2") / F.col("_n") - mean * mean
    conc = F.when(spread > 1e-12, F.least(F.lit(MAX_CONCENTRATION),
                                          F.greatest(F.lit(MIN_CONCENTRATION), mean * (1 - mean) / spread - 1))
                  ).otherwise(F.lit(MAX_CONCENTRATION))
    prior = prior.select("rule", mean.alias("prior_rate"), conc.alias("concentration"))
    rate = F.round((F.col("k") + F.col("prior_rate") * F.col("concentration"))
                   / (F.col("n") + F.col("concentration")), 9)
    # five rows, one per rule
    return (long.join(F.broadcast(prior), "rule").withColumn("rate", rate)
            .withColumn("strict", (F.col("rate") > HOST_RATE)
                        & (F.col("rate") > F.round(HOST_LIFT * F.col("prior_rate"), 9))))


def verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` with host_strict (rules its host is judged strictly by), base_failed and kept."""
    strict = host_rates(measured).groupBy(F.col("_host").alias("_h")).agg(
        F.sort_array(F.collect_set(F.when(F.col("strict"), F.col("rule")))).alias("host_strict"))
    strict = small_side(materialize(strict, "hosts"))
    joined = measured.join(strict, F.col("_host").eqNullSafe(F.col("_h")), "left").drop("_h")
    bad = F.lit(False)
    for r, (_, _, hard, soft) in RULES.items():
        bad = bad | _fails(r, hard) | (F.array_contains("host_strict", r) & _fails(r, soft))
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Quality verdict of every document.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, source, host_strict (rules
    under which the host is judged strictly). Null texts and texts without
    words fail the base rule; a null source is a host of its own; repeated rows
    are judged alike; an empty table gives an empty result; other columns are
    not read.
    """
    out = verdicts(materialize(measures(docs, ["doc_id", "source"]), "quality"))
    return out.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "_row.source", "host_strict")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns unchanged."""
    return verdicts(materialize(measures(docs, docs.columns), "quality")).where("kept").select("_row.*")
