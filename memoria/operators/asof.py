"""Point-in-time (as-of) join: the feature value as known at each label's time.

Spark has no public as-of join. The usual "union + last(ignorenulls) over a
per-key window" puts a whole key in one task; here one hot key may hold a
third of all rows, so the window runs over ranges of (key, time):

1. labels and features are unioned and laid out by ``ranking.range_layout`` on
   (key, time, kind, tiebreak), which splits a hot key over many ranges;
2. inside each (key, range) the last feature is carried forward by a native
   window;
3. the last feature of each (key, range), at most one row each, is carried
   over the ranges of its key and joined back, null-safe, for the labels that
   saw no feature in their own range.

Ties: a feature at exactly the label time counts (<=); among features with the
same time the one with the largest tiebreak wins. Null keys match each other.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import join_ranges, range_layout


def asof_join(labels: DataFrame, features: DataFrame, key, label_ts: str, feature_ts: str,
              tiebreak: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """JN12: every label row with the latest feature row of the same key at or before its time.

    ``features`` columns other than the key come back on each label (null when
    no feature precedes the label).
    """
    keys = [key] if isinstance(key, str) else list(key)
    feat_cols = [c for c in features.columns if c not in keys]
    lab_cols = [c for c in labels.columns if c not in keys]
    clash = set(feat_cols) & set(lab_cols)
    if clash:
        raise ValueError(f"label and feature columns overlap: {sorted(clash)}")
    tb = F.col(tiebreak).cast("long") if tiebreak else F.lit(0).cast("long")
    f = features.select(*keys, F.col(feature_ts).cast("timestamp_ntz").alias("_ts"), F.lit(0).alias("_kind"),
                        tb.alias("_tb"), F.struct(*feat_cols).alias("_f"),
                        *[F.lit(None).cast(labels.schema[c].dataType).alias(c) for c in lab_cols])
    l_ = labels.select(*keys, F.col(label_ts).cast("timestamp_ntz").alias("_ts"), F.lit(1).alias("_kind"),
                       F.lit(0).cast("long").alias("_tb"),
                       F.lit(None).cast(f.schema["_f"].dataType).alias("_f"), *lab_cols)
    order = [F.col("_ts").asc_nulls_first(), F.col("_kind").asc(), F.col("_tb").asc_nulls_first()]
    s = range_layout(f.unionByName(l_), keys, order, num_partitions)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = s.withColumn("_own", F.last("_f", ignorenulls=True).over(inside)).where("_kind = 1")
    per = s.groupBy(*keys, "_range").agg(
        F.max_by("_f", F.when(F.col("_kind") == 0, F.struct("_ts", "_tb"))).alias("_lastf"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*keys, "_range", F.last("_lastf", ignorenulls=True).over(before).alias("_carry"))
    j = join_ranges(local, carry, keys)
    found = F.coalesce("_own", "_carry")
    return j.select(*keys, *lab_cols, *[found.getField(c).alias(c) for c in feat_cols])
