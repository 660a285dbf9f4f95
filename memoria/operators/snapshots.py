"""Snapshot operators: keyed upsert, change feed, copy comparison, checksums,
key checks and dependency levels.

No MERGE-capable table format is assumed: every operator reads snapshots and
returns the next snapshot as a DataFrame, to be written to a new location
(never over the path being read).
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, written


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def apply_changes(table: DataFrame, batch: DataFrame, key="id", action: str = "action") -> DataFrame:
    """SET2: apply one create / update / delete per key.

    create inserts when the key is absent; update replaces an existing row;
    delete removes it. Keys not in the batch are untouched.
    """
    keys = _keys(key)
    cols = table.columns
    touched = batch.select(*keys).distinct()
    untouched = table.join(touched, keys, "left_anti")
    existing = table.select(*keys)
    updated = batch.where(F.col(action) == "update").join(existing, keys, "left_semi").select(*cols)
    created = batch.where(F.col(action) == "create").join(existing, keys, "left_anti").select(*cols)
    return untouched.unionByName(updated).unionByName(created)


def newest_rows(rows: DataFrame, key, order: str | None = None, first: Column | None = None) -> DataFrame:
    """One row per key (null is a key like any other): the newest by ``order``.

    Among equals the one with the larger ``first``, then the larger JSON text of
    its values. A partial aggregate: a key with many rows is reduced map-side.
    """
    keys = _keys(key)
    rest = [c for c in rows.columns if c not in keys]
    by = [F.col(order)] if order else []
    by += [first] if first is not None else []
    by.append(F.to_json(F.struct(*rest)) if rest else F.lit(""))
    if not rest:
        return rows.distinct()
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def publish_merge(target: DataFrame, source: DataFrame, key, order: str | None = None) -> DataFrame:
    """SET4: upsert ``source`` into ``target`` by key; one row per source key.

    Without ``order`` the source row wins, of several the one whose values are
    the larger JSON text. With ``order`` the row with its largest value wins on
    either side, the source among equals. Idempotent: publishing the same
    source twice gives the same snapshot.
    """
    keys = _keys(key)
    source = source.select(*target.columns)
    if order is None:
        kept = target.join(source.select(*keys), keys, "left_anti")
        return kept.unionByName(newest_rows(source, keys))
    both = target.withColumn("_side", F.lit(0)).unionByName(source.withColumn("_side", F.lit(1)))
    return newest_rows(both, keys, order, F.col("_side")).drop("_side")


def _row_struct(df: DataFrame, cols, prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in cols])


def change_feed(before: DataFrame, after: DataFrame, key) -> DataFrame:
    """SET3: row changes from ``before`` to ``after``.

    Rows: insert (after image), delete (before image), and for changed rows an
    update_preimage and an update_postimage. Comparison is null-safe on all
    non-key columns.
    """
    keys = _keys(key)
    vals = [c for c in before.columns if c not in keys]
    b = before.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in vals]).withColumn("_b", F.lit(True))
    a = after.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in vals]).withColumn("_a", F.lit(True))
    j = b.join(a, keys, "full_outer")
    bs, as_ = _row_struct(j, vals, "_b_"), _row_struct(j, vals, "_a_")
    changed = j["_b"].isNotNull() & j["_a"].isNotNull() & ~bs.eqNullSafe(as_)

    def img(kind, s):
        return F.struct(F.lit(kind).alias("_change_type"), s.alias("_row"))
    changes = (F.when(j["_b"].isNull(), F.array(img("insert", as_)))
               .when(j["_a"].isNull(), F.array(img("delete", bs)))
               .when(changed, F.array(img("update_preimage", bs), img("update_postimage", as_))))
    return j.where(changes.isNotNull()).select(*keys, F.explode(changes).alias("_c")) \
        .select(*keys, *[F.col(f"_c._row.{c}").alias(c) for c in vals], F.col("_c._change_type").alias("_change_type"))


def apply_change_feed(before: DataFrame, feed: DataFrame, key) -> DataFrame:
    """Replay a change feed onto ``before`` (property: apply(feed(a, b), a) == b)."""
    keys = _keys(key)
    post = feed.where(F.col("_change_type").isin("insert", "update_postimage")).drop("_change_type")
    gone = feed.where(F.col("_change_type").isin("delete", "update_preimage")).select(*keys)
    return before.join(gone, keys, "left_anti").unionByName(post.select(*before.columns))


def compare_copies(legacy: DataFrame, new: DataFrame, key) -> DataFrame:
    """JN13: per key present in either copy: missing (only legacy), extra (only new),
    changed (values differ, null-safe), same."""
    keys = _keys(key)
    vals = [c for c in legacy.columns if c not in keys]
    l = legacy.select(*keys, F.struct(*vals).alias("_l"))
    n = new.select(*keys, F.struct(*[F.col(c) for c in vals]).alias("_n"))
    j = l.join(n, keys, "full_outer")
    status = (F.when(F.col("_n").isNull(), F.lit("missing")).when(F.col("_l").isNull(), F.lit("extra"))
              .when(F.col("_l").eqNullSafe(F.col("_n")), F.lit("same")).otherwise(F.lit("changed")))
    return j.select(*keys, status.alias("status"))


def canonical_text(df: DataFrame, cols=None) -> Column:
    """Type-driven text of a row for hashing (fixed-point doubles, ISO times, \\N for null)."""
    parts = []
    fields = {f.name: f.dataType for f in df.schema.fields}
    for c in cols or df.columns:
        t = fields[c]
        col = F.col(c)
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            # fixed point with six digits; beyond its range, and for non-finite numbers, the exact text
            s = F.coalesce(F.expr(f"try_cast(`{c}` as decimal(38,6))").cast("string"), col.cast("string"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            s = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            s = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(t, T.BooleanType):
            s = F.when(col, F.lit("true")).when(~col, F.lit("false"))
        else:
            s = col.cast("string")
        # the length in front keeps neighbouring fields apart, null has none
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("null")))
    return F.concat_ws("|", *parts)


def table_checksum(df: DataFrame, cols=None) -> DataFrame:
    """AG22: row count and an order-free checksum (sum of a 60-bit md5 prefix per row)."""
    h = F.conv(F.substring(F.md5(canonical_text(df, cols)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).cast("string").alias("checksum"))


def primary_key_check(df: DataFrame, key) -> DataFrame:
    """AG23: null keys, duplicated key values, rows in duplicated keys, verdict.

    One grouping by the key (partial aggregation) and one tiny aggregate over
    the groups: the table is scanned once.
    """
    keys = _keys(key)
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", any_null)
    dup = ~F.col("_null") & (F.col("_n") > 1)
    out = g.agg(F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).cast("long").alias("null_keys"),
                F.count_if(dup).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0)).cast("long").alias("duplicate_rows"))
    return out.withColumn("is_valid", (F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0))


def table_stats(tables: dict, cols=None) -> DataFrame:
    """Row count and checksum of several tables in one aggregation (one row per name)."""
    parts = [df.select(F.lit(name).alias("table_name"), canonical_text(df, cols).alias("_t")) for name, df in tables.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    h = F.conv(F.substring(F.md5(F.col("_t")), 1, 15), 16, 10).cast("decimal(38,0)")
    return u.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).cast("string").alias("checksum"))


def row_count(df: DataFrame, name: str) -> DataFrame:
    """AG8 (+ SRC4): rows and columns of a table."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.format_number("row_count", 0).alias("row_count_text"),
        F.lit(len(df.columns)).alias("column_count"))


def row_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """AG9: row count before and after, changed flag."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    return b.select("rows_before", after.agg(F.count(F.lit(1))).scalar().alias("rows_after")) \
        .withColumn("changed", F.col("rows_before") != F.col("rows_after"))


def migration_order(edges: DataFrame, node: str = "node", upstream: str = "upstream") -> DataFrame:
    """CMP12: level of each node = longest path from a root (upstreams first).

    Forest (every node has at most one upstream, checked with one aggregation):
    pointer jumping, each round doubles the hop length, so depth d needs
    about log2(d) rounds. General graph: the nodes without an open upstream are
    peeled off, level by level. Every round is written to the shared folder; a
    cycle of any length raises.
    """
    e = edges.select(F.col(node).alias("n"), F.col(upstream).alias("u"))
    links = written(e.where(F.col("u").isNotNull()).distinct(), "links")
    nodes = written(e.select("n").union(links.select(F.col("u").alias("n"))).distinct(), "nodes")
    fan_in = links.groupBy("n").agg(F.count(F.lit(1)).alias("_k")).agg(F.max("_k")).first()[0] or 0
    levels = _levels_by_pointer_jumping(nodes, links) if fan_in <= 1 else _levels_by_peeling(nodes, links)
    return levels.select(F.col("n").alias(node), "level")


def _levels_by_pointer_jumping(nodes: DataFrame, links: DataFrame) -> DataFrame:
    # (n, anc, dist): anc is the node ``dist`` hops up, null at a root; nodes that reached their root are left alone
    # hops double each round: a chain of all nodes ends after log2(nodes) rounds, only a cycle does not
    rounds = nodes.count().bit_length() + 1
    zero = F.lit(0).cast("long")
    done = written(nodes.join(links, "n", "left_anti").select("n", zero.alias("dist")), "roots")
    open_ = links.select("n", F.col("u").alias("anc"), F.lit(1).cast("long").alias("dist"))
    while not open_.isEmpty():
        if not rounds:
            raise ValueError("dependency graph has a cycle")
        rounds -= 1
        up = done.select(F.col("n").alias("anc"), F.lit(None).cast(nodes.schema["n"].dataType).alias("further"),
                         F.col("dist").alias("more"))
        up = up.unionByName(open_.select(F.col("n").alias("anc"), F.col("anc").alias("further"), F.col("dist").alias("more")))
        step = written(open_.join(up, "anc").select("n", F.col("further").alias("anc"), (F.col("dist") + F.col("more")).alias("dist")),
                       "jumps")
        done = done.unionByName(step.where("anc is null").drop("anc"))
        open_ = step.where("anc is not null")
    return done.withColumnRenamed("dist", "level")


PEEL_BUCKETS = 64


def _bucketed(df: DataFrame, by: str, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, dealt by ``by`` once, so that joins on it need not shuffle it again."""
    spark = df.sparkSession
    n = max(PEEL_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"{tag}_{uuid.uuid4().hex}"
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _levels_by_peeling(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Longest paths by peeling: a node gets its level when its last upstream has one.

    Links wait bucketed by upstream and the numbers of upstreams by node; a round
    moves only the frontier, the links out of it and the nodes that it touches.
    When the frontier is empty, what has no level yet is on or behind a cycle.
    """
    out = _bucketed(links, "u", "links_out")
    need = _bucketed(links.groupBy("n").agg(F.count(F.lit(1)).alias("need")), "n", "links_need")
    frontier = written(nodes.join(links, "n", "left_anti"), "frontier")
    touched = None          # nodes of which some upstreams have a level: (n, left)
    levels, level, found = frontier.withColumn("level", F.lit(0).cast("long")), 0, frontier.count()
    while True:
        met = out.join(frontier.withColumnRenamed("n", "u"), "u").groupBy("n").agg(F.count(F.lit(1)).alias("met"))
        fresh = met.join(need, "n") if touched is None else met.join(touched, "n", "left_anti").join(need, "n")
        now = fresh.select("n", (F.col("need") - F.col("met")).alias("left"))
        if touched is not None:
            again = touched.join(met, "n", "left").select("n", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"))
            now = now.unionByName(again)
        now = written(now, "peeled")
        frontier, touched = now.where("left = 0").select("n"), now.where("left > 0")
        more = frontier.count()
        if not more:
            break
        level, found = level + 1, found + more
        levels = levels.unionByName(frontier.withColumn("level", F.lit(level).cast("long")))
        if level % 64 == 0:      # the union of the levels stays short
            levels = written(levels, "levels")
    if found < nodes.count():
        raise ValueError("dependency graph has a cycle")
    return levels
