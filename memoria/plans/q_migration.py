"""Queries of the migration family (endpoints and tables)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.jsonfn import parse_or_default
from ..operators import migration as mig
from ..operators import snapshots as snap
from ..sources import derived as d
from ..sources.tables import Tables
from .catalog import query

ENV = "dev"
ORDER_KEY = "o_orderkey"


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


@query("blank_config")
def q_blank(spark, sf_dir):
    e = d.endpoints(_t(spark, sf_dir))
    return e.select("seq", "name", mig.is_blank_json(F.col("ai_gateway")).alias("gateway_blank"),
                    mig.is_blank_json(F.col("auto_capture_config")).alias("capture_blank"))


@query("endpoint_lookup")
def q_lookup(spark, sf_dir):
    t = _t(spark, sf_dir)
    r = mig.endpoint_lookup(d.requested_endpoints(t), d.endpoints(t))
    return r.select("request_seq", "endpoint_name", "config_found", "seq")


@query("inference_table_name")
def q_table_name(spark, sf_dir):
    e = d.endpoints(_t(spark, sf_dir)).select(
        "seq", "auto_capture_config", mig.capture_map(F.col("auto_capture_config")).alias("_acc"))
    n = e.select("seq", mig.inference_table_name(F.col("auto_capture_config"), F.col("_acc")).alias("n"))
    return n.select("seq", "n.old_table", "n.new_table", "n.message")


@query("endpoint_payload")
def q_payload(spark, sf_dir):
    return mig.endpoint_payloads(d.endpoints(_t(spark, sf_dir)))


@query("migration_steps")
def q_steps(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = mig.migration_steps(mig.endpoint_lookup(d.requested_endpoints(t), d.endpoints(t)))
    return s.select("request_seq", "endpoint_name", "step_no", "step", "success", "message", "table_name")


def _flat(spark, sf_dir):
    t = _t(spark, sf_dir)
    return mig.migration_run(d.requested_endpoints(t), d.endpoints(t), ENV)


@query("migration_status")
def q_status(spark, sf_dir):
    return _flat(spark, sf_dir).select("request_seq", "endpoint_name", "overall_status")


@query("migration_flatten")
def q_flatten(spark, sf_dir):
    return _flat(spark, sf_dir)


@query("migration_report")
def q_report(spark, sf_dir):
    return mig.migration_report(_flat(spark, sf_dir))


@query("migration_run")
def q_run(spark, sf_dir):
    flat = _flat(spark, sf_dir)
    return mig.migration_report(flat).select("*", F.lit(ENV).alias("env"),
                                             flat.agg(F.max("date")).scalar().alias("date"))


@query("migration_config_check")
def q_config(spark, sf_dir):
    c = mig.config_check(d.migration_configs(_t(spark, sf_dir)))
    return c.select("config_id", "capacity", "error", "is_valid")


@query("dependency_inventory")
def q_inventory(spark, sf_dir):
    return mig.dependency_inventory(d.catalog_dependencies(_t(spark, sf_dir)))


@query("dependency_summary")
def q_dep_summary(spark, sf_dir):
    return mig.dependency_summary(mig.dependency_inventory(d.catalog_dependencies(_t(spark, sf_dir))))


@query("dependency_report")
def q_dep_report(spark, sf_dir):
    inv = mig.dependency_inventory(d.catalog_dependencies(_t(spark, sf_dir)))
    return mig.dependency_report(inv).select("kind", "id", "name", "more")


@query("row_count")
def q_row_count(spark, sf_dir):
    t = _t(spark, sf_dir)
    return snap.row_count(d.orders_old(t), "orders_old").unionByName(snap.row_count(d.orders_new(t), "orders_new"))


@query("row_drift")
def q_row_drift(spark, sf_dir):
    t = _t(spark, sf_dir)
    return snap.row_drift(d.orders_old(t), d.orders_new(t))


@query("change_feed")
def q_change_feed(spark, sf_dir):
    t = _t(spark, sf_dir)
    return snap.change_feed(d.orders_old(t), d.orders_new(t), ORDER_KEY)


@query("publish_merge")
def q_publish(spark, sf_dir):
    t = _t(spark, sf_dir)
    return snap.publish_merge(d.orders_old(t), d.orders_new(t), ORDER_KEY)


@query("publish_newest")
def q_publish_newest(spark, sf_dir):
    """Keys several times in the source, some older than the target: the newest change wins."""
    t = _t(spark, sf_dir)
    target = d.orders_old(t).withColumn("change_seq", F.lit(1).cast("long"))
    return snap.publish_merge(target, d.order_changes(t), ORDER_KEY, order="change_seq")


@query("legacy_vs_new")
def q_legacy_vs_new(spark, sf_dir):
    t = _t(spark, sf_dir)
    return snap.compare_copies(d.orders_old(t), d.orders_new(t), ORDER_KEY).where(F.col("status") != "same")


@query("table_checksum")
def q_checksum(spark, sf_dir):
    t = _t(spark, sf_dir)
    a = snap.table_checksum(d.orders_old(t)).select(F.lit("orders_old").alias("table_name"), "*")
    b = snap.table_checksum(d.orders_new(t)).select(F.lit("orders_new").alias("table_name"), "*")
    return a.unionByName(b)


@query("primary_key_check")
def q_pk(spark, sf_dir):
    t = _t(spark, sf_dir)
    a = snap.primary_key_check(t.lineitem, ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem").alias("table_name"), "*")
    b = snap.primary_key_check(t.orders, ["o_orderkey"]).select(F.lit("orders").alias("table_name"), "*")
    return a.unionByName(b)


@query("table_migration_check")
def q_table_check(spark, sf_dir):
    """CMP11: the source as a catalog table: checked, published and compared with itself and the target."""
    from ..session import scratch_path
    from ..sources import landed
    t = _t(spark, sf_dir)
    name = f"legacy_orders_{uuid.uuid4().hex}"
    d.orders_old(t).write.format("parquet").option("path", scratch_path(spark, name)).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('steward' = 'team')")
    src = spark.table(name)
    before = snap.table_checksum(src)
    checked = mig.source_check(landed.describe_table(spark, name), landed.table_properties(spark, name), before)
    target = snap.publish_merge(src, d.orders_new(t), ORDER_KEY)
    # what the target has to hold, by another way: both sides' rows, the new side's values where it has the key
    old, new = src, d.orders_new(t)
    vals = [c for c in old.columns if c != ORDER_KEY]
    j = old.select(ORDER_KEY, F.struct(*vals).alias("_o")).join(new.select(ORDER_KEY, F.struct(*vals).alias("_n")), ORDER_KEY, "full")
    expected = j.select(ORDER_KEY, F.coalesce("_n", "_o").alias("_r")).select(ORDER_KEY, *[F.col(f"_r.{c}").alias(c) for c in vals])
    verdict = mig.publish_verdict(before, snap.table_checksum(spark.table(name)), snap.table_checksum(expected),
                                  snap.table_checksum(target))
    p = F.col("properties")
    return checked.select(
        F.lit("orders_old").alias("table_name"), "row_count", "column_count", "preview", "more_columns", "warning", "error",
        F.element_at(p, "steward").alias("steward"), F.element_at(p, "provider").alias("provider"), verdict.select(F.struct("*")).scalar().alias("_v")).select("*", "_v.*").drop("_v")


@query("name_rows")
def q_name_rows(spark, sf_dir):
    return mig.name_rows(d.name_lists(_t(spark, sf_dir)), "list_id")


@query("config_missing_keys")
def q_missing(spark, sf_dir):
    c = mig.missing_keys(d.migration_configs(_t(spark, sf_dir)), mig.REQUIRED_CONFIG_FIELDS)
    return c.select("config_id", F.array_join("missing_keys", ",").alias("missing_keys"))


@query("provider_warnings")
def q_provider(spark, sf_dir):
    p = d.table_properties(_t(spark, sf_dir))
    return p.select("table_id", mig.provider_warning(F.col("properties")).alias("warning"))


@query("row_map")
def q_row_map(spark, sf_dir):
    """SC19: rows as maps, JSON objects as maps, their keys."""
    t = _t(spark, sf_dir)
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    m = c.select("c_custkey", mig.row_to_map(c).alias("m"))
    return m.select("c_custkey", mig.map_keys_text(F.col("m")).alias("keys"), F.size("m").alias("n_keys"),
                    F.col("m")["c_mktsegment"].alias("segment"), F.col("m")["c_nationkey"].alias("nation"))


@query("property_map")
def q_property_map(spark, sf_dir):
    """SC14 + SC19: JSON objects as maps, anything else as the empty map or the default."""
    t = _t(spark, sf_dir)
    text = F.when(F.col("event_id") % 7 == 0, F.lit("no json")).when(F.col("event_id") % 7 == 1, F.lit("[1]")) \
        .when(F.col("event_id") % 7 != 2, F.col("props"))
    e = t.events.select("event_id", text.alias("text"))
    is_map = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False))
    m = e.select("event_id", mig.to_map(F.col("text"), is_map).alias("m"),
                 parse_or_default(F.when(is_map, F.col("text")), "k string", F.struct(F.lit("none").alias("k"))).alias("parsed"))
    return m.select("event_id", mig.map_keys_text(F.col("m")).alias("keys"), F.col("parsed.k").alias("k"))


@query("migration_order")
def q_order(spark, sf_dir):
    return snap.migration_order(d.dependency_edges(_t(spark, sf_dir)))


@query("memory_changes")
def q_memory_changes(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = d.memories(t)
    out = snap.apply_changes(m, d.memory_change_batch(t).select(*m.columns, "action"), "id")
    return out.select("id", "importance", "memory_type")
