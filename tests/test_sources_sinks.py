"""Sources, sinks and catalog operations."""
import json
import os

from pyspark.sql import functions as F

from memoria.operators.documents import RESULT_SCHEMA
from memoria.sources import derived as d
from memoria.sources import landed, sinks
from memoria.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_endpoint_list_read_and_failure(spark, tmp_out):
    path = os.path.join(tmp_out, "endpoints")
    e = d.endpoints(Tables(spark, SF)).select([f.name for f in landed.ENDPOINT_SCHEMA.fields])
    e.write.json(path)
    back = landed.read_endpoints(spark, path)
    assert back.count() == e.count()
    missing = landed.read_endpoints(spark, os.path.join(tmp_out, "nothing-here"))
    assert missing.count() == 0 and missing.schema == landed.ENDPOINT_SCHEMA


def test_analysis_results_json_round_trip(spark, tmp_out):
    r = d.analysis_results(Tables(spark, SF))
    path = os.path.join(tmp_out, "results")
    sinks.save_results_json(r, path)
    back = landed.read_analysis_results(spark, path, RESULT_SCHEMA, multi_line=False)
    assert back.count() == r.count()
    assert back.where(F.size("pages") > 0).count() == r.where(F.size("pages") > 0).count()
    # non-ASCII text is kept as UTF-8
    raw = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f.endswith(".json"))
    first = json.loads(raw.splitlines()[0])
    assert "content" in first
    # one indented document per file, as the service results are saved
    one = os.path.join(path + "_doc")
    os.makedirs(one)
    with open(os.path.join(one, "result.json"), "w", encoding="utf-8") as fh:
        json.dump(first, fh, indent=2, ensure_ascii=False)
    assert landed.read_analysis_results(spark, one, RESULT_SCHEMA).count() == 1


def test_save_text_uses_empty_for_missing(spark, tmp_out):
    df = spark.createDataFrame([("a",), (None,)], "content string")
    path = os.path.join(tmp_out, "text")
    sinks.save_text(df, path)
    assert sorted(r[0] for r in spark.read.text(path).collect()) == ["", "a"]


def test_catalog_describe_properties_rename(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS mig")
    spark.read.parquet(f"{SF}/orders.parquet").write.mode("overwrite").saveAsTable("mig.orders_src")
    assert landed.table_exists(spark, "mig.orders_src")
    desc = landed.describe_table(spark, "mig.orders_src").collect()
    assert [r["col_name"] for r in desc][:2] == ["o_orderkey", "o_custkey"]
    ok, _ = sinks.enable_change_data_feed(spark, "mig.orders_src")
    props = landed.table_properties(spark, "mig.orders_src").first()["properties"]
    assert ok and props[sinks.CDF_PROPERTY] == "true"
    assert sinks.enable_change_data_feed(spark, "mig.orders_src") == (True, "already enabled")
    name, renamed, _ = sinks.rename_to_legacy(spark, "spark_catalog.mig.orders_src")
    assert renamed and landed.table_exists(spark, "mig.orders_src_legacy")
    assert sinks.rename_to_legacy(spark, "spark_catalog.mig.nope")[1] is False


def test_memory_store_prunes_partitions_and_pushes_filters(spark, tmp_out):
    from memoria.functions.timefn import as_of_lit
    from memoria.sources.store import read_memory_store, write_memory_store
    m = d.memories(Tables(spark, SF)).drop("meta_data")
    path = os.path.join(tmp_out, "store")
    write_memory_store(m, path)
    q = read_memory_store(spark, path, "agent_1").where(F.col("expires_at") < as_of_lit()).select("id", "expires_at")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(agent_id" in plan and "agent_1" in plan
    assert "PushedFilters: [IsNotNull(expires_at), LessThan(expires_at" in plan
    assert "ReadSchema: struct<id:string,expires_at:timestamp_ntz>" in plan
    assert q.count() == m.where((F.col("agent_id") == "agent_1") & (F.col("expires_at") < as_of_lit())).count()


def test_append_memories_and_schema_preview(spark, tmp_out):
    import datetime as dt

    from memoria.functions.timefn import iso_text, time_id
    from memoria.operators.migration import provider_warning
    req = spark.createDataFrame([("r1", "s", "fact", "hello"), ("r2", "", "fact", "dropped")],
                                "id string, session_id string, memory_type string, content string")
    path = os.path.join(tmp_out, "memories")
    rows = sinks.append_memories(req, path, as_of=dt.datetime(2024, 2, 1))
    assert rows.count() == 1 and spark.read.parquet(path).count() == 1
    spark.read.parquet(f"{SF}/orders.parquet").write.mode("overwrite").saveAsTable("orders_preview")
    prev = landed.schema_preview(landed.describe_table(spark, "orders_preview")).collect()
    assert len(prev) == 5 and prev[0]["more"] == 1
    df = spark.createDataFrame([({"provider": "PARQUET"},), ({"provider": "Delta"},), ({},)], "p map<string,string>")
    assert [r[0] is not None for r in df.select(provider_warning(F.col("p"))).collect()] == [True, False, False]
    ts = spark.createDataFrame([(dt.datetime(2024, 2, 1, 13, 5, 9),)], "t timestamp_ntz")
    r = ts.select(time_id(F.col("t"), "summary_"), iso_text(F.col("t"))).first()
    assert tuple(r) == ("summary_20240201_130509", "2024-02-01T13:05:09.000000")
