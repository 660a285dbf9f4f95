"""Readers for landed files and the table catalog (SRC2-SRC7).

HTTP clients of the reference are not built: their responses are landed as
JSON files and read here with an explicit schema (no inference).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENDPOINT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ai_gateway", T.StringType()),
    T.StructField("auto_capture_config", T.StringType()),
    T.StructField("served_entities", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("route_optimized", T.BooleanType()),
    T.StructField("tags", T.StringType()),
])


def read_endpoints(spark: SparkSession, path: str, schema: T.StructType = ENDPOINT_SCHEMA) -> DataFrame:
    """SRC2: landed endpoint list (JSON lines, nested parts kept as JSON text).

    A missing or unreadable landing folder gives an empty table with the schema
    (the reference returns an empty list on any failure).
    """
    try:
        df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
        df.schema  # resolves the path
        return df
    except Exception:  # noqa: BLE001 - failure means "no endpoints"
        return spark.createDataFrame([], schema)


def result_rows(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """SRC3: a result table from tuples with an explicit schema."""
    return spark.createDataFrame(rows, schema)


def read_analysis_results(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """SRC7: analysis JSON documents: one indented document per file (as the service
    results are saved), or JSON lines with ``multi_line=False``."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """SRC4: (ordinal, col_name, data_type) of a catalog table."""
    fields = spark.table(name).schema.fields
    return spark.createDataFrame([(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
                                 "ordinal int, col_name string, data_type string")


def table_properties(spark: SparkSession, name: str) -> DataFrame:
    """SRC5: SHOW TBLPROPERTIES as one map column, with the table's provider.

    Spark reserves the property ``provider`` and shows it in the extended description only.
    """
    props = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key != 'provider'")
    about = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Provider'")
    props = props.unionByName(about.select(F.lit("provider").alias("key"), F.col("data_type").alias("value")))
    return props.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))


def table_exists(spark: SparkSession, name: str) -> bool:
    """SRC6."""
    return spark.catalog.tableExists(name)


def schema_preview(described: DataFrame, shown: int = 5) -> DataFrame:
    """SRT8: the first ``shown`` columns by ordinal and how many more there are."""
    more = described.agg(F.count(F.lit(1))).scalar()
    return described.where(F.col("ordinal") <= shown).withColumn("more", F.greatest(more - F.lit(shown), F.lit(0)))
