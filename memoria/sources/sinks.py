"""Sinks (SNK1-SNK8): append, backup/restore, JSON/text export, catalog changes.

Every writer targets a new folder or appends; nothing overwrites the path it
reads from. Writers are the only functions here that run a Spark job.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import as_of_lit
from ..operators.migration import provider_warning, quoted_table_name  # noqa: F401
from ..operators.memory import enrich

VECTOR_BACKUP_COLUMNS = ("id", "vector", "agent_id", "session_id", "memory_type")


def append_memories(requests: DataFrame, memories_path: str, vectors: DataFrame | None = None,
                    vectors_path: str | None = None, as_of=None) -> DataFrame:
    """SNK1: enrich new requests (PRJ1) and append them; vectors appended alongside."""
    rows = enrich(requests, as_of)
    rows.write.mode("append").parquet(memories_path)
    if vectors is not None and vectors_path:
        vectors.join(rows.select("id"), "id", "left_semi").write.mode("append").parquet(vectors_path)
    return rows


def backup_vectors(vectors: DataFrame, path: str, as_of=None) -> None:
    """SNK2: ids, vectors, metadata and a backup timestamp."""
    vectors.withColumn("backup_ts", as_of_lit(as_of)).write.mode("error").parquet(path)


def restore_vectors(spark: SparkSession, path: str, target_path: str | None = None) -> DataFrame:
    """SNK3: read a backup (vectors may be null) and optionally append it to a store."""
    df = spark.read.parquet(path).drop("backup_ts")
    if target_path:
        df.write.mode("append").parquet(target_path)
    return df


def save_results_json(results: DataFrame, path: str) -> None:
    """SNK4: raw results as JSON lines (UTF-8, non-ASCII kept)."""
    results.write.mode("error").json(path)


def save_text(results: DataFrame, path: str, content_col: str = "content") -> None:
    """SNK5: document text, empty when missing."""
    results.select(F.coalesce(F.col(content_col), F.lit("")).alias("value")).write.mode("error").text(path)


def rename_to_legacy(spark: SparkSession, name: str) -> tuple[str, bool, str]:
    """SNK6: rename ``a.b.c`` to ``a.b.c_legacy``; every part quoted on its own (trap T9)."""
    def quote(n):
        return ".".join("`" + p.replace("`", "``") + "`" for p in n.split("."))
    if not spark.catalog.tableExists(name):
        return name, False, "Table does not exist"
    # the new name stays in the catalog of the old one: give it without the catalog part
    target = ".".join((name + "_legacy").split(".")[-2:])
    spark.sql(f"ALTER TABLE {quote(name)} RENAME TO {quote(target)}")
    return name, True, "Table renamed successfully"


CDF_PROPERTY = "delta.enableChangeDataFeed"


def enable_change_data_feed(spark: SparkSession, name: str) -> tuple[bool, str]:
    """SNK7: set the change-feed property unless already set, then verify it."""
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if props.get(CDF_PROPERTY, "").lower() == "true":
        return True, "already enabled"
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{CDF_PROPERTY}' = 'true')")
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    ok = props.get(CDF_PROPERTY, "").lower() == "true"
    return ok, "enabled" if ok else "property not set after ALTER"


def show(df: DataFrame, n: int = 20) -> None:
    """SNK8."""
    df.show(n, truncate=False)
