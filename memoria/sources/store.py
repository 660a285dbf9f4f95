"""Physical layout of the memory store (SRC1 and the reference's indexes).

Memories are written partitioned by ``agent_id`` (agent scans prune whole
folders) and sorted by ``created_at`` inside each file, so parquet row-group
min/max statistics skip row groups for time predicates (the composite
indexes of the reference). Writers target a new snapshot folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_COLUMN = "agent_id"


def write_memory_store(memories: DataFrame, path: str, files_per_agent: int | None = None) -> None:
    """Write a memory snapshot partitioned by agent, sorted by creation time within files."""
    df = memories
    if files_per_agent:
        df = df.repartition(files_per_agent, PARTITION_COLUMN, F.col("created_at"))
    else:
        df = df.repartitionByRange(PARTITION_COLUMN, "created_at")
    df.sortWithinPartitions(PARTITION_COLUMN, "created_at") \
      .write.mode("error").partitionBy(PARTITION_COLUMN).parquet(path)


def read_memory_store(spark: SparkSession, path: str, agent_id: str | None = None) -> DataFrame:
    """SRC1: memories of one agent (partition pruning) or all."""
    df = spark.read.parquet(path)
    return df if agent_id is None else df.where(F.col(PARTITION_COLUMN) == agent_id)
