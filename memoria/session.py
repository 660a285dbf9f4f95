"""Session helpers.

On a cluster the session is created by the platform; ``get_spark`` is for local
runs (tests, bench). ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session and only falls back to a local scratch folder when it is unset (tests).
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every run relies on: UTC session clock (the oracle is zone-free),
# AQE for runtime coalescing and skew splitting of sort-merge joins.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8,
              app: str = "memoria", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("MEMORIA_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        spark.conf.set(k, conf[k])
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    """True for ``local``, ``local[n]``, ``local[*]``; a local cluster has executors of its own."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local one is made only if none is set on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="memoria-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised snapshots."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage with a table that survives lost executors and keeps column pruning.
    """
    path = scratch_path(df.sparkSession, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
