"""Keyed tables kept as a base folder and a log of changes.

A micro-batch appends its rows, reduced to one per key, to ``changes/epoch=N``
(a retried epoch is written only if it did not complete). The table is the newest row per key
over base and log, resolved on read by a partial aggregate (``max_by``), so
neither writing nor reading needs a per-key window. Newest means the largest
``order`` value; among equals the later epoch wins, the log wins over the
base, and within one epoch the row whose values are the larger JSON text. A row
marked deleted is a tombstone: it hides older rows and arrives and ages like any
other row, so a late older row brings nothing back.

:func:`compact` folds the log into a new base. What a reader sees is named by
the newest file in ``versions/``: the base and the last epoch folded into it.
The file is written elsewhere and renamed, so a reader sees the state before or
after the fold, whichever step a crash hits. Nothing a reader may still use is
removed before :func:`vacuum`. One compaction runs at a time; streams may go on
appending meanwhile.
"""
from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.snapshots import newest_rows

ORDER, EPOCH, DELETED = "_order", "_epoch", "_deleted"
_DONE = "_SUCCESS"


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order, none if it is not there."""
    p, fs = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_once(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small JSON file whole or not at all; an existing file is an error."""
    temp, fs = file_system(spark, os.path.join(os.path.dirname(path), f"_{uuid.uuid4().hex}"))
    out = fs.create(temp, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    target, _ = file_system(spark, path)
    if fs.exists(target) or not fs.rename(temp, target):
        fs.delete(temp, False)
        raise FileExistsError(path)


def read_json(spark: SparkSession, path: str) -> dict:
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


# ------------------------------------------------------------ versions
def version(spark: SparkSession, out: str) -> dict:
    """{"version", "base", "through"}: the base folder readers use and the last epoch in it."""
    found = [n for n in names(spark, os.path.join(out, "versions")) if n.startswith("v=")]
    if not found:
        return {"version": 0, "base": None, "through": -1}
    return read_json(spark, os.path.join(out, "versions", found[-1]))


def commit(spark: SparkSession, out: str, number: int, base: str, through: int) -> None:
    write_once(spark, os.path.join(out, "versions", f"v={number:012d}"),
               {"version": number, "base": base, "through": through})


def epochs(spark: SparkSession, out: str, after: int) -> list[int]:
    """Complete epochs of the log later than ``after``."""
    log = os.path.join(out, "changes")
    found = [int(n.split("=")[1]) for n in names(spark, log) if n.startswith("epoch=")]
    return [e for e in found if e > after and exists(spark, os.path.join(_epoch(out, e), _DONE))]


def _epoch(out: str, epoch: int) -> str:
    return os.path.join(out, "changes", f"epoch={epoch:012d}")


# ------------------------------------------------------------ rows
def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _marked(df: DataFrame, order: str | None, deleted: Column | None, epoch: int) -> DataFrame:
    return df.withColumns({
        ORDER: F.col(order) if order else F.lit(0).cast("long"),
        DELETED: F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False)),
        EPOCH: F.lit(epoch).cast("long")})


def _newest(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """One row per key (null is a key like any other): that with the largest ``by``."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def append(batch: DataFrame, out: str, epoch: int, key, order: str | None = None,
           deleted: Column | None = None) -> None:
    """Write one micro-batch to the log, one row per key.

    A stream repeats an epoch with the same rows; one that is complete stays as it is, under its readers too.
    """
    if exists(batch.sparkSession, os.path.join(_epoch(out, epoch), _DONE)):
        return
    rows = _marked(batch, order, deleted, epoch)
    newest_rows(rows, key, ORDER).write.mode("overwrite").parquet(_epoch(out, epoch))


def start(base: DataFrame, out: str, order: str | None = None) -> None:
    """Make ``base`` the first version of the table; nothing happens if it has one."""
    spark = base.sparkSession
    if version(spark, out)["base"] is None:
        folder = f"base-{uuid.uuid4().hex}"
        _marked(base, order, None, -1).write.parquet(os.path.join(out, folder))
        commit(spark, out, 1, folder, -1)


def _resolved(spark: SparkSession, out: str, key, seen: dict, log: list[int]) -> DataFrame | None:
    """Newest row per key with its marks, tombstones included; None if there is nothing yet."""
    parts = [spark.read.parquet(os.path.join(out, seen["base"]))] if seen["base"] else []
    if log:
        parts.append(spark.read.parquet(*[_epoch(out, e) for e in log]))
    if not parts:
        return None
    # a source may carry columns that the base has not, such as the mark of a deletion
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return _newest(rows, _keys(key), F.struct(ORDER, EPOCH))


def read_latest(spark: SparkSession, out: str, key, schema) -> DataFrame:
    """The table: the newest row per key, without deleted ones, in the columns of ``schema``."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    seen = version(spark, out)
    rows = _resolved(spark, out, key, seen, epochs(spark, out, seen["through"]))
    if rows is None:
        return spark.createDataFrame([], schema)
    return rows.where(~F.col(DELETED)).select(*schema.fieldNames())


# ------------------------------------------------------------ compaction
def compact(spark: SparkSession, out: str, key, drop: Column | None = None) -> int:
    """Fold all complete epochs into a new base; returns the number of the version that readers see.

    ``drop`` names rows that may go for good, such as expired ones; tombstones
    stay, since an older row may still arrive. Without new epochs and ``drop``
    nothing is written.
    """
    seen = version(spark, out)
    log = epochs(spark, out, seen["through"])
    if not log and drop is None:
        return seen["version"]
    rows = _resolved(spark, out, key, seen, log)
    if rows is None:
        return seen["version"]
    if drop is not None:
        rows = rows.where(~F.coalesce(drop, F.lit(False)))
    folder = f"base-{uuid.uuid4().hex}"
    rows.write.parquet(os.path.join(out, folder))
    number = seen["version"] + 1
    commit(spark, out, number, folder, log[-1] if log else seen["through"])
    return number


def vacuum(spark: SparkSession, out: str) -> int:
    """Remove folded epochs and bases that the newest version does not use; returns how many folders went.

    To be run when no reader of an older version is left.
    """
    seen = version(spark, out)
    gone = [os.path.join(out, n) for n in names(spark, out) if n.startswith("base-") and n != seen["base"]]
    gone += [os.path.join(out, "changes", n) for n in names(spark, os.path.join(out, "changes"))
             if n.startswith("epoch=") and int(n.split("=")[1]) <= seen["through"]]
    for path in gone:
        remove(spark, path)
    return len(gone)
