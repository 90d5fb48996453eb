"""Written work tables: they cut lineage, survive lost executors, and are reused by later steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_known: dict[tuple, DataFrame] = {}
_paths: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines share. Only a local master, where all is one process, gets an own
    folder if that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandweave-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back; ``drop_written`` deletes the files. Bases take two bits or so each with zstd."""
    path = f"{folder(df.sparkSession)}/graphs/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _paths.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under a path: what a table made from them depends on."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(root, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def once(spark: SparkSession, key: tuple, make, source: str | None = None) -> DataFrame:
    """The table for ``key``, written at its first use in this application, and again when the files under ``source`` change."""
    at = (spark.sparkContext.applicationId, *key, *(_files(spark, source) if source else ()))
    if at not in _known:
        _known[at] = written(make(), str(key[0]))
    return _known[at]


def forget(spark: SparkSession) -> None:
    """Make the tables of ``once`` anew at their next use."""
    for at in [k for k in _known if k[0] == spark.sparkContext.applicationId]:
        del _known[at]


def drop_written(spark: SparkSession) -> None:
    """Delete the files of every table written in this application, once results are out."""
    forget(spark)
    jvm = spark.sparkContext._jvm
    for path in _paths.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
