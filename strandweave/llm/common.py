"""Shared helpers of the training-data operators: work tables, batches, seeds."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one Arrow batch handed to Python; texts can be long, so it is far below Spark's default.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20

_tables: dict[str, list[str]] = {}


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python by rows and bytes, unless the session asks for less."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where everything runs in one
    process (a local master) is an own folder made if that is unset; a cluster must name one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="strandweave-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The result has no lineage beyond its files, so a lost executor costs only
    the tasks that read them. ``drop_tables`` deletes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved``, once nothing lazy reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_saved_at", None)
    if path:
        _delete(spark, path)
        _tables[spark.sparkContext.applicationId].remove(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that ``saved`` wrote in this application."""
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


@atexit.register
def _forget() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_tables(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


def fold(column: str, folds: int):
    """``crc32(column as text) mod folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(keys: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``keys``, by a hash of ``key``: a fixed choice, spread over the table.

    Large tables are thinned by the hash first, so that tasks don't each send a whole sample."""
    n = keys.count()
    if n > 8 * rows:
        keys = keys.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 32)) < F.lit(int((1 << 32) * 4 * rows / n)))
    return keys.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def stable(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it only reads files row by row, so that every pass sees the same rows in the same tasks; else written first."""
    nodes = re.findall(r"^[\s:+|-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    return df if nodes and set(nodes) <= {"Project", "Filter", "Relation"} else saved(df, name)


def text_batches(rows, batch_chars: int) -> Iterator[tuple[str, list[tuple]]]:
    """A task's rows, the last column a text, as lists of about ``batch_chars`` characters, each with its key.

    The key holds a checksum of the texts, so what one pass says of a batch meets only the very same texts in another."""
    from pyspark import TaskContext

    part, held, chars, n = TaskContext.get().partitionId(), [], 0, 0

    def key() -> str:
        sum_ = 0
        for *_, t in held:
            sum_ = zlib.crc32((t or "").encode("utf-8", "surrogatepass"), sum_)
        return f"{part}-{n}-{len(held)}-{sum_}"

    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            chars += len(row[-1] or "")
            if chars >= batch_chars:
                yield key(), held
                held, chars, n = [], 0, n + 1
    if held:
        yield key(), held


def give_back() -> None:
    """Return memory that is no longer used to the system: workers go on to other tasks, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(work):
    """A function for ``mapInArrow`` that gives memory back when a task ends."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        give_back()

    return run


def pack_texts(texts: list[str | None]) -> bytes:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return zlib.compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw), 1)


def unpack_texts(packed: bytes, count: int) -> list[str]:
    raw = zlib.decompress(packed)
    sizes, at, out = np.frombuffer(raw[: 8 * count], np.int64), 8 * count, []
    for s in sizes.tolist():
        out.append(raw[at : at + s].decode("utf-8", "surrogatepass"))
        at += s
    return out


def hash_slices(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the hash partitions' slices of sorted hashes begin and end: partitions are equal ranges of hashes."""
    bounds = [-(-(p << 64) // parts) for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(bounds, np.uint64)), [len(hashes)]]).astype(np.int64)


def pack_hashes(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences of as many bytes as the largest needs."""
    steps = np.diff(hashes)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + hashes[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts from 1 as one byte each, larger ones after them, compressed: most are small."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return zlib.compress(low.tobytes() + counts[low == 255].astype("<u8").tobytes(), 1)


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return out


def unpack_hashes(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(packed, np.uint8, 8, 1)
    steps[1:, :width] = raw
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)
