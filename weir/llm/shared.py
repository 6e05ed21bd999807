"""Small helpers that several operators use."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BATCH_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304", "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where it is unset and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weir-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/weir-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that materialize() writes within go at the end, but for those to be kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def merges(spark: SparkSession) -> bool:
    """Whether adaptive execution merges small partitions in this session."""
    keys = "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"
    return all(spark.conf.get(key, "true").lower() == "true" for key in keys)


def materialize(df: DataFrame, name: str, keep: bool = False, files: int = 0) -> DataFrame:
    """Write and reread df: cuts lineage, survives lost executors, and gives the planner real sizes.

    A file for each partition; where adaptive execution doesn't merge small partitions, all rows go evenly into `files` files (if given).
    """
    path = scratch_path(df.sparkSession, name)
    (df.repartition(files) if files and not merges(df.sparkSession) else df).write.parquet(path)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Bytes that the planner expects of df; 0 where it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded bytes, however long their texts are; a setting of the user's own stays."""
    for key, value in BATCH_LIMITS.items():
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)


def small(batches: Iterable[pa.RecordBatch], text: int | str, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of the text column, so that few texts are Python strings at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


_HELD: dict[str, Callable[[], object]] = {}


def settle(name: str, clear: Callable[[], object]) -> None:
    """For a task: what other operators keep in this worker process, which Spark uses again and again, is dropped."""
    others = [k for k in _HELD if k != name]
    for other in others:
        _HELD.pop(other)()
    _HELD[name] = clear
    if others:
        trim()


def trim() -> None:
    """Give freed memory back to the system; the C library otherwise keeps it for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
