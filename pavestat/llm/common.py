"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of one Arrow batch between the JVM and Python. Long texts would else
#: meet by the ten thousand in one batch, held by both sides at once.
BATCH_ROWS, BATCH_BYTES = 512, "4m"
#: Bytes of a row group of a table between steps: each writing task holds one.
ROW_GROUP = 16 << 20


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` by bounded batches. The bounds are settings of the session and
    stay set, as the plan reads them when it runs."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made and set, but only for a local
    master: on a cluster a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pavestat-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes the tables between steps that this application wrote, and tells how many. Call
    it once the results that read them are written or collected: a DataFrame that still reads
    them fails afterwards."""
    gone = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    return gone


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut lineage
    that survives lost executors, and a barrier that stops recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int = 2) -> DataFrame:
    """At least ``least`` tasks per core for small inputs of one file, so that Python
    stages use all cores. Inputs with enough splits are left where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least * cores) if df.rdd.getNumPartitions() < cores else df


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as Spark knows them from their files; what it does
    not know counts nothing. For numbers of partitions only."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def sized_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows; otherwise as
    it is, for a shuffled join. ``df`` should be cheap to count (written before)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


_caches: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None]) -> None:
    """In a Python worker: the operator ``name`` begins a task. Caches that other
    operators left in this worker are cleared, so that a job of many operators needs
    the memory of one."""
    others = [x for x in _caches if x != name]
    for other in others:
        _caches.pop(other)()
    _caches[name] = clear
    if others:
        trim()


def trim() -> None:
    """Freed memory of this Python worker back to the system: a worker that waits for
    its next task should not hold what the last one needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)
