"""Resumable append-only ingestion of JSON lines by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Spark's state store whose state lies on the executors' disks, not in their heaps.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str = "sample_id", files: int | None = None) -> StreamingQuery:
    """What is new in ``source`` goes to ``sink`` (Parquet), one row per key; the rows that
    stand there stay. Runs over what is there, ``files`` at a time, and ends; a later run with
    the same ``checkpoint`` resumes. The keys that were seen are keyed state of the stream,
    dealt by key and saved by changes: a batch looks up its own keys, and neither the sink nor
    what was ingested before is read. The file sink commits batches, so one that is done
    again after a failure adds nothing. Of rows of one key within a batch one stays; rows
    without a key and broken lines are left out. A sink belongs to one checkpoint: with
    another the keys would be unknown, and ValueError is raised."""
    if _exists(spark, f"{sink}/_spark_metadata") and not _exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{sink} was filled with another checkpoint")
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).json(source)
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)  # a query takes the setting when it starts
    try:
        return fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def ingested(spark: SparkSession, schema: str, sink: str) -> DataFrame:
    """What stands in a sink, also if that is nothing."""
    return spark.read.schema(schema).parquet(sink)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and key. ``time`` may be without a zone; later than ``late`` is
    dropped when this runs as a stream."""
    seen = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    counted = seen.groupBy(F.window("__at", width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), key, "n")
