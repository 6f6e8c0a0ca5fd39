"""Streams: position de-duplication, sessions and keyed upserts on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def source(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream with an event-time column ``at``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def content_hash():
    return F.sha2(F.concat_ws("\x01", F.col("user_id").cast("string"), F.col("event_type"), F.format_number("value", 6)).cast("binary"), 256)


def deduped(stream: DataFrame, late: str = "90 minutes") -> DataFrame:
    """One row per content hash within the watermark: state is bounded, unlike a set that keeps every hash."""
    return stream.withColumn("content_hash", content_hash()).withWatermark("at", late).dropDuplicatesWithinWatermark(["content_hash"])


def sessions(stream: DataFrame, key: str, gap: str = "90 minutes", late: str = "90 minutes") -> DataFrame:
    return stream.withWatermark("at", late).groupBy(key, F.session_window("at", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A user-supplied sink per micro-batch; ``sink`` must be idempotent in the batch number."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_absent(root: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink per micro-batch that appends the rows whose keys the table lacks; an empty batch writes nothing, a repeated one changes nothing.

    Every batch leaves one row in ``root/cycles``: batch, seen, written."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = f"{root}/rows"
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(at).where(F.col("batch") != number).select(*keys), keys, "left_anti")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        part = f"{at}/batch={number}"
        fresh.write.mode("overwrite").parquet(part)
        seen = batch.agg(F.count("*").alias("seen"))
        written = spark.read.schema(fresh.schema).parquet(part).agg(F.count("*").alias("written"))
        seen.join(written, F.lit(True), "inner").select(F.lit(number).alias("batch"), "seen", "written").write.mode("overwrite").parquet(f"{root}/cycles/n={number}")

    return sink
