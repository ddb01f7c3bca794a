"""Continuous indexing: new files of a folder, in micro-batches, through the same write path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docuforge.plans.indexing import Options, index
from docuforge.sources.files import extract_text
from docuforge.sources.store import Store


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def index_stream(files: DataFrame, store: Store, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Every micro-batch adds or replaces its own files and touches no other, so replays after a failure change nothing."""

    def batch(df: DataFrame, _: int) -> None:
        index(store, extract_text(df).select("path", "text", "modified_at"), options, upsert=True)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events a window and type, late ones up to the watermark; works on batches and streams alike."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
