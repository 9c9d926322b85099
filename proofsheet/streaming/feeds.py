"""Structured Streaming sources and windows. All run with a checkpoint and stop when all that is there is read, if asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.images import FILE_SCHEMA, IMAGE_SCHEMA
from ..sources.recognition import requests

LATE = "10 minutes"


def dropped_images(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Pictures as they arrive in a folder."""
    return spark.readStream.format("image").schema(IMAGE_SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)


def dropped_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff", "pdf")) -> DataFrame:
    """Files of accepted formats as they arrive, with the hash of their content."""
    df = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"))


def request_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as lines of JSON files that arrive in a folder."""
    return requests(spark.readStream.text(folder))


def windowed_peaks(events: DataFrame, width: str = "1 hour", late: str | None = LATE) -> DataFrame:
    """Greatest value, mean and count of each stage in tumbling windows. On a stream, windows close when the watermark has passed."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if late and events.isStreaming else df
    g = df.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.max("elapsed_s").alias("peak"), F.avg("elapsed_s").alias("mean"), F.count("*").alias("samples"))
    return g.select(F.col("w.start").alias("start"), "stage", "peak", "mean", "samples")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Write all that is there to an in-memory table (for checks) and stop."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
