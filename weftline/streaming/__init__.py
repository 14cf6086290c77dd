"""Streaming forms of counts and rates."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where all of Spark is one process and none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="weftline-")


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)


def windowed_rates(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and share of high values of each key in each window; state is dropped behind the watermark."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg((F.col(value) > 100).cast("double")).alias("high_rate"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "total", "high_rate")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what there is and stop; a restart with the same checkpoint goes on after it."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
