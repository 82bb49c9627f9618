"""Structured Streaming over frame events: the same results as a batch, arriving file by file."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, minutes: int = 60, late: str | None = "1 day") -> DataFrame:
    """Frames and summed value (in thousandths) by window and type; late: watermark of a stream."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late and events.isStreaming:
        stamped = stamped.withWatermark("at", late)
    found = stamped.groupBy(F.window("at", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("total"))
    return found.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


def run_once(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Stream all files of a folder that match the name through windowed(); the sink keeps the last complete result."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="prismal-stream-")
    out = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("pathGlobFilter", name).parquet(folder)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    query = windowed(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result")
