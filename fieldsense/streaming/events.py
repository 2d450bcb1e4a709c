"""Event streams: windowed and session counts, each equal to its batch twin."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, stream: bool) -> DataFrame:
    """The events table, as a table or as a stream of its files; ts as an instant, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    if stream:
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        source = spark.read.parquet(f"{sf_dir}/events.parquet")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_end(stream: DataFrame, name: str = "stream") -> DataFrame:
    """What a stream holds once all there is has been read: each batch's result replaces the one before in a folder of the
    shared checkpoint folder; only a local[*] session may leave that unset."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared or 'file://' + tempfile.mkdtemp(prefix='fieldsense-')}/streams/{name}-{uuid.uuid4().hex}"
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/result")
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/result")
