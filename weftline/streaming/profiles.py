"""An extension beyond matching: running profiles of an event stream in tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_profile(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Per window and type: events, distinct users (approximate when streaming), sum, least and largest value.

    Works on a stream or a table; a stream's windows close when the watermark passes them.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    users = F.approx_count_distinct("user_id") if e.isStreaming else F.count_distinct("user_id")
    agg = e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), users.alias("users"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n", "users", "total", "low", "high")


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
