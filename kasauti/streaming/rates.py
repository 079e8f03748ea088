"""Success rates over a stream: an extension, as the batch workload has no streams.

Events stand for verdicts. Late events within the watermark still count; state is
kept for open windows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def windowed_rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n and the share of values of at least 50, by tumbling window; works on streams and tables alike."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("hits"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round(F.col("hits") / F.col("n"), 6).alias("rate"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """All that is there now, into the in-memory table ``name``; a checkpoint lets a query go on where it stopped."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(600)
    query.stop()
