"""Request rates by client in fixed and sliding windows; the same plans take a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query


def rates(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events of each user in each window of event time, by its start."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def watched(events: DataFrame, late: str = "10 minutes", width: str = "60 seconds") -> DataFrame:
    """The fixed windows of a stream of events; later ones than the watermark are dropped."""
    return rates(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("SELECT user_id, CAST(epoch(time_bucket(INTERVAL '60 seconds', ts)) AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY ALL")
def rate_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_events(spark, sf_dir), "60 seconds").select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query("SELECT user_id, CAST(epoch(time_bucket(INTERVAL '6 seconds', ts)) AS BIGINT) - 6 * k AS start_s, count(*) AS n FROM events, range(10) r(k) GROUP BY ALL")
def rate_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_events(spark, sf_dir), "60 seconds", "6 seconds").select("user_id", F.unix_timestamp("start").alias("start_s"), "n")
