"""Links of users as a stream: counts per user and window of event time, late rows within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.functions.keys import user_key


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as they come in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_degrees(links: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """user_key, window_start, links: ends of links per user and window. A link counts once for each of its users, a
    link of a user with itself once; null keys and times count nowhere. Loaded rows of one edge_id count once while
    the watermark keeps them."""
    once = links.withColumn("at", F.col("observed_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["edge_id"])
    ends = once.select("at", F.explode(F.array_distinct(F.array(user_key("user_a"), user_key("user_b")))).alias("user_key")).filter(F.col("user_key").isNotNull())
    return ends.groupBy(F.window("at", window), "user_key").agg(F.count(F.lit(1)).alias("links")).select("user_key", F.col("window.start").alias("window_start"), "links")
