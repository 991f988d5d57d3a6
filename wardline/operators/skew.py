"""Joins and groupings whose hot keys are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many hot values are looked for; this bounds every broadcast made here.
TRACKED = 4096
#: Merged sketches that meet in the last step.
MERGED = 64


def hot_values(df: DataFrame, value: str, most: int = 256, tracked: int = TRACKED, least: int = 1000) -> DataFrame:
    """At most ``most`` values of the column that may be its most frequent, with at least about ``least`` rows, in one pass.

    A frequent-items sketch finds them: a value that holds more than about 7 / tracked of all rows is never missed.
    Sketches are merged in two steps, so no task holds those of all others. Nulls are no values. The result only steers
    how rows travel, never which rows come out.
    """
    parts = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("_part")).agg(F.expr(f"approx_top_k_accumulate({value}, {tracked})").alias("_sketch"))
    # by a constant: without rows there is no group, and so no sketch to estimate from
    top = parts.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_sketch, {tracked}), {most})").alias("top"))
    found = top.select(F.explode("top").alias("top")).filter(F.col("top.count") >= least).select(F.col("top.item").alias(value))
    return found.filter(F.col(value).isNotNull())


def hot_list(df: DataFrame, value: str, most: int = 256) -> list:
    """The hot values themselves, at most ``most``."""
    return [r[0] for r in hot_values(df.select(value), value, most).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, hot: list | None = None) -> DataFrame:
    """left with the column ``value`` of right, null where right has no such key; right has each key once.

    Rows of hot keys take the value from a broadcast of at most as many rows as there are hot values; all other rows
    meet right in a shuffle. Rows already served travel under a key of their own, spread evenly.
    """
    hot = hot_list(left, key) if hot is None else hot
    if not hot:
        return left.join(right.select(F.col(key), F.col(value)), key, "left").select(*left.columns, value)
    served = right.filter(F.col(key).isin(hot)).select(F.col(key), F.col(value).alias("_hot"), F.lit(True).alias("_is_hot"))
    rows = left.join(F.broadcast(served), key, "left")
    spread = F.when(F.col("_is_hot"), F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in left.columns]).cast("string"))).otherwise(F.col(key))
    rest = right.select(F.col(key).alias("_key"), F.col(value).alias("_rest"))
    joined = rows.withColumn("_at", spread).join(rest, F.col("_at") == F.col("_key"), "left")
    return joined.select(*left.columns, F.coalesce("_hot", "_rest").alias(value))
