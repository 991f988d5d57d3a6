"""Percentiles of very large numeric columns (problem 4).

A value falls into the bucket of its sign and of ceil(log(|value|) / log(gamma)), gamma = (1 + e) / (1 - e); counts of
equal buckets add up, so sketches of days, files or partitions merge by addition. A percentile is the middle of the
bucket that holds the value of rank floor(q * (n - 1)), counted from 0, and lies within the relative error e of it.

Defined results: null and NaN are absent; zero, negative values and both infinities count as they stand, zero and the
infinities exactly. A group without values has no rows. Null group columns form groups of their own. A sketch has at
most about 1,420 / log(gamma) buckets a sign, whatever the number of values. Other columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relative error of a percentile.
ERROR = 0.01
#: Bucket numbers of the infinities; no finite value comes near.
BEYOND = 1_000_000


def gamma(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def sketch(df: DataFrame, by: list[str], values: list[str], error: float = ERROR) -> DataFrame:
    """Bucket counts: by, feature, bucket_sign, bucket, n. Mergeable; combined before the shuffle."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values])).alias("v")).select(*by, "v.feature", "v.x")
    there = long.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    bucket = F.when(F.abs("x") == float("inf"), F.lit(BEYOND)).when(F.col("x") == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs("x")) / F.lit(math.log(gamma(error)))).cast("int"))
    return there.groupBy(*by, "feature", F.signum("x").cast("int").alias("bucket_sign"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of several parts as one per group."""
    return sketches.groupBy(*by, "feature", "bucket_sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: list[str], shares: list[float], error: float = ERROR) -> DataFrame:
    """by, feature, q, n, value: percentiles of merged sketches."""
    group = W.partitionBy(*by, "feature")
    along = group.orderBy(F.col("bucket_sign") * F.lit(2 * BEYOND) + F.col("bucket_sign") * F.col("bucket"))
    ranked = sketches.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(along)})
    wanted = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q")) for q in shares])).alias("w")
    picked = ranked.select("*", wanted).withColumn("rank", F.floor(F.col("w.q") * (F.col("total") - 1)))
    picked = picked.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    g = gamma(error)
    middle = F.when(F.col("bucket") == BEYOND, F.lit(float("inf"))).otherwise(F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket")))
    return picked.select(*by, "feature", F.col("w.q").alias("q"), F.col("total").alias("n"), F.when(F.col("bucket_sign") == 0, F.lit(0.0)).otherwise(F.col("bucket_sign") * middle).alias("value"))
