"""Statistics per class, the linear score made from them, and fits of scaling and clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions.scalars import between, sigmoid

#: Ranges in which clip_bounds counts values, for each doubling.
RANGES = 1024


def long_form(df: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """keep, feature, x: one row per row and feature."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])).alias("f")).select(*keep, "f.feature", "f.x")


def class_stats(labelled: DataFrame, names: list[str]) -> DataFrame:
    """Per class y and feature: n, sx, sxx over the values present, n_missing, n_rows. One pass, combined before the shuffle."""
    return long_form(labelled, names, "y").groupBy("y", "feature").agg(
        F.count("x").alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("sx"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("sxx"),
        F.sum(F.col("x").isNull().cast("bigint")).alias("n_missing"), F.count(F.lit(1)).alias("n_rows"))


def linear_weights(stats: DataFrame) -> DataFrame:
    """Per feature: weight of the value and of its absence, and the bias of the score, from statistics of both classes."""
    of = lambda c, y: F.coalesce(F.max(F.when(F.col("y") == y, F.col(c))), F.lit(0))
    wide = stats.groupBy("feature").agg(*[of(c, y).alias(f"{c}{y}") for c in ("n", "sx", "sxx", "n_missing", "n_rows") for y in (0, 1)])
    for y in (0, 1):
        mean = F.when(F.col(f"n{y}") > 0, F.try_divide(F.col(f"sx{y}"), F.col(f"n{y}"))).otherwise(0.0)
        wide = wide.withColumn(f"mean{y}", mean)
        wide = wide.withColumn(f"var{y}", F.when(F.col(f"n{y}") > 0, F.greatest(F.try_divide(F.col(f"sxx{y}"), F.col(f"n{y}")) - F.col(f"mean{y}") * F.col(f"mean{y}"), F.lit(0.0))).otherwise(0.0))
    weight = (F.col("mean1") - F.col("mean0")) / (0.5 * (F.col("var0") + F.col("var1")) + 1e-9)
    odds = F.log(((F.col("n_missing1") + 1) / (F.col("n_rows1") + 2)) / ((F.col("n_missing0") + 1) / (F.col("n_rows0") + 2)))
    prior = between(F.col("n_rows1") / (F.col("n_rows0") + F.col("n_rows1")), 1e-6, 1 - 1e-6)
    return wide.select("feature", between(weight, -10, 10).alias("weight"), between(odds, -2, 2).alias("weight_missing"), F.log(prior / (1 - prior)).alias("bias"))


def linear_score(df: DataFrame, names: list[str], weights: DataFrame, *keep: str) -> DataFrame:
    """keep and score in (0, 1) of every row.

    The weights are one row per feature, so they come to the driver and go into the projection as constants: no
    shuffle, whatever the number of rows.
    """
    known = {r["feature"]: r for r in weights.collect()}
    bias = next((r["bias"] for r in known.values()), 0.0)
    parts = [F.when(F.col(n).isNull(), F.lit(known[n]["weight_missing"])).otherwise(F.lit(known[n]["weight"]) * F.col(n)) for n in names if n in known]
    raw = F.lit(bias)
    for p in parts:
        raw = raw + p
    return df.select(*keep, sigmoid(raw, 20.0).alias("score"))


def scaling(df: DataFrame, names: list[str]) -> DataFrame:
    """Per feature mean and population deviation of the values with null as 0; a deviation of 0 counts as 1."""
    stats = long_form(df, names).groupBy("feature").agg(F.avg(F.coalesce("x", F.lit(0.0))).alias("mean"), F.stddev_pop(F.coalesce("x", F.lit(0.0))).alias("std"))
    return stats.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def clip_bounds(df: DataFrame, names: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per feature the exact values at ranks floor(q * (n - 1)); equal bounds move apart by 1, no values give (-1, 1).

    Values are counted in narrow ranges first. Only the values of the ranges that hold a rank are put in order, two a
    feature; the ranges are broadcast, no more than two a feature.
    """
    x = F.col("x")
    at = F.floor(F.signum(x) * F.log2(1 + F.abs(x)) * RANGES).cast("bigint")
    long = long_form(df, names).withColumn("range", at)
    by = W.partitionBy("feature")
    counted = long.groupBy("feature", "range").agg(F.count("x").alias("n")).withColumns({"there": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy(F.col("range").asc_nulls_first()))})
    ends = F.explode(F.array(*[F.struct(F.lit(name).alias("end"), F.floor(F.lit(q) * (F.col("there") - 1)).alias("rank")) for name, q in (("lo", low), ("hi", high))])).alias("e")
    held = counted.select("feature", "range", "n", "upto", ends).filter((F.col("e.rank") < F.col("upto")) & (F.col("e.rank") >= F.col("upto") - F.col("n")) & (F.col("n") > 0))
    wanted = F.broadcast(held.select("feature", "range", "e.end", (F.col("e.rank") - F.col("upto") + F.col("n")).alias("offset")))
    inside = long.join(wanted, ["feature", "range"]).groupBy("feature", "end", "offset", "x").agg(F.count(F.lit(1)).alias("n"))
    ranked = inside.withColumn("upto", F.sum("n").over(W.partitionBy("feature", "end").orderBy("x")))
    hit = ranked.filter((F.col("offset") < F.col("upto")) & (F.col("offset") >= F.col("upto") - F.col("n")))
    picked = hit.groupBy("feature").agg(F.max(F.when(F.col("end") == "lo", x)).alias("lo"), F.max(F.when(F.col("end") == "hi", x)).alias("hi"))
    picked = counted.select("feature").distinct().join(picked, "feature", "left")
    same = F.col("lo") == F.col("hi")
    return picked.select("feature", F.coalesce(F.when(same, F.col("lo") - 1).otherwise(F.col("lo")), F.lit(-1.0)).alias("lo"), F.coalesce(F.when(same, F.col("hi") + 1).otherwise(F.col("hi")), F.lit(1.0)).alias("hi"))
