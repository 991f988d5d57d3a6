"""Cleaned rows of train and test, the labels of users, and the links between them.

Users are told apart by key; rows with a null key keep their features but are nobody's. NaN reads as null throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.keys import user_key
from wardline.functions.scalars import no_nan


def feature_columns(df: DataFrame) -> list[str]:
    """Columns named feature_ and three digits, in order."""
    return sorted(c for c in df.columns if len(c) == 11 and c.startswith("feature_") and c[8:].isdigit())


def model_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    """Columns of a numeric type, without those left out."""
    return [n for n, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") and n not in leave_out]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or a ValueError that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def cleaned(df: DataFrame) -> DataFrame:
    """Rows with their key; features and label columns without NaN."""
    numbers = [*feature_columns(df), *[c for c in ("is_cheating", "high_conf_clean") if c in df.columns]]
    return df.withColumns({"key": user_key("user_hash"), **{c: no_nan(F.col(c)) for c in numbers}})


def label_class() -> Column:
    """The label of a row if it is exactly 0 or 1, else null."""
    return F.when(F.col("is_cheating").isin(0.0, 1.0), F.col("is_cheating").cast("int"))


def weak_negative(any_flag: bool = False) -> Column:
    """Whether an unlabelled row passes for clean: its flag is 1, or in the wide reading is there at all."""
    flagged = F.col("high_conf_clean").isNotNull() if any_flag else F.coalesce(F.col("high_conf_clean") == 1.0, F.lit(False))
    return F.col("is_cheating").isNull() & flagged


def user_labels(train: DataFrame) -> DataFrame:
    """key, y, weak: one row per user of train. y is the label of the latest labelled row, null without one; weak says
    that the user has no label and that the latest row passes for clean. Equal times fall to the higher row_id."""
    rows = train.filter(F.col("key").isNotNull()).select("key", label_class().alias("y"), weak_negative().alias("w"), F.struct("observed_at", "row_id").alias("at"))
    latest = rows.groupBy("key").agg(F.max_by("y", F.when(F.col("y").isNotNull(), F.col("at"))).alias("y"), F.max_by("w", "at").alias("w"))
    return latest.select("key", "y", (F.col("y").isNull() & F.col("w")).alias("weak"))


def interest(train: DataFrame, test: DataFrame) -> DataFrame:
    """The distinct keys of both tables."""
    return train.select("key").union(test.select("key")).filter(F.col("key").isNotNull()).distinct()


def links(edges: DataFrame) -> DataFrame:
    """a, b: the keys of every link that has both."""
    return edges.select(user_key("user_a").alias("a"), user_key("user_b").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def both_ways(links: DataFrame) -> DataFrame:
    """u, v: every link in both directions, as often as it stands; a link of a user with itself comes twice."""
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def simple(links: DataFrame) -> DataFrame:
    """u, v: every linked pair once in each direction; a user linked with itself once."""
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")))).otherwise(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return pairs.select(F.explode(ways).alias("e")).select("e.u", "e.v")
