"""CSV and JSON sources, the CSV sink, and the check of a written result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.scalars import safe_float
from wardline.operators.people import feature_columns, require

#: Texts that stand for a missing number.
MISSING = ("", "nan", "na", "n/a", "null", "none", "<na>")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, all columns as text; quoted line breaks survive, short rows end in nulls."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """A table of users: user_hash as text, features and label columns as numbers."""
    raw = require(read_text(spark, path), "user_hash")
    numbers = [*feature_columns(raw), *[c for c in ("high_conf_clean", "is_cheating") if c in raw.columns]]
    bare = lambda c: F.when(~F.lower(F.trim(c)).isin(*MISSING), F.col(c))
    return raw.withColumns({c: safe_float(bare(c)) for c in numbers})


def read_links(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A table of links, or None if there is none; without it the graph stage is left out."""
    if not path:
        return None
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return require(read_text(spark, path), "user_a", "user_b").select("user_a", "user_b")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """feature, type, range, missing_percent: a JSON map of features as rows."""
    entry = T.StructType([T.StructField("type", T.StringType()), T.StructField("range", T.StringType()), T.StructField("missing_%", T.DoubleType())])
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), entry))).alias("feature", "m"))
    return parsed.select("feature", "m.type", "m.range", F.col("m.`missing_%`").alias("missing_percent"))


def submission(scores: DataFrame, digits: int | None = 10) -> DataFrame:
    """user_hash, prediction as text with so many digits, or as it is."""
    value = F.format_string(f"%.{digits}f", F.col("prediction")) if digits is not None else F.col("prediction").cast("string")
    return scores.select("user_hash", value.alias("prediction"))


def write_submission(scores: DataFrame, path: str, digits: int | None = 10) -> None:
    submission(scores, digits).write.mode("overwrite").option("header", True).csv(path)


def violations(sub: DataFrame, test: DataFrame) -> DataFrame:
    """violation, n, examples: what is wrong with a result, no rows if nothing is; up to five examples in order.

    Checked: repeated ids, predictions that are no number in [0, 1], row count, missing and unknown ids. A null id is
    unknown.
    """
    require(sub, "user_hash", "prediction")
    expected = test.select("user_hash").filter("user_hash is not null").distinct()
    ids = sub.select("user_hash").filter("user_hash is not null")
    p = F.col("prediction")
    bad = {
        "duplicate id": ids.groupBy("user_hash").count().filter("count > 1").select("user_hash"),
        "bad prediction": sub.filter(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).select(F.coalesce("user_hash", F.lit("")).alias("user_hash")),
        "missing id": expected.join(ids, "user_hash", "left_anti"),
        "unknown id": sub.select(F.coalesce("user_hash", F.lit("")).alias("user_hash")).distinct().join(expected, "user_hash", "left_anti"),
    }

    def one(name: str, rows: DataFrame) -> DataFrame:
        some = rows.orderBy("user_hash").limit(5).agg(F.array_join(F.array_sort(F.collect_list("user_hash")), "|").alias("examples"))
        return rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(name).alias("violation"), "n", F.lit(0).alias("_")).join(some.withColumn("_", F.lit(0)), "_").drop("_")

    counts = sub.select(F.lit(1).alias("is_sub")).union(expected.select(F.lit(0))).agg(F.sum("is_sub").alias("n"), F.sum(1 - F.col("is_sub")).alias("m")).filter("n != m")
    wrong = counts.select(F.lit("row count").alias("violation"), F.col("n").cast("bigint").alias("n"), F.col("m").cast("string").alias("examples"))
    return reduce(DataFrame.unionByName, [one(name, rows) for name, rows in bad.items()]).unionByName(wrong)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """violation, n, examples: a header other than user_hash, prediction, and rows of fewer than two columns."""
    header = read_text(spark, path).columns
    wide = spark.read.schema("user_hash string, prediction string, _bad string").option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    short = wide.filter(F.col("_bad").isNotNull() & F.col("prediction").isNull() & ~F.coalesce(F.col("_bad").contains(","), F.lit(False))).select(F.coalesce("user_hash", F.lit("")).alias("user_hash"))
    some = F.array_join(F.slice(F.array_sort(F.collect_list("user_hash")), 1, 5), "|")
    rows = short.orderBy("user_hash").limit(5).agg(some.alias("examples")).withColumn("n", F.lit(short.count()).cast("bigint")).filter("n > 0").select(F.lit("short row").alias("violation"), "n", "examples")
    wrong = [("bad header", 1, "|".join(header))] if header != ["user_hash", "prediction"] else []
    return spark.createDataFrame(wrong, "violation string, n bigint, examples string").unionByName(rows)


def label_summary(train: DataFrame) -> DataFrame:
    """One row of counts: rows, labelled, cheaters, clean, unlabelled, flagged clean."""
    y = F.col("is_cheating")
    return train.agg(F.count(F.lit(1)).alias("n"), F.count_if(y.isNotNull()).alias("labelled"), F.count_if(y == 1.0).alias("cheaters"), F.count_if(y == 0.0).alias("clean"), F.count_if(y.isNull()).alias("unlabelled"), F.count_if(F.col("high_conf_clean") == 1.0).alias("flagged_clean"))
