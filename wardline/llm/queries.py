"""Queries of the llm problems and the SQL that checks them."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.keys import user_key, user_key_sql
from wardline.llm import components, leak, overlap, quantiles, reading, tokens
from wardline.sources.tables import table


def _keyed(spark: SparkSession, sf: str, name: str, *more: str) -> DataFrame:
    return table(spark, sf, name, "row_id", "user_hash", *more).select("row_id", user_key("user_hash").alias("text"), *more).filter(F.col("text").isNotNull())


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _keyed(spark, sf, "train"), _keyed(spark, sf, "test")
    return overlap.row_pairs(overlap.matches(train, test), train, test, "text", "row_id").select("train_row_id", "test_row_id")


def p1_by_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _keyed(spark, sf, "train", "source"), _keyed(spark, sf, "test", "eval_split", "source")
    return overlap.overlap_counts(overlap.matches(train, test), train, test, "text", ["source"], ["eval_split", "source"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "social_graph", "user_a", "user_b").select(user_key("user_a").alias("a"), user_key("user_b").alias("b"))
    return components.groups(links).select(F.col("key").alias("user_key"), "group_key")


def p3_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return p3_found(spark, sf).groupBy("group_key").agg(F.count(F.lit(1)).alias("users"))


FEATURES = ["feature_001", "feature_010", "feature_015"]
SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    train = table(spark, sf, "train", "source", "observed_at", *FEATURES).withColumn("day", F.to_date("observed_at"))
    return quantiles.sketch(train, ["source", "day"], FEATURES)


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """By source and month, from the sketches of the days. Values under a half keep all digits, for the error is relative."""
    by = ["source", "month"]
    monthly = quantiles.merge(_daily(spark, sf).withColumn("month", F.trunc("day", "month")), by)
    got = quantiles.percentiles(monthly, by, SHARES)
    return got.withColumns({"value": F.when(F.abs("value") < 0.5, F.col("value")).otherwise(F.round("value", 6)), "relative_error": F.lit(quantiles.ERROR)})


def p4_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The sketches of the days, as they would be stored."""
    return _daily(spark, sf)


#: Folder of the public vocabularies; a parameter of the deployment.
TOKENIZERS = os.environ.get("WARDLINE_TOKENIZERS", "/opt/tokenizers")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf, "eval_items", "item_id", "passage"), "item_id", "passage")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


def p7_by_item(spark: SparkSession, sf: str) -> DataFrame:
    """Per passage that leaked: how many documents hold it, and the largest share of its words."""
    return _leaks(spark, sf).groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("documents"), F.max(F.col("covered") / F.col("item_words")).alias("largest_share"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    docs, samples = table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "graded_samples", "text", "band")
    wording = reading.learn_wording(docs, "doc_id", "text", samples, "text", "band")
    return reading.levels(docs, "doc_id", "text", reading.fit(samples, "text", "band"), wording)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "band")


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    """What the bands rest on: measures, the ranker's score and level, and whether the exact check decided."""
    return _levels(spark, sf)


QUERIES = {f.__name__: f for f in (p1_found, p1_by_split, p3_found, p3_sizes, p4_percentiles, p4_sketch, p6_ids, p7_found, p7_by_item, p8_found, p8_levels)}

_PAIRS = f"""a AS (SELECT row_id, source, {user_key_sql("user_hash")} AS k FROM train),
b AS (SELECT row_id, source, eval_split, {user_key_sql("user_hash")} AS k FROM test),
ka AS (SELECT DISTINCT k FROM a WHERE k IS NOT NULL), kb AS (SELECT DISTINCT k FROM b WHERE k IS NOT NULL),
near AS (SELECT ka.k AS x, kb.k AS y, levenshtein(ka.k, kb.k) AS d FROM ka JOIN kb ON abs(length(ka.k) - length(kb.k)) <= 2 WHERE levenshtein(ka.k, kb.k) <= 2)"""
_GROUPS = f"""e AS (SELECT {user_key_sql("user_a")} AS a, {user_key_sql("user_b")} AS b FROM social_graph),
l AS (SELECT DISTINCT coalesce(a, b) AS a, coalesce(b, a) AS b FROM e WHERE coalesce(a, b) IS NOT NULL),
s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT a AS v, min(least(a, b)) AS g FROM s GROUP BY a),
r(v, g) USING KEY (v) AS (SELECT v, g FROM c UNION
  SELECT s.a, min(n.g) FROM r AS n JOIN s ON s.b = n.v JOIN recurring.r AS o ON o.v = s.a WHERE n.g < o.g GROUP BY s.a)"""
_LOG = repr(math.log(quantiles.gamma()))
_BUCKETS = " UNION ALL ".join(f"SELECT source, CAST(observed_at AS DATE) AS day, '{f}' AS feature, CAST(nullif(CAST({f} AS VARCHAR), 'nan') AS DOUBLE) AS x FROM train" for f in FEATURES)
_SKETCH = f"""v AS ({_BUCKETS}),
d AS (SELECT source, day, feature, TRY_CAST(sign(x) AS INT) AS bucket_sign,
  CASE WHEN isinf(x) THEN {quantiles.BEYOND} WHEN x = 0 THEN 0 ELSE TRY_CAST(ceil(ln(abs(x)) / {_LOG}) AS INT) END AS bucket, count(x) AS n FROM v WHERE x IS NOT NULL GROUP BY ALL)"""
_G = repr(quantiles.gamma())

ORACLES = {
    "p1_found": f"WITH {_PAIRS} SELECT a.row_id AS train_row_id, b.row_id AS test_row_id FROM near JOIN a ON a.k = x JOIN b ON b.k = y",
    "p1_by_split": f"""WITH {_PAIRS} SELECT b.eval_split AS test_eval_split, b.source AS test_source, a.source AS train_source, count(*) AS pairs,
        CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS exact_pairs FROM near JOIN a ON a.k = x JOIN b ON b.k = y GROUP BY ALL""",
    "p3_found": f"WITH RECURSIVE {_GROUPS} SELECT v AS user_key, g AS group_key FROM r",
    "p3_sizes": f"WITH RECURSIVE {_GROUPS} SELECT g AS group_key, count(*) AS users FROM r GROUP BY g",
    "p4_sketch": f"WITH {_SKETCH} SELECT * FROM d",
    "p4_percentiles": f"""WITH {_SKETCH}, m AS (SELECT source, CAST(date_trunc('month', day) AS DATE) AS month, feature, bucket_sign, bucket, sum(n) AS n FROM d GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY source, month, feature) AS total,
  sum(n) OVER (PARTITION BY source, month, feature ORDER BY bucket_sign, bucket_sign * bucket) AS upto FROM m),
p AS (SELECT *, floor(q * (total - 1)) AS rank FROM t, (SELECT unnest({SHARES}) AS q))
SELECT source, month, feature, CAST(q AS DOUBLE) AS q, CAST(total AS BIGINT) AS n,
  round(CASE WHEN bucket_sign = 0 THEN 0.0 WHEN bucket = {quantiles.BEYOND} THEN bucket_sign * CAST('inf' AS DOUBLE) ELSE bucket_sign * (2 / ({_G} + 1)) * pow({_G}, bucket) END, 6) AS value,
  CAST({quantiles.ERROR} AS DOUBLE) AS relative_error FROM p WHERE rank < upto AND rank >= upto - n""",
}
