"""Queries of the two general problems: orphan references and heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.keys import user_key, user_key_sql
from wardline.operators import heavy_keys, orphans
from wardline.sources.tables import table


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "social_graph", "edge_id", "user_a", "user_b", "observed_at")
    train = table(spark, sf, "train", "row_id", "user_hash", "observed_at")
    registry = table(spark, sf, "user_registry", "user_hash", "registered_at", "deleted_at")
    ends = links.select("edge_id", "observed_at", F.explode(F.array(F.struct(F.lit("user_a").alias("field"), user_key("user_a").alias("key")), F.struct(F.lit("user_b").alias("field"), user_key("user_b").alias("key")))).alias("e"))
    of_links = ends.select(F.lit("social_graph").alias("ref_table"), F.col("e.field").alias("ref_field"), F.col("edge_id").alias("ref_id"), F.col("e.key").alias("key"), F.col("observed_at").alias("at")).filter(F.col("key").isNotNull())
    refs = of_links.unionByName(orphans.references(train, "train", "user_hash", user_key("user_hash"), "row_id", "observed_at"))
    return orphans.orphans(refs, orphans.parents(registry, user_key("user_hash"), "registered_at", "deleted_at"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", "ref_field", "ref_id")


def p2_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, sf))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "social_graph", "edge_id", "user_a", "user_b", "observed_at")
    return heavy_keys.states_by_key(heavy_keys.endpoints(links, user_key("user_a"), user_key("user_b"), "observed_at", "edge_id"), "key", "partner", "observed_at", "edge_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "social_graph").count()
    return heavy_keys.heavy(_states(spark, sf), total).select(F.col("key").alias("user_key"))


def p5_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf).select(F.col("key").alias("user_key"), F.col("n").alias("degree"), F.col("n_distinct").alias("partners"), F.col("last_at").cast("timestamp_ntz").alias("last_observed_at"))


QUERIES = {f.__name__: f for f in (p2_found, p2_by_month, p5_found, p5_per_user)}

_REFS = f"""refs AS (
  SELECT 'social_graph' AS ref_table, 'user_a' AS ref_field, edge_id AS ref_id, {user_key_sql("user_a")} AS key, observed_at AS seen_at FROM social_graph
  UNION ALL SELECT 'social_graph', 'user_b', edge_id, {user_key_sql("user_b")}, observed_at FROM social_graph
  UNION ALL SELECT 'train', 'user_hash', row_id, {user_key_sql("user_hash")}, observed_at FROM train),
reg AS (SELECT {user_key_sql("user_hash")} AS key, registered_at, deleted_at FROM user_registry),
orphan AS (SELECT * FROM refs WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.key = refs.key
  AND reg.registered_at <= refs.seen_at AND (reg.deleted_at IS NULL OR reg.deleted_at > refs.seen_at)))"""
_ENDS = f"""ends AS (
  SELECT edge_id, {user_key_sql("user_a")} AS a, {user_key_sql("user_b")} AS b, observed_at FROM social_graph),
long AS (SELECT edge_id, a AS user_key, b AS partner, observed_at FROM ends WHERE a IS NOT NULL
  UNION ALL SELECT edge_id, b, a, observed_at FROM ends WHERE b IS NOT NULL AND b IS DISTINCT FROM a)"""

ORACLES = {
    "p2_found": f"WITH {_REFS} SELECT ref_table, ref_field, ref_id FROM orphan",
    "p2_by_month": f"WITH {_REFS} SELECT ref_table, ref_field, date_trunc('month', seen_at) AS period, count(*) AS orphans FROM orphan GROUP BY ALL",
    "p5_found": f"WITH {_ENDS} SELECT user_key FROM long GROUP BY user_key HAVING count(*) * 1000 >= 15 * (SELECT count(*) FROM social_graph)",
    "p5_per_user": f"WITH {_ENDS} SELECT user_key, count(*) AS degree, count(DISTINCT partner) AS partners, max(observed_at) AS last_observed_at FROM long GROUP BY user_key",
}
