"""References to records that do not exist (problem 2).

References and parents are put into one long form, tagged, and grouped by key. A group says whether the key has a
parent at all and during which spans; keys whose parents cover every reference need no look at single rows. Only the
references of the other keys are looked up row by row, those of hot keys through a bounded broadcast. Keys with more
than ``SPANS`` distinct spans go another way, in which nothing is gathered per key: their references and spans are put
in order by time within days, and the latest end seen so far, on that day and before it, decides.

Defined results: a null or empty key refers to nothing and is never reported. A reference without a time is satisfied
by no parent, as no parent can be shown to have existed then. A parent without a start time covers nothing. Repeated
parent rows count once. An empty parent table makes every reference an orphan; without references nothing comes out.
Columns beyond the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.skew import hot_list
from wardline.session import settle

#: Joins that are given no more than this many hot keys broadcast them.
HOT_KEYS = 256
#: Distinct spans of a key that are gathered in one array.
SPANS = 1024


def references(df: DataFrame, table: str, field: str, key: Column, ident: str, at: str) -> DataFrame:
    """Tagged references: ref_table, ref_field, ref_id, key, at. Rows with a null key are left out."""
    return df.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(ident).cast("bigint").alias("ref_id"), key.alias("key"), F.col(at).alias("at")).filter(F.col("key").isNotNull())


def parents(df: DataFrame, key: Column, since: str, until: str) -> DataFrame:
    """Spans in which a parent exists: key, since, until (null: still there). Repeated rows come once."""
    return df.select(key.alias("key"), F.col(since).alias("since"), F.col(until).alias("until")).filter(F.col("key").isNotNull() & F.col("since").isNotNull()).distinct()


def _covers(at: Column, spans: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: (s["since"] <= at) & (s["until"].isNull() | (s["until"] > at))), F.lit(False))


def key_states(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per referred key that some reference may miss: key, spans (null: no parent at all).

    The long form of both sides is combined before the shuffle: a key's references shrink to their first and last
    time, so a key with a third of all references sends one row per map task.
    """
    child = refs.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max(F.col("at").isNull()).alias("undated"))
    parent = spans.groupBy("key").agg(F.collect_set(F.struct("since", "until")).alias("spans"))
    none = lambda kind: F.lit(None).cast(kind)
    time = dict(refs.dtypes)["at"]
    tagged = child.select("key", "first", "last", "undated", none(parent.schema["spans"].dataType).alias("spans")).unionByName(parent.select("key", none(time).alias("first"), none(time).alias("last"), none("boolean").alias("undated"), "spans"))
    grouped = tagged.groupBy("key").agg(F.max("first").alias("first"), F.max("last").alias("last"), F.max("undated").alias("undated"), F.first("spans", ignorenulls=True).alias("spans"))
    covered = F.exists("spans", lambda s: (s["since"] <= F.col("first")) & (s["until"].isNull() | (s["until"] > F.col("last")))) & ~F.col("undated")
    return grouped.filter(F.col("undated").isNotNull() & ~F.coalesce(covered, F.lit(False))).select("key", "spans")


def _by_spans(refs: DataFrame, spans: DataFrame) -> DataFrame:
    states = key_states(refs, spans)
    # a list, evaluated once: a key that were hot for its references but not for its state would meet nothing
    is_hot = F.col("key").isin(hot_list(refs, "key", HOT_KEYS))
    at_hot = refs.filter(is_hot).join(F.broadcast(states.filter(is_hot)), "key")
    at_rest = refs.filter(~is_hot).join(states.filter(~is_hot), "key")
    return reduce(DataFrame.unionByName, [at_hot, at_rest]).filter(~_covers(F.col("at"), F.col("spans"))).drop("spans")


def _by_time(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """A reference is covered if the latest end of all spans begun by then lies after it."""
    kept = [c for c in refs.columns if c not in ("key", "at")]
    payload = F.struct(*kept)
    end = F.coalesce("until", F.lit("9999-12-31").cast(dict(spans.dtypes)["until"])).alias("_end")
    none = F.lit(None).cast(spans.schema["until"].dataType).alias("_end")
    events = refs.select("key", "at", F.lit(1).alias("_is_ref"), none, payload.alias("_row")).unionByName(spans.select("key", F.col("since").alias("at"), F.lit(0).alias("_is_ref"), end, F.lit(None).cast(refs.select(payload.alias("p")).schema["p"].dataType).alias("_row")))
    events = events.withColumn("_day", F.date_trunc("day", "at"))
    days = events.groupBy("key", "_day").agg(F.max("_end").alias("_top"))
    before = days.select("key", "_day", F.max("_top").over(W.partitionBy("key").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    so_far = W.partitionBy("key", "_day").orderBy("at", "_is_ref").rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumn("_so_far", F.max("_end").over(so_far)).filter("_is_ref = 1").join(before, ["key", "_day"], "left")
    covered = F.coalesce(F.greatest("_so_far", "_before") > F.col("at"), F.lit(False))
    return seen.filter(~covered).select(*[F.col("_row")[c].alias(c) if c in kept else F.col(c) for c in refs.columns])


def orphans(refs: DataFrame, spans: DataFrame, most: int = SPANS) -> DataFrame:
    """The references whose key had no parent at their time, with all columns of refs."""
    crowded = settle(spans.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key"))
    if crowded.isEmpty():
        return _by_spans(refs, spans)
    part = lambda df, how: df.join(crowded, "key", how)
    plain = _by_spans(part(refs, "left_anti"), part(spans, "left_anti"))
    return plain.unionByName(_by_time(part(refs, "left_semi"), part(spans, "left_semi")))


def orphan_counts(found: DataFrame, period: str = "month") -> DataFrame:
    """Orphans by table, field and period of their time; undated ones have a null period."""
    return found.groupBy("ref_table", "ref_field", F.date_trunc(period, "at").alias("period")).agg(F.count(F.lit(1)).alias("orphans"))
