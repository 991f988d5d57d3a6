"""Results per key where a few keys hold most rows (problem 5).

Rows are range partitioned on (key, secondary order) with sampled quantiles, so a heavy key spreads over as many
partitions as its share of the rows asks for. Each sorted partition is folded, batch by batch, into one partial state
per key; the states of a key that crosses partition boundaries are stitched by their first and last secondary value.
A task's work depends on the number of rows only, however they spread over keys.

Defined results: rows with a null key are left out. A null secondary value counts as a row but not as a distinct
value; a null time is ignored unless a key has no other. Ties and repeated rows count each. No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import shuffle_width

_STATES = "key string, part int, n bigint, n_distinct bigint, first_value string, last_value string, last_at timestamp, open boolean"
_NEVER = np.iinfo(np.int64).min


def endpoints(edges: DataFrame, a: Column, b: Column, *others: str) -> DataFrame:
    """One row per edge and key: key, partner, others. An edge of a key with itself gives one row, null keys none."""
    ends = edges.select(a.alias("_a"), b.alias("_b"), *others)
    both = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.array(F.struct(F.col("_a").alias("key"), F.col("_b").alias("partner")))).otherwise(F.array(F.struct(F.col("_a").alias("key"), F.col("_b").alias("partner")), F.struct(F.col("_b").alias("key"), F.col("_a").alias("partner"))))
    rows = ends.select(F.explode(both).alias("end"), *others)
    return rows.select("end.key", "end.partner", *others).filter(F.col("key").isNotNull())


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of the keys of one sorted partition; only a key that may go on elsewhere is left open."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("n_distinct", pa.int64()), ("first_value", pa.string()), ("last_value", pa.string()), ("last_at", pa.timestamp("us", "UTC")), ("open", pa.bool_())])
    carry: list | None = None  # key, n, distinct, first, last, at, first key of the partition
    first = True

    def out(rows: list[tuple]) -> pa.RecordBatch:
        keys, n, distinct, lo, hi, at, opened = zip(*rows, strict=True)
        return pa.record_batch([pa.array(keys, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(n, pa.int64()), pa.array(distinct, pa.int64()), pa.array(lo, pa.string()), pa.array(hi, pa.string()), pa.array([None if x == _NEVER else x for x in at], pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(opened, pa.bool_())], schema=schema)

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        key, value = batch.column(0), batch.column(1)
        at = batch.column(2).cast(pa.int64()).fill_null(_NEVER).to_numpy(zero_copy_only=False)
        there = value.is_valid().to_numpy(zero_copy_only=False)
        new_key = np.ones(size, bool)
        new_key[1:] = pc.not_equal(key.slice(1), key.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        filled = value.fill_null("")
        new_value = there.copy()
        new_value[1:] &= pc.not_equal(filled.slice(1), filled.slice(0, size - 1)).to_numpy(zero_copy_only=False) | new_key[1:] | ~there[:-1]
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], size)
        n = ends - starts
        distinct = np.add.reduceat(new_value.astype(np.int64), starts)
        latest = np.maximum.reduceat(at, starts)
        keys, lo, hi = key.take(pa.array(starts)).to_pylist(), value.take(pa.array(starts)).to_pylist(), value.take(pa.array(ends - 1)).to_pylist()
        rows = []
        for i in range(len(starts)):
            if carry and carry[0] == keys[i]:
                same = carry[4] is not None and carry[4] == lo[i]
                carry = [keys[i], carry[1] + int(n[i]), carry[2] + int(distinct[i]) - same, carry[3], hi[i], max(carry[5], int(latest[i])), carry[6]]
            else:
                if carry:
                    rows.append(tuple(carry))
                carry = [keys[i], int(n[i]), int(distinct[i]), lo[i], hi[i], int(latest[i]), first]
                first = False
        if rows:
            yield out(rows)
    if carry:
        yield out([(*carry[:6], True)])


def states_by_key(rows: DataFrame, key: str, order: str, at: str, tiebreak: str) -> DataFrame:
    """Per key: n (rows), n_distinct (distinct non-null values of order), last_at (latest time).

    tiebreak orders rows that agree in key and order, so that even one repeated pair may spread.
    """
    long = rows.select(F.col(key).alias("key"), F.col(order).cast("string").alias("value"), F.col(at).alias("at"), F.col(tiebreak).alias("tie")).filter(F.col("key").isNotNull())
    ranged = long.repartitionByRange(shuffle_width(rows.sparkSession), "key", "value", "tie").sortWithinPartitions("key", "value").select("key", "value", F.col("at").cast("timestamp"))
    partial = ranged.mapInArrow(_fold, _STATES)
    bounds = F.collect_list(F.when(F.col("open"), F.struct("part", "first_value", "last_value")))
    merged = partial.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("d"), F.max("last_at").alias("last_at"), F.array_sort(bounds).alias("b"))
    repeated = F.expr("size(filter(sequence(1, greatest(size(b) - 1, 1)), i -> i < size(b) and b[i].first_value = b[i - 1].last_value))")
    return merged.select("key", "n", (F.col("d") - repeated).alias("n_distinct"), "last_at")


def heavy(states: DataFrame, total: int, share_per_mille: int = 15) -> DataFrame:
    """Keys of the states that hold at least the share of all rows; compared in whole numbers."""
    return states.filter(F.col("n") * 1000 >= F.lit(total) * share_per_mille)
