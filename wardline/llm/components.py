"""Consolidating pairwise matches into groups (problem 3).

Union-find runs inside each partition of the links and keeps only a spanning forest, as stars: every key points to
the smallest key of its part. A key that several partitions hold gives links between their roots; all else about it
is settled by one pointer to its smallest root. The links between roots are a smaller graph of the same kind, which is
merged in the same way, in partitions of at most ``bound`` links, dealt by ranges of keys so that a root meets all its
links, until one such partition holds what is left. Then
the pointers are followed back. No partition ever holds more than ``bound`` links, whatever the size of the graph,
and a level at least drops the keys that are no roots.

Defined results: a link with one null key, and a link of a key with itself, makes its key a group of its own unless
other links join it; a link of two null keys makes nothing. Repeated and reversed links change nothing. The group's
name is its smallest key by character code. No links, no groups. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.operators.skew import lookup
from wardline.session import settle

#: Links that union-find takes into memory at once.
BOUND = 1_000_000


def _forest(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[pa.Array, pa.Array]:
    """All keys of the links, and for each the smallest key of its part."""
    names = pa.chunked_array([*a.chunks, *b.chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[names.indices.to_numpy()]
    u, v = code[: len(a)], code[len(a) :]
    root = np.arange(len(order))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        if not len(u):
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    keys = names.dictionary.take(order)
    return keys, keys.take(pa.array(root))


def _stars(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            links = pa.Table.from_batches(held)
            keys, roots = _forest(links.column(0), links.column(1))
            for at in range(0, len(keys), 65536):
                yield pa.record_batch([keys.slice(at, 65536), roots.slice(at, 65536)], names=["key", "root"])

        for batch in batches:
            if rows and rows + batch.num_rows > bound:
                yield from flush()
                held, rows = [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if rows:
            yield from flush()

    return run


def groups(links: DataFrame, bound: int = BOUND) -> DataFrame:
    """key, group_key for every key of the links (a, b); a null end stands for no key."""
    whole = links.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).filter(F.col("a").isNotNull())
    return _solve(whole, bound)


def _solve(links: DataFrame, bound: int) -> DataFrame:
    stars = links.mapInArrow(_stars(bound), "key string, root string")
    by_key = W.partitionBy("key").orderBy("root")
    seen = settle(stars.select("key", "root", F.first("root").over(by_key).alias("least"), F.row_number().over(by_key).alias("nth")))
    pointers = seen.filter("nth = 1").select("key", "least")
    between = settle(seen.filter("root != least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
    left = between.count()
    if not left:
        return pointers.select("key", F.col("least").alias("group_key"))
    if left <= bound:
        above = settle(between.coalesce(1).mapInArrow(_stars(bound), "key string, root string")).select(F.col("key").alias("least"), F.col("root").alias("name"))
    else:
        above = _solve(between.repartitionByRange(-(-left // bound), "a", "b"), bound).select(F.col("key").alias("least"), F.col("group_key").alias("name"))
    named = lookup(pointers, above, "least", "name")
    return named.select("key", F.coalesce("name", "least").alias("group_key"))
