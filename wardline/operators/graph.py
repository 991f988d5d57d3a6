"""Features of users from their links. Inputs: links both ways (u, v), labels (key, y), users (key).

Lookups of a neighbour's label or score go through ``lookup``, so rows that point at a hub spread evenly; groupings by
user combine before the shuffle. Users without links get 0 for counts and null for rates without a known neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import flag, ratio, total, zero
from wardline.operators import reach
from wardline.operators.skew import hot_list, lookup
from wardline.session import release, settle

#: Rounds of a loop after which its state is written down.
WRITTEN = 3
#: Links that a task contracts at once.
CONTRACTED = 1_000_000


def per_user(users: DataFrame, counts: DataFrame) -> DataFrame:
    """counts (by u) for every user; missing counts are 0, other columns null."""
    whole = [n for n, kind in counts.dtypes if kind in ("bigint", "int") and n != "u"]
    return users.join(counts.withColumnRenamed("u", "key"), "key", "left").fillna(0, whole)


def degrees(users: DataFrame, both: DataFrame) -> DataFrame:
    return per_user(users, both.groupBy("u").agg(F.count(F.lit(1)).alias("degree")))


def neighbour_counts(users: DataFrame, both: DataFrame, labels: DataFrame, hot: list | None = None) -> DataFrame:
    """degree, cheater, clean, labeled and unlabeled neighbours of every user."""
    seen = lookup(both, labels.select(F.col("key").alias("v"), "y"), "v", "y", hot)
    counts = seen.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("y") == 1).alias("cheater"), F.count_if(F.col("y") == 0).alias("clean"))
    return per_user(users, counts.select("u", "degree", "cheater", "clean", (F.col("cheater") + F.col("clean")).alias("labeled"), (F.col("degree") - F.col("cheater") - F.col("clean")).alias("unlabeled")))


def one_hop(users: DataFrame, both: DataFrame, labels: DataFrame, hot: list | None = None) -> DataFrame:
    """Neighbour counts with the rate of cheaters among the labelled, null without any."""
    n = neighbour_counts(users, both, labels, hot)
    return n.select("key", "degree", F.log1p(F.col("degree").cast("double")).alias("log_degree"), "cheater", "clean", "labeled", ratio(F.col("cheater"), F.col("labeled")).alias("cheat_rate"), (F.col("cheater") > 0).cast("int").alias("has_cheater"))


#: Features that without_fold gives.
FOLD_FEATURES = ["degree", "log_degree", "cheater", "clean", "labeled", "cheat_rate", "has_cheater"]


def counts_by_fold(users: DataFrame, both: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """degree, and cheater and clean neighbours of every user by the fold of the neighbour; labels: key, y, fold."""
    state = labels.select(F.col("key").alias("v"), F.struct("y", "fold").alias("s"))
    seen = lookup(both, state, "v", "s")
    of = lambda y, name: [F.count_if((F.col("s.y") == y) & (F.col("s.fold") == k)).alias(f"{name}_of_{k}") for k in range(folds)]
    return per_user(users, seen.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), *of(1, "cheater"), *of(0, "clean")))


def without_fold(k: int, folds: int) -> dict[str, Column]:
    """The neighbour features that a model of fold k may see: those of the other folds' labels."""
    cheater, clean = (total([F.col(f"{name}_of_{i}") for i in range(folds) if i != k]) for name in ("cheater", "clean"))
    return {"log_degree": F.log1p(F.col("degree").cast("double")), "cheater": cheater, "clean": clean, "labeled": cheater + clean, "cheat_rate": ratio(cheater, cheater + clean), "has_cheater": (cheater > 0).cast("int")}


def known_neighbours(users: DataFrame, both: DataFrame, labels: DataFrame, hot: list | None = None) -> DataFrame:
    """degree, known neighbours (labelled or passing for clean), cheaters among them and their share, 0 without any."""
    known = labels.select(F.col("key").alias("v"), F.when(F.col("weak"), 0).otherwise(F.col("y")).alias("y"))
    seen = lookup(both, known, "v", "y", hot)
    counts = seen.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0)).alias("cheat_sum"))
    return per_user(users, counts).withColumn("cheat_fraction", F.col("cheat_sum") / F.greatest(F.col("known"), F.lit(1)))


def second_pass(users: DataFrame, both: DataFrame, first: DataFrame, hot: list | None = None) -> DataFrame:
    """Mean cheat fraction and degree of the neighbours; those that are no users count as 0."""
    state = first.select(F.col("key").alias("v"), F.struct("cheat_fraction", "degree").alias("s"))
    seen = lookup(both, state, "v", "s", hot)
    sums = seen.groupBy("u").agg(F.count(F.lit(1)).alias("links"), F.coalesce(F.sum("s.cheat_fraction"), F.lit(0.0)).alias("f"), F.coalesce(F.sum("s.degree"), F.lit(0)).alias("d"))
    return per_user(users, sums).select("key", zero(ratio(F.col("f"), F.col("links"))).alias("mean_cheat_fraction"), zero(ratio(F.col("d"), F.col("links"))).alias("mean_degree"))


def neighbour_degrees(users: DataFrame, both: DataFrame, hot: list | None = None) -> DataFrame:
    """Mean, greatest and population deviation of the neighbours' degrees, 0 without neighbours."""
    degree = both.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    seen = lookup(both, degree, "v", "d", hot)
    stats = seen.groupBy("u").agg(F.avg("d").alias("m"), F.max("d").alias("neighbor_degree_max"), F.stddev_pop("d").alias("s"))
    return per_user(users, stats).select("key", zero(F.col("m")).alias("neighbor_degree_mean"), "neighbor_degree_max", zero(F.col("s")).alias("neighbor_degree_std"))


def base_rate(labels: DataFrame) -> float:
    """Share of cheaters among labelled users; one row comes to the driver."""
    return labels.filter(F.col("y").isNotNull()).agg(F.avg("y")).first()[0] or 0.0


def guilt(counts: DataFrame, base: float) -> DataFrame:
    """Features derived from neighbour counts; a pure projection. Equal features are computed once and named twice."""
    c, k, d, lab = (F.col(n).cast("double") for n in ("cheater", "clean", "degree", "labeled"))
    rate, some = ratio(c, lab), F.when(d > 0, d).otherwise(1.0)
    known_rate = F.coalesce(rate, F.lit(base))
    has, only = (c > 0).cast("int"), ((c > 0) & (k == 0)).cast("int")
    dominance = c / (c + k + 1)
    at_least = lambda n: (c >= n).cast("int")
    score = 0.6 * known_rate + 0.4 * F.least(F.greatest(c / some, F.lit(0.0)), F.lit(1.0))
    return counts.select(
        "*", rate.alias("cheat_rate_labeled"), F.when(d > 0, c / some).otherwise(0.0).alias("cheat_rate_all"), ratio(k, lab).alias("clean_rate_labeled"),
        (F.log1p(c) - F.log1p(k)).alias("cheater_clean_ratio"), has.alias("has_cheater"), at_least(2).alias("has_2plus"), at_least(3).alias("has_3plus"), at_least(5).alias("has_5plus"),
        flag(rate > 0.5).alias("rate_gt_50"), flag(rate > 0.75).alias("rate_gt_75"), only.alias("only_cheater_friends"), (k == 0).cast("int").alias("no_clean_friends"),
        (lab / some).alias("labeled_pct"), (d <= 1).cast("int").alias("is_isolated"), F.log1p(d).alias("log_degree"), dominance.alias("edge_dominance"),
        (0.5 * known_rate + 0.3 * (c / some) + 0.2 * dominance).alias("guilt_v1"), (0.4 * known_rate + 0.3 * has + 0.3 * only).alias("guilt_v2"), (F.log1p(c) / (F.log1p(d) + 0.1)).alias("guilt_v3"),
        (has + at_least(2) + flag(rate > 0.5) + only).alias("risk_tier"), flag((c >= 3) | (rate > 0.75)).alias("strong_signal"), ((c > 0) & (k == 0) & (lab > 0)).cast("int").alias("very_suspicious"),
        (c / (d + 1)).alias("cheater_density"), F.log1p(c).alias("log_cheaters"), (c - k).alias("cheater_minus_clean"), (c * F.coalesce(rate, F.lit(0.0))).alias("network_strength"),
        score.alias("guilt_score"), (has + (score > 0.5).cast("int") + (c > 2).cast("int")).alias("guilt_tier"),
    )


#: Linked pairs that a task may hold; the hops of larger graphs are found by joins.
HELD = 10_000_000
#: Nodes times links that a task is there for, and tasks for each core at most: each is sent all links.
SHARE, TASKS = 4_000_000_000, 2


def _numbered(one: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (key, id, y), the linked pairs (x = a << 32 | b, each once) by ids from 0, and how many nodes there are."""
    linked = settle(one.filter("u <= v"))
    keys = linked.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    nodes = settle(keys.select("key", F.monotonically_increasing_id().alias("id")).join(labels.select("key", "y"), "key", "left"))
    count, before = 0, []  # the ids of each task, one after the other
    for r in nodes.groupBy(F.shiftright("id", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():
        before += [F.lit(r["task"]), F.lit(count - (r["task"] << 33))]
        count += r["n"]
    if before:
        nodes = nodes.withColumn("id", F.col("id") + F.create_map(*before)[F.shiftright("id", 33)])
    once = linked.join(nodes.select(F.col("key").alias("u"), F.col("id").alias("a")), "u").join(nodes.select(F.col("key").alias("v"), F.col("id").alias("b")), "v")
    pairs = settle(once.select(F.shiftleft(F.least("a", "b"), 32).bitwiseOR(F.greatest("a", "b")).alias("x")))
    release(linked)
    return nodes, pairs, count


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of a batch in order, their first bytes, their second bytes and so on: what compresses well."""
    for batch in batches:
        x = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.record_batch([pa.array([x.view(np.uint8).reshape(-1, 8).T.tobytes()], pa.binary())], names=["x"])


def _unpacked(x: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _reach(nodes: DataFrame, pairs: DataFrame, n: int, links: int, far: int) -> DataFrame:
    """id and the counts of hops, all links in every task; a task seeks some of the nodes from all others."""
    parts = max(1, min(TASKS * nodes.sparkSession.sparkContext.defaultParallelism, n * links // SHARE))
    marks = nodes.filter("y is not null").select((-2 * F.col("id") - F.col("y") - 1).alias("x"))  # below 0, which no link is
    copies = pairs.union(marks).mapInArrow(_packed, "x binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    names = [f"{name}_{h}hop" for h in range(1, far + 1) for name in ("cheater", "clean", "other")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            held += map(_unpacked, batch.column(0))
            part = batch.column(1)[0].as_py() if batch.num_rows else part
        if part is None:
            return
        x = np.concatenate(held)
        held.clear()
        kinds, marked = np.full(n, 2, np.int8), -(x[x < 0] + 1)
        kinds[marked >> 1] = np.where(marked & 1, 0, 1)
        found = reach.counts(reach.Graph(n, x[x >= 0]), kinds, far, part, parts).reshape(3 * far, n)
        some = np.flatnonzero(found.any(axis=0))
        for i in range(0, len(some), 65_536):
            at = some[i : i + 65_536]
            yield pa.record_batch([pa.array(at, pa.int64()), *[pa.array(c[at].astype(np.int64)) for c in found]], names=["id", *names])

    got = copies.repartitionById(parts, "part").mapInArrow(count, "id bigint, " + ", ".join(f"{c} bigint" for c in names))
    return got.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])


def _joined(nodes: DataFrame, pairs: DataFrame, users: DataFrame, far: int) -> DataFrame:
    """The same by joins, deduplicated after each step: the pairs in reach are written, but no task holds the links."""
    ends = pairs.select(F.shiftright("x", 32).alias("a"), F.col("x").bitwiseAND((1 << 32) - 1).alias("b"))
    ids = settle(ends.union(ends.filter("a != b").select("b", "a")))
    own = settle(nodes.join(users, "key", "left_semi").select("id"))
    first = ids.join(own.select(F.col("id").alias("a")), "a", "left_semi")
    around = first.filter("a != b").select("a", "b")
    step = lambda pairs: pairs.join(ids.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).filter("a != b").distinct()
    second = step(around).join(first, ["a", "b"], "left_anti")
    second = settle(second) if far > 2 else second
    levels = [first, second]
    if far > 2:
        levels.append(step(second).join(second, ["a", "b"], "left_anti").join(first, ["a", "b"], "left_anti"))
    out, marks = own, nodes.select(F.col("id").alias("b"), "y")
    for hop, pairs in enumerate(levels, 1):
        of = {"cheater": F.col("y") == 1, "clean": F.col("y") == 0, "other": F.col("y").isNull()}
        seen = pairs.join(marks, "b").groupBy(F.col("a").alias("id")).agg(*[F.count_if(c).alias(f"{name}_{hop}hop") for name, c in of.items()])
        out = out.join(seen, "id", "left")
    return out.fillna(0)


def hops(users: DataFrame, one: DataFrame, labels: DataFrame, far: int = 3, held: int = HELD) -> DataFrame:
    """Exact counts of users reached in exactly 1, 2 and (far = 3) 3 steps from each user, and of cheaters among them.

    one: simple links. The pairs in reach, which hubs make many, are counted by bit maps (``reach``), where each task
    holds all links; with over ``held`` linked pairs they are made by joins instead. Both give the same rows.
    """
    nodes, pairs, n = _numbered(one, labels)
    links = pairs.count()
    got = _reach(nodes, pairs, n, links, far) if links <= held else _joined(nodes, pairs, users, far)
    each = [c for h in range(1, far + 1) for c in (total([F.col(f"{c}_{h}hop") for c in ("cheater", "clean", "other")]).alias(f"n_{h}hop"), f"cheater_{h}hop", f"clean_{h}hop")]
    found = users.join(nodes.select("key", "id").join(got, "id").select("key", *each), "key", "left")
    return found.fillna(0, [n for n in found.columns if n != "key"])


def hop_rates(counts: DataFrame, far: int = 3) -> DataFrame:
    """Rates per hop, null without labelled users there, their mean weighted over those there are, and the total reach."""
    weights = [0.6, 0.3, 0.1]
    rate = {h: ratio(F.col(f"cheater_{h}hop").cast("double"), (F.col(f"cheater_{h}hop") + F.col(f"clean_{h}hop")).cast("double")) for h in range(1, far + 1)}
    there = lambda h, value: F.when(rate[h].isNotNull(), value).otherwise(0.0)
    upper = sum((there(h, weights[h - 1] * rate[h]) for h in rate), F.lit(0.0))
    lower = sum((there(h, F.lit(weights[h - 1])) for h in rate), F.lit(0.0))
    reach = sum((F.col(f"cheater_{h}hop") for h in rate), F.lit(0))
    return counts.select("*", *[r.alias(f"rate_{h}hop") for h, r in rate.items()], F.try_divide(upper, lower).alias("combined_rate"), reach.cast("bigint").alias("cheater_reach"))


def clustering(users: DataFrame, one: DataFrame) -> DataFrame:
    """Triangles and the clustering coefficient of every user, exact; 0 with fewer than two other neighbours.

    Links are directed from the lower degree to the higher, so a node has few outgoing links, however large a hub is.
    """
    plain = settle(one.filter("u != v"))
    degree = plain.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    hot = hot_list(plain, "v")  # links stand both ways, so these are hot as u as well
    with_degrees = lookup(plain, degree.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v", "kv", hot)
    with_degrees = lookup(with_degrees, degree.withColumnRenamed("k", "ku"), "u", "ku", hot)
    out = settle(with_degrees.filter((F.col("ku") < F.col("kv")) | ((F.col("ku") == F.col("kv")) & (F.col("u") < F.col("v")))).select("u", "v"))
    wedge = out.alias("x").join(out.alias("y"), F.col("x.u") == F.col("y.u")).filter("x.v < y.v").select(F.col("x.u").alias("p"), F.col("x.v").alias("q"), F.col("y.v").alias("r"))
    closed = out.select(F.least("u", "v").alias("q"), F.greatest("u", "v").alias("r"))
    corners = wedge.join(closed, ["q", "r"]).select(F.explode(F.array("p", "q", "r")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("triangles"))
    found = users.join(degree.withColumnRenamed("u", "key"), "key", "left").join(corners.withColumnRenamed("u", "key"), "key", "left").fillna(0, ["k", "triangles"])
    return found.select("key", "triangles", F.when(F.col("k") > 1, 2.0 * F.col("triangles") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def _rounds(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """state, a settled table, after so many steps; every few it is written down, so that plans stay short and a lost
    executor costs those few. Steps between reuse each other's shuffles."""
    written = state
    for i in range(1, rounds + 1):
        state = step(state)
        if i % WRITTEN == 0 or i == rounds:
            state = settle(state)
            release(written)
            written = state
    return state


def label_propagation(users: DataFrame, one: DataFrame, labels: DataFrame, rounds: int = 15, alpha: float = 0.6, hot: list | None = None) -> DataFrame:
    """Scores of users: labelled ones mix their label with the mean of their neighbours, others take the mean.

    All move at once. Users without links keep their score; a neighbour that is no user scores 0.5.
    """
    mine = settle(one.join(users.select(F.col("key").alias("u")), "u", "left_semi"))
    start = settle(users.join(labels.select("key", "y"), "key", "left").select("key", "y", F.coalesce(F.col("y").cast("double"), F.lit(0.5)).alias("score")))
    hot = hot_list(mine, "v") if hot is None else hot

    def step(state: DataFrame) -> DataFrame:
        seen = lookup(mine, state.select(F.col("key").alias("v"), "score"), "v", "score", hot)
        mean = seen.groupBy(F.col("u").alias("key")).agg(F.avg(F.coalesce("score", F.lit(0.5))).alias("mean"))
        moved = F.when(F.col("y").isNotNull(), alpha * F.col("y") + (1 - alpha) * F.col("mean")).otherwise(F.col("mean"))
        return state.join(mean, "key", "left").select("key", "y", F.coalesce(moved, "score").alias("score"))

    return _rounds(start, step, rounds).select("key", "score")


def risk_propagation(users: DataFrame, one: DataFrame, labels: DataFrame, rounds: int = 25, damping: float = 0.85, hot: list | None = None) -> DataFrame:
    """Risk that flows from cheaters along links, shared among a neighbour's links, scaled to a greatest value of 1
    after each round. Neighbours that are no users give none; users without links keep theirs."""
    one = settle(one)
    degree = one.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    mine = settle(one.join(users.select(F.col("key").alias("u")), "u", "left_semi"))
    start = users.join(labels.select("key", "y"), "key", "left").join(degree.withColumnRenamed("u", "key"), "key", "left")
    start = settle(start.select("key", "degree", (F.coalesce("y", F.lit(0)) == 1).alias("cheater"), F.when(F.col("y") == 1, 1.0).otherwise(0.0).alias("risk")))
    hot = hot_list(mine, "v") if hot is None else hot

    def step(state: DataFrame) -> DataFrame:
        share = state.filter("degree is not null").select(F.col("key").alias("v"), (F.col("risk") / F.col("degree")).alias("share"))
        coming = lookup(mine, share, "v", "share", hot).groupBy(F.col("u").alias("key")).agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("coming"))
        moved = F.when(F.col("cheater"), 0.5 + 0.5 * damping * F.col("coming")).otherwise(damping * F.col("coming"))
        return state.join(coming, "key", "left").select("key", "degree", "cheater", F.coalesce(moved, "risk").alias("risk"))

    state = kept = start
    for _ in range(rounds):
        after = settle(step(state))
        release(kept)
        kept, most = after, after.agg(F.max("risk")).first()[0]
        state = kept.withColumn("risk", F.col("risk") / most) if most and most > 0 else kept
    return state.select("key", "risk")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every node of a task's links the least node that they join it with; in turns of CONTRACTED links."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in held]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        a, b = np.split(place[ends.indices.to_numpy()], 2)
        least = np.arange(len(order))
        while True:
            low = np.minimum(least[a], least[b])
            before = least.copy()
            for end in (a, b):
                np.minimum.at(least, least[end], low)
                np.minimum.at(least, end, low)
            least = least[least]
            if np.array_equal(least, before):
                names = ends.dictionary.take(order)
                return pa.record_batch([names, names.take(pa.array(least))], names=["key", "least"])

    held, rows = [], 0
    for batch in batches:
        held += [batch] if batch.num_rows else []
        rows += batch.num_rows
        if rows >= CONTRACTED:
            yield joined(held)
            held, rows = [], 0
    if rows:
        yield joined(held)


def components(nodes: DataFrame, one: DataFrame, held: int = CONTRACTED) -> DataFrame:
    """key, component: the smallest key each node is linked with, directly or through others.

    First every task joins the nodes of its own links to the least of their part; a node that several tasks know links
    their parts, and only these few links are left. If one task can hold them it joins them at once. Otherwise every
    round each part takes the smallest label around it, whole groups move to the smallest label that any member saw, and
    labels jump to their label's label; groups at least halve, so rounds grow with the logarithm of chains.
    """
    parts = settle(one.filter("u < v").mapInArrow(_contract, "key string, least string"))
    first = parts.groupBy("key").agg(F.min("least").alias("part"))
    apart = parts.join(first, "key").filter("least != part").select(F.col("least").alias("a"), F.col("part").alias("b")).distinct()
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    apart = settle(apart)
    if apart.count() <= held:
        named = settle(apart.coalesce(1).mapInArrow(_contract, "key string, label string"))
    else:
        named = _hooked(settle(apart.select(F.explode(ways).alias("e")).select("e.u", "e.v")))
    mine = nodes.join(first, "key", "left").select("key", F.coalesce("part", "key").alias("part"))
    found = lookup(mine, named.select(F.col("key").alias("part"), "label"), "part", "label")
    return found.select("key", F.coalesce("label", "part").alias("component"))


def _hooked(links: DataFrame) -> DataFrame:
    """key, label: the smallest node linked with each node of the links, a settled table of both directions."""
    state = settle(links.select(F.col("u").alias("key")).distinct().select("key", F.col("key").alias("label")))
    hot = hot_list(links, "v")
    while True:
        seen = lookup(links, state.select(F.col("key").alias("v"), F.col("label").alias("seen")), "v", "seen", hot)
        around = seen.groupBy(F.col("u").alias("key")).agg(F.min("seen").alias("seen"))
        least = settle(state.join(around, "key", "left").select("key", "label", F.least("label", "seen").alias("least")))
        hooks = least.groupBy("label").agg(F.min("least").alias("hook"), F.count(F.lit(1)).alias("n"))
        large = [r["label"] for r in hooks.filter("n >= 1000").orderBy(F.desc("n")).limit(256).collect()]
        moved = settle(lookup(least, hooks, "label", "hook", large).select("key", "label", F.least("least", "hook").alias("next")))
        parents = moved.select(F.col("key").alias("next"), F.col("next").alias("up"))
        jumped = settle(lookup(moved, parents, "next", "up").select("key", "label", F.coalesce("up", "next").alias("next")))
        changed = not jumped.filter("label != next").isEmpty()
        for done in (state, least, moved):
            release(done)
        state = jumped.select("key", F.col("next").alias("label"))
        if not changed:
            return state


def component_stats(parts: DataFrame, users: DataFrame, labels: DataFrame) -> DataFrame:
    """Size of each user's component over all nodes, its logarithm, and the cheat rate among labelled users in it."""
    parts = settle(parts)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    marked = users.join(parts, "key").join(labels.select("key", "y"), "key", "left")
    rates = marked.groupBy("component").agg(F.avg("y").alias("component_cheat_rate"))
    both = sizes.join(rates, "component", "left").select("component", F.struct("component_size", "component_cheat_rate").alias("s"))
    seen = lookup(users.join(parts, "key"), both, "component", "s")
    return seen.select("key", "component", "s.component_size", F.log1p(F.col("s.component_size").cast("double")).alias("log_component_size"), "s.component_cheat_rate")


def communities(nodes: DataFrame, one: DataFrame, rounds: int = 8) -> DataFrame:
    """key, community: the label most frequent among the neighbours, the smallest of equals, after so many rounds in
    which all nodes move at once. Stands in for modularity search, which has no deterministic parallel form."""
    links = settle(one.filter("u != v"))
    hot = hot_list(links, "v")
    start = settle(nodes.select("key", F.col("key").alias("label")))

    def step(state: DataFrame) -> DataFrame:
        seen = lookup(links, state.select(F.col("key").alias("v"), F.col("label").alias("seen")), "v", "seen", hot)
        votes = seen.groupBy("u", "seen").agg(F.count(F.lit(1)).alias("n"))
        most = votes.groupBy(F.col("u").alias("key")).agg(F.min(F.struct(-F.col("n"), F.col("seen"))).alias("m")).select("key", F.col("m.seen").alias("seen"))
        return state.join(most, "key", "left").select("key", F.coalesce("seen", "label").alias("label"))

    return _rounds(start, step, rounds).select("key", F.col("label").alias("community"))


def degree_centrality(users: DataFrame, one: DataFrame) -> DataFrame:
    """Degree among all other nodes, where nodes are all linked keys and all users."""
    n = one.select(F.col("u").alias("key")).union(users.select("key")).distinct().count()
    return degrees(users, one).select("key", (F.col("degree") / F.lit(float(max(n - 1, 1)))).alias("centrality"))


def edges_to_classes(users: DataFrame, both: DataFrame, labels: DataFrame) -> DataFrame:
    """Links of each user to cheaters and to clean users; the links are read once."""
    seen = lookup(both, labels.select(F.col("key").alias("v"), "y"), "v", "y")
    counts = seen.groupBy("u").agg(F.count_if(F.col("y") == 1).alias("edges_to_cheaters"), F.count_if(F.col("y") == 0).alias("edges_to_clean"))
    return per_user(users, counts)
