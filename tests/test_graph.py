import pytest
from pyspark.sql import functions as F

from wardline.operators import graph, people


@pytest.fixture(scope="module")
def small(spark):
    """A triangle a-b-c with a tail c-d-e, a link of f with itself, a repeated and a reversed link, an outsider x, a loner g."""
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("x", "f"), (None, "a")], "user_a string, user_b string")
    users = spark.createDataFrame([(k,) for k in "abcdefg"], "key string")
    labels = spark.createDataFrame([("a", 1, False), ("b", 0, False), ("d", None, True), ("e", 1, False)], "key string, y int, weak boolean")
    pairs = people.links(links)
    return users, labels, people.both_ways(pairs), people.simple(pairs)


def by_key(df, *columns):
    return {r["key"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_degrees(small):
    users, _, both, one = small
    assert by_key(graph.degrees(users, both), "degree") == {"a": 4, "b": 4, "c": 3, "d": 2, "e": 1, "f": 3, "g": 0}
    assert by_key(graph.degrees(users, one), "degree") == {"a": 2, "b": 2, "c": 3, "d": 2, "e": 1, "f": 2, "g": 0}


def test_neighbours(small):
    users, labels, both, one = small
    got = by_key(graph.one_hop(users, one, labels), "cheater", "clean", "cheat_rate")
    assert got["c"] == (1, 1, 0.5) and got["g"] == (0, 0, None) and got["f"] == (0, 0, None)
    known = by_key(graph.known_neighbours(users, both, labels), "known", "cheat_sum", "cheat_fraction")
    assert known["c"] == (3, 1, pytest.approx(1 / 3)) and known["e"] == (1, 0, 0.0) and known["g"] == (0, 0, 0.0)


def test_hops_are_disjoint(small):
    users, labels, _, one = small
    got = by_key(graph.hops(users, one, labels, 3), "n_1hop", "n_2hop", "n_3hop")
    assert got["a"] == (2, 1, 1) and got["e"] == (1, 1, 2) and got["f"] == (2, 0, 0) and got["g"] == (0, 0, 0)
    assert by_key(graph.hop_rates(graph.hops(users, one, labels, 3)), "combined_rate")["g"] is None


def test_clustering(small):
    users, _, _, one = small
    got = by_key(graph.clustering(users, one), "triangles", "clustering")
    assert got["a"] == (1, 1.0) and got["c"] == (1, pytest.approx(1 / 3)) and got["f"] == (0, 0.0)


def test_components(small):
    users, labels, _, one = small
    nodes = users.union(one.select(F.col("u").alias("key"))).distinct()
    parts = graph.components(nodes, one)
    for held in (0, graph.CONTRACTED):  # by rounds, and at once
        spread = one.repartition(3, "v")
        assert by_key(graph.components(nodes, spread, held), "component") == by_key(parts, "component")
    assert by_key(parts, "component") == dict.fromkeys("abcde", "a") | {"f": "f", "x": "f", "g": "g"}
    assert by_key(graph.component_stats(parts, users, labels), "component_size", "component_cheat_rate")["c"] == (5, pytest.approx(2 / 3))


def test_propagation(small):
    users, labels, _, one = small
    score = by_key(graph.label_propagation(users, one, labels, rounds=2), "score")
    assert score["g"] == 0.5 and all(0 <= s <= 1 for s in score.values())
    risk = by_key(graph.risk_propagation(users, one, labels, rounds=3), "risk")
    assert max(risk.values()) == 1.0 and risk["g"] == 0.0


def test_no_links(small):
    users, labels, both, one = small
    assert set(by_key(graph.degrees(users, both.limit(0)), "degree").values()) == {0}
    assert set(by_key(graph.clustering(users, one.limit(0)), "clustering").values()) == {0.0}


def test_long_chain_over_tasks(spark):
    """Links of a chain in many tasks: their parts are joined by rounds and at once alike."""
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(120)], "a string, b string").repartition(6)
    one = people.simple(links)
    nodes = one.select(F.col("u").alias("key")).distinct()
    for held in (0, graph.CONTRACTED):
        assert set(by_key(graph.components(nodes, one, held), "component").values()) == {"000"}


def test_folds_hide_their_labels(small):
    users, labels, _, one = small
    marked = labels.withColumn("fold", F.when(F.col("key") == "a", 0).otherwise(1)).select("key", "y", "fold")
    counts = graph.counts_by_fold(users, one, marked, 2)
    assert by_key(counts.withColumns(graph.without_fold(0, 2)), "degree", "cheater", "clean")["c"] == (3, 0, 1)
    assert by_key(counts.withColumns(graph.without_fold(1, 2)), "degree", "cheater", "clean")["c"] == (3, 1, 0)
