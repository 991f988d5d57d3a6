import numpy as np
import pytest

from wardline.operators import graph, people, reach


def searched(links, kinds, far):
    """counts by breadth-first search."""
    beside = {a: set() for a in range(len(kinds))}
    for a, b in links:
        beside[a].add(b)
        beside[b].add(a)
    out = np.zeros((far, 3, len(kinds)), int)
    for a in beside:
        for b in beside[a]:
            out[0, kinds[b], a] += 1
        seen, last = {a} | beside[a], beside[a] - {a}
        for h in range(1, far):
            last = {c for b in last for c in beside[b]} - seen
            seen |= last
            for b in last:
                out[h, kinds[b], a] += 1
    return out


def drawn(seed, n, m):
    """Links of which half end at few nodes, some of a node with itself, and kinds."""
    draw = np.random.default_rng(seed)
    ends = np.where(draw.random(m) < 0.5, np.minimum(draw.zipf(1.4, m) - 1, n - 1), draw.integers(0, n, m)), draw.integers(0, n, m)
    return sorted({(int(min(x)), int(max(x))) for x in zip(*ends, strict=True)}), draw.integers(0, 3, n)


@pytest.mark.parametrize("far", [2, 3])
def test_counts_are_those_of_a_search(far):
    for seed in range(12):
        links, kinds = drawn(seed, 150, seed * 25)
        held = reach.Graph(150, np.array([a << 32 | b for a, b in links], np.int64))
        want = searched(links, kinds, far)
        for width, shared, parts, size in ((64, 1, 1, 1), (64, 8, 3, 1), (2048, 8, 2, 1), (2048, 256, 2, reach.BYTES)):
            assert (sum(reach.counts(held, kinds, far, p, parts, width, shared, size) for p in range(parts)) == want).all()


@pytest.mark.parametrize("held", [0, graph.HELD])
def test_hops_of_both_ways_are_those_of_a_search(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "SHARE", 5_000)  # several tasks
    links, kinds = drawn(3, 120, 200)
    want = searched(links, kinds, 3)
    one = people.simple(spark.createDataFrame([(f"u{a}", f"u{b}") for a, b in links], "a string, b string"))
    users = spark.createDataFrame([(f"u{i}",) for i in range(100)], "key string")  # the others are only passed through and counted
    labels = spark.createDataFrame([(f"u{i}", int(1 - k), False) for i, k in enumerate(kinds) if k < 2], "key string, y int, weak boolean")
    got = {r["key"]: r for r in graph.hops(users, one, labels, 3, held).collect()}
    assert len(got) == 100
    for i in range(100):
        for h in range(3):
            assert tuple(got[f"u{i}"][f"{c}_{h + 1}hop"] for c in ("n", "cheater", "clean")) == (want[h, :, i].sum(), want[h, 0, i], want[h, 1, i])


def test_hops_write_no_pairs(spark, monkeypatch):
    """600 nodes of a star are 360,000 pairs in two steps; what is written are nodes and links."""
    written, settle = [], graph.settle

    def counted(df):
        out = settle(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "settle", counted)
    one = people.simple(spark.createDataFrame([("hub", f"u{i}") for i in range(600)], "a string, b string"))
    users = one.select("u").distinct().withColumnRenamed("u", "key")
    labels = spark.createDataFrame([("u1", 1, False)], "key string, y int, weak boolean")
    got = {r["key"]: (r["n_1hop"], r["n_2hop"], r["cheater_2hop"], r["n_3hop"]) for r in graph.hops(users, one, labels).collect()}
    assert got["hub"] == (600, 0, 0, 0) and got["u0"] == (1, 599, 1, 0) and got["u1"] == (1, 599, 0, 0)
    assert max(written) <= 1_200
    assert set(graph.hops(users, one.limit(0), labels).select("n_3hop").distinct().collect()) == {(0,)}
