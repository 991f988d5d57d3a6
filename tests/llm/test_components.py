import random

import pytest

from wardline.llm import components


def brute(links):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = a or b, b or a
        if a:
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in parent}


def run(spark, links, bound):
    rows = spark.createDataFrame([(a, b, "x") for a, b in links], "a string, b string, root string").repartition(5)
    got = components.groups(rows, bound).collect()
    assert len(got) == len({r.key for r in got})
    return {r.key: r.group_key for r in got}


@pytest.mark.parametrize("bound", [7, 50, 10**6])
def test_random_graphs(spark, bound):
    rng = random.Random(bound)
    links = [(f"k{rng.randrange(300):03d}", f"k{rng.randrange(300):03d}") for _ in range(160)]
    links += [("hub", f"k{i:03d}") for i in range(0, 60)]
    links += [(None, "alone"), ("left", None), (None, None), ("self", "self")]
    assert run(spark, links, bound) == brute(links)


def test_long_chain_over_many_levels(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    links = [(f"{order[i]:04d}", f"{order[i + 1]:04d}") for i in range(399)] + [("0000", "0001")] * 50
    assert set(run(spark, links, 20).values()) == {"0000"}


def test_no_links(spark):
    assert run(spark, [], 10) == {}
