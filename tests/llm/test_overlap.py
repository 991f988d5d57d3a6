import random

import pytest

from wardline.llm import overlap


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damaged(rng, key, slips):
    for _ in range(slips):
        i = rng.randrange(len(key) + 1)
        how = rng.randrange(3)
        key = key[:i] + rng.choice("0123456789abcdefxyz") * (how != 1) + key[i + (how != 2) :]
    return key


def tables(spark, train, test):
    schema = "row_id bigint, text string, id string, distance int, n int"
    frame = lambda keys, first: spark.createDataFrame([(first + i, k, "x", 7, None) for i, k in enumerate(keys)], schema)
    return frame(train, 0), frame(test, 10**6)


def found(spark, train, test, cap=overlap.RUN_CAP):
    a, b = tables(spark, train, test)
    rows = overlap.row_pairs(overlap.matches(a, b, run_cap=cap), a, b, "text", "row_id").collect()
    got = [(r.train_row_id, r.test_row_id) for r in rows]
    assert len(got) == len(set(got))
    return set(got), rows


def brute(train, test):
    return {(i, 10**6 + j) for i, a in enumerate(train) for j, b in enumerate(test) if a and b and abs(len(a) - len(b)) < 3 and edits(a, b) <= 2}


@pytest.mark.parametrize("cap", [overlap.RUN_CAP, 3])
def test_equals_brute_force(spark, cap):
    rng = random.Random(cap)
    new = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    train = [new(24) for _ in range(60)] + [new(rng.randrange(1, 13)) for _ in range(40)]
    test = [damaged(rng, rng.choice(train), rng.randrange(4)) for _ in range(80)] + [new(24) for _ in range(10)]
    # a family of little variety, larger than a run may be
    train += [f"anon{i:09d}" for i in range(90)]
    test += [f"anon{i:09d}" for i in range(0, 300, 7)]
    train += [None, "", train[0], train[0]]
    test += [None, "", train[0], test[1]]
    got, rows = found(spark, train, test, cap)
    assert got == brute(train, test)
    for r in rows:
        a, b = train[r.train_row_id], test[r.test_row_id - 10**6]
        assert r.distance == edits(a, b)
        assert r.coverage == pytest.approx(len({i for s in overlap._spans(a, b) for i in range(*s)}) / len(b))


def test_coverage_and_distance(spark):
    _, rows = found(spark, ["abcdefghijklmnopqrstuvwx", "0123456789"], ["abcdefghijklXnopqrstuvwx", "0123456789"])
    by = {r.train_row_id: r for r in rows}
    assert by[0].distance == 1 and by[0].coverage == pytest.approx(23 / 24)
    assert by[1].distance == 0 and by[1].coverage == 1.0


def test_empty_tables(spark):
    assert found(spark, [], ["abc"])[0] == set() and found(spark, ["abc"], [])[0] == set()


def test_counts_equal_pairs(spark):
    train, test = tables(spark, ["aaaaaaaaaaaa", "aaaaaaaaaaaa", "aaaaaaaaaaab", None], ["aaaaaaaaaaaa", "aaaaaaaaaaaa", "zz"])
    counts = overlap.overlap_counts(overlap.matches(train, test), train, test, "text", ["id"], ["id"]).collect()
    assert [(r.pairs, r.exact_pairs) for r in counts] == [(6, 4)]


def test_runs_across_partitions(spark):
    """A run that fills several partitions, once as pairs and once crowded."""
    train, test = [f"{c}{i}same-suffix-of-all" for i in range(10, 60) for c in "ab"], ["c17same-suffix-of-all"]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for cap in (overlap.RUN_CAP, 20):
            assert found(spark, train, test, cap)[0] == brute(train, test)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_slips_equal_edits():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        b = damaged(rng, a, rng.randrange(5)) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        assert overlap.slips(a, b) == min(edits(a, b), 3), (a, b)


def test_short_texts_have_coverage(spark):
    _, rows = found(spark, ["ab", "abcd"], ["cd", "ab", "abcx"])
    assert {(r.train_row_id, r.test_row_id - 10**6, r.coverage) for r in rows} == {(0, 0, 0.0), (0, 1, 1.0), (0, 2, 0.5), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 0.75)}
