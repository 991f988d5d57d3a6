import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions.keys import user_key
from wardline.operators import heavy_keys, orphans, skew

T = dt.datetime(2026, 1, 1)


def day(n):
    return None if n is None else T + dt.timedelta(days=n)


def orphan_case(refs, parents):
    out = set()
    for i, k, at in refs:
        if k and not any(p == k and since is not None and at is not None and since <= at and (until is None or until > at) for p, since, until in parents):
            out.add(i)
    return out


@pytest.mark.parametrize("most", [orphans.SPANS, 3, 0])
def test_orphans(spark, most):
    rng = random.Random(most)
    days = lambda: rng.choice([None, *range(20)])
    keys = ["hot"] * 6 + [f"k{i}" for i in range(12)] + [None, "", "gone"]
    refs = [(i, rng.choice(keys), days()) for i in range(2500)]
    parents = [(rng.choice([k for k in keys if k != "gone"]), days(), days()) for _ in range(40)] * 2
    r = spark.createDataFrame([(i, k, day(a), 1) for i, k, a in refs], "ref_id bigint, raw string, seen timestamp, spans int")
    p = spark.createDataFrame([(k, day(a), day(b), "x") for k, a, b in parents], "raw string, a timestamp, b timestamp, ref_id string")
    tagged = orphans.references(r, "t", "raw", user_key("raw"), "ref_id", "seen")
    found = orphans.orphans(tagged, orphans.parents(p, user_key("raw"), "a", "b"), most)
    got = [x.ref_id for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == orphan_case(refs, parents)
    assert orphans.orphan_counts(found).agg(F.sum("orphans")).first()[0] == len(got)
    assert orphans.orphans(tagged, orphans.parents(p.limit(0), user_key("raw"), "a", "b")).count() == sum(bool(k) for _, k, _ in refs)
    assert orphans.orphans(tagged.limit(0), orphans.parents(p, user_key("raw"), "a", "b")).count() == 0


def test_hot_keys_are_found_once(spark, monkeypatch, tmp_path):
    """Orphans of keys that are hot at one evaluation of the sketch and not at another come out."""

    def some(batches):
        import uuid

        import pyarrow as pa

        (tmp_path / uuid.uuid4().hex).touch()
        n = len(list(tmp_path.iterdir()))
        yield from (pa.record_batch([pa.array([f"k{n}"])], names=["key"]) for _ in batches)

    sketch = lambda df, value, *_: spark.range(1).coalesce(1).mapInArrow(some, "key string")
    monkeypatch.setattr(skew, "hot_values", sketch)
    monkeypatch.setattr(orphans, "hot_values", sketch, raising=False)
    refs = spark.createDataFrame([("t", "f", i, f"k{i % 9}", day(i)) for i in range(90)], "ref_table string, ref_field string, ref_id bigint, key string, at timestamp")
    spans = spark.createDataFrame([("k0", day(0), None)], "key string, since timestamp, until timestamp")
    assert sorted(r.ref_id for r in orphans.orphans(refs, spans).collect()) == [i for i in range(90) if i % 9]


def test_states_of_heavy_keys(spark):
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        key = rng.choice(["hub"] * 5 + ["big", "big", None] + [f"k{rng.randrange(300)}"])
        rows.append((key, rng.choice([None, "same", "same", f"p{rng.randrange(200)}"]), None if rng.random() < 0.1 else day(rng.randrange(900)), i))
    df = spark.createDataFrame(rows, "key string, partner string, at timestamp, id bigint").withColumn("n", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["key"]: (r.n, r.n_distinct, r.last_at) for r in heavy_keys.states_by_key(df, "key", "partner", "at", "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for key in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == key]
        want[key] = (len(own), len({r[1] for r in own} - {None}), max((r[2] for r in own if r[2]), default=None))
    assert got == want
    states = heavy_keys.states_by_key(df, "key", "partner", "at", "id")
    assert {r["key"] for r in heavy_keys.heavy(states, 4000, 100).collect()} == {k for k, v in want.items() if v[0] * 10 >= 4000}
    assert heavy_keys.states_by_key(df.limit(0), "key", "partner", "at", "id").count() == 0


def test_endpoints(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "a", 2), (None, "b", 3), (None, None, 4)], "a string, b string, id int")
    got = sorted((r["key"], r.partner or "", r.id) for r in heavy_keys.endpoints(links, F.col("a"), F.col("b"), "id").collect())
    assert got == [("a", "a", 2), ("a", "b", 1), ("b", "", 3), ("b", "a", 1)]


def test_lookup_keeps_every_row(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 50}", i) for i in range(6000)] + [(None, -1), (None, -1)], "v string, i int")
    right = spark.createDataFrame([("hot", 1.0), ("k2", 2.0), ("unused", 3.0)], "v string, s double")
    want = sorted((r.v or "", r.i, r.s) for r in left.join(right, "v", "left").collect())
    assert sorted((r.v or "", r.i, r.s) for r in skew.lookup(left, right, "v", "s").collect()) == want
    assert [r.v for r in skew.hot_values(left, "v").collect()] == ["hot"]
