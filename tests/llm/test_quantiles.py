import datetime as dt
import math
import random

from wardline.llm import quantiles as q
from wardline.llm import queries


def test_error_bound_and_merging(spark):
    rng = random.Random(4)
    special = [None, float("nan"), 0.0, -0.0, float("inf"), float("-inf"), -999.0, 1e-300, 1e300, 1.0, 1.0]
    rows = [(g, d, rng.choice([rng.lognormvariate(3, 4), -rng.lognormvariate(1, 2), float(rng.randrange(5))]), "x") for g in ("a", None) for d in range(7) for _ in range(150)]
    rows += [("a", 1, v, "x") for v in special] + [("none", 1, None, "x"), ("none", 2, float("nan"), "x")]
    df = spark.createDataFrame(rows, "g string, d int, v double, bucket string").drop("bucket")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    merged = q.merge(q.sketch(df, ["g", "d"], ["v"]), ["g"])
    got = {(r.g, r.q): r for r in q.percentiles(merged, ["g"], shares).collect()}
    once = {(r.g, r.q): r for r in q.percentiles(q.sketch(df, ["g"], ["v"]), ["g"], shares).collect()}
    assert got == once
    for g in ("a", None):
        values = sorted(v for x, _, v, _ in rows if x == g and v is not None and not math.isnan(v))
        for s in shares:
            exact, row = values[math.floor(s * (len(values) - 1))], got[g, s]
            assert row.n == len(values)
            assert row.value == exact or abs(row.value - exact) <= q.ERROR * abs(exact) * (1 + 1e-9)
    assert not [k for k in got if k[0] == "none"]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert q.percentiles(q.sketch(df, ["g"], ["v"]), ["g"], [0.5]).count() == 0


def test_small_values_keep_the_stated_error(spark, tmp_path):
    values = [3e-300, -2e-9, 4.4e-7, 1.23e-5, 0.0123, 0.7, 12345.678]
    for i, v in enumerate(values):
        row = [("s", dt.datetime(2026, i + 1, 1), v, v, v)]
        spark.createDataFrame(row, "source string, observed_at timestamp, feature_001 double, feature_010 double, feature_015 double").write.mode("append").parquet(str(tmp_path / "train.parquet"))
    got = queries.p4_percentiles(spark, str(tmp_path)).collect()
    assert len(got) == len(values) * len(queries.FEATURES) * len(queries.SHARES)
    for r in got:
        exact = values[r.month.month - 1]
        assert abs(r.value - exact) <= r.relative_error * abs(exact) * (1 + 1e-4), exact
