import random

from pyspark.sql import functions as F

from wardline.operators import learn, metrics
from wardline.plans import reference


def test_metrics_and_thresholds(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(300)]
    scores = spark.createDataFrame(rows, "p double, y int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.auc(scores).first()[0] - auc) < 1e-12
    steps = [0.1, 0.33, 0.5, 0.77, 0.9]
    pairs = [(a, b) for a in steps for b in steps if b >= a]
    for low_closed in (True, False):
        for high_closed in (True, False):
            def cost(a, b):
                total = 0
                for p, y in rows:
                    if p < a or (low_closed and p == a):
                        total += 7 * y
                    elif p > b or (high_closed and p == b):
                        total += 5 * (1 - y)
                    else:
                        total += 2 * (1 - y) + y
                return total
            got = metrics.best_thresholds(metrics.by_score(scores), [(a, b) for a, b in pairs if a < b], (7, 5, 2, 1), low_closed, high_closed)
            assert got == min(((a, b, float(cost(a, b))) for a, b in pairs if a < b), key=lambda x: (x[2], x[0], x[1]))
    assert metrics.auc(scores.filter("y = 1")).first()[0] is None
    assert metrics.best_thresholds(metrics.by_score(scores), [], (7, 5, 2, 1), True, True) is None


def test_folds_are_stratified_and_learners_learn(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(y * 1.5, 1), rng.random(), y) for i in range(600) for y in [int(i % 4 == 0)]]
    df = learn.stratified_folds(spark.createDataFrame(rows, "row_id bigint, a double, b double, y int"), "row_id").withColumn("w", F.lit(1.0)).persist()
    per = df.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
    assert len(per) == 5 and max(r.n for r in per) - min(r.n for r in per) < 90
    kinds = {"logistic": learn.Learner("logistic"), "forest": learn.Learner("forest", rounds=5, depth=3), "boosted": learn.Learner("boosted", rounds=3, depth=2)}
    scored = {k: learn.out_of_fold(df, ["a", "b"], v, "row_id", 5)[0].persist() for k, v in kinds.items()}
    for s in scored.values():
        assert s.count() == 600 and metrics.auc(s).first()[0] > 0.7
    mixed = learn.blend(scored, "row_id", "y", "fold")
    assert mixed.columns == ["row_id", "y", "fold", "logistic", "forest", "boosted", "blend"] and mixed.count() == 600


def test_tuning_tries_every_combination(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 2, 1.0, False, i % 5, float(i)) for i in range(40)], "row_id bigint, y int, w double, weak boolean, fold int, a double")
    scores = spark.createDataFrame([(0.2, 0), (0.7, 1)], "p double, y int")
    monkeypatch.setattr(reference, "_model_rows", lambda *_: (rows, rows, lambda df, _: df, ["a"]))
    monkeypatch.setattr(learn, "fit", lambda *_: None)
    monkeypatch.setattr(learn, "predict", lambda *_: scores)
    tried = {r.parameters for r in reference.tune(spark, "").collect()}
    assert len(tried) == 8 and sum("'weak_negative': 0.5" in t for t in tried) == 4


def test_picks_vary_every_parameter():
    grid = {"a": [1, 2], "b": [1, 2], "c": [1, 2]}
    some = learn.picks(grid, 4)
    assert some == learn.picks(grid, 4) and len({tuple(p.values()) for p in some}) == 4
    assert all({p[k] for p in some} == {1, 2} for k in grid)


def test_folds_of_users_and_choice(spark):
    keys = spark.createDataFrame([(f"u{i % 50}", i) for i in range(200)], "key string, row_id bigint")
    folds = keys.select("key", learn.fold_of_user(F.col("key")).alias("fold")).distinct()
    assert folds.count() == 50 and {r.fold for r in folds.collect()} == set(range(5))
    assert learn.better({"a": 0.5, "b": 0.7}) == "b" and learn.better({"a": 0.7, "b": 0.7}) == "a" and learn.better({"a": None, "b": 0.1}) == "b"


def test_cost_lines(spark):
    scores = spark.createDataFrame([(0.1, 1), (0.1, 0), (0.5, 1), (0.5, 0), (0.5, 0), (0.9, 1), (0.9, 0)], "p double, y int")
    got = {r.line: (r.n, r.cost) for r in metrics.cost_lines(scores, 0.1, 0.9, (7, 5, 2, 1)).collect()}
    assert got == {"cheaters through": (1, 7.0), "clean stopped": (1, 5.0), "clean looked at": (2, 4.0), "cheaters looked at": (1, 1.0), "total": (5, 17.0)}
