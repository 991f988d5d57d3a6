"""Queries over train, test, social_graph and submission: features, graph, scores, policies and models."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import scalars
from wardline.operators import graph, learn, metrics, people, scoring, tabular
from wardline.session import settle
from wardline.sources import files
from wardline.sources.tables import table

NAMES = [f"feature_{i:03d}" for i in range(1, 19)]
#: Costs: positive left through, negative stopped, negative looked at, positive looked at.
COSTS = {"quantile": (600.0, 300.0, 150.0, 5.0), "linspace": (100.0, 50.0, 10.0, 10.0), "fixed": (600.0, 300.0, 150.0, 150.0), "relative": (600.0, 300.0, 150.0, 5.0)}
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return people.cleaned(table(spark, sf, "train"))


def _test(spark: SparkSession, sf: str) -> DataFrame:
    return people.cleaned(table(spark, sf, "test"))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """row_id and features of train and test."""
    return _train(spark, sf).select("row_id", "key", *NAMES).unionByName(_test(spark, sf).select("row_id", "key", *NAMES))


def _columns(spark: SparkSession, sf: str, columns: dict[str, Column], digits: int | None = None) -> DataFrame:
    rounded = {n: F.round(c, digits) if digits is not None else c for n, c in columns.items()}
    return tabular.with_moments(_rows(spark, sf), NAMES).select("row_id", *[c.alias(n) for n, c in rounded.items()])


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# rows and labels


@query
def safe_float(spark, sf):
    return table(spark, sf, "train", "row_id", "user_hash").select("row_id", scalars.safe_float(F.col("user_hash")).alias("number"))


@query
def label_class(spark, sf):
    return _train(spark, sf).select("row_id", people.label_class().alias("y"), F.col("is_cheating").isNotNull().cast("int").alias("has_label"))


@query
def weak_negatives(spark, sf):
    return _train(spark, sf).select("row_id", people.weak_negative().cast("int").alias("flag_is_one"), people.weak_negative(True).cast("int").alias("flag_is_there"))


@query
def pseudo_labels(spark, sf):
    weak = people.weak_negative()
    return _train(spark, sf).select("row_id", F.when(weak, 0.0).otherwise(F.col("is_cheating")).alias("label"), weak.cast("int").alias("is_pseudo_label"))


@query
def sample_weights(spark, sf):
    return _train(spark, sf).select("row_id", learn.sample_weights(people.label_class(), people.weak_negative()).alias("weight"))


@query
def label_summary(spark, sf):
    return files.label_summary(_train(spark, sf))


@query
def user_labels(spark, sf):
    return people.user_labels(_train(spark, sf)).select(F.col("key").alias("user_key"), "y", F.col("weak").cast("int").alias("weak"))


@query
def interest_set(spark, sf):
    return people.interest(_train(spark, sf), _test(spark, sf)).select(F.col("key").alias("user_key"))


@query
def base_rate(spark, sf):
    labels = people.user_labels(_train(spark, sf))
    return labels.agg(F.count("y").alias("labelled"), F.coalesce(F.sum("y"), F.lit(0)).alias("cheaters"), F.round(F.avg("y"), 9).alias("rate"))


@query
def scale_pos(spark, sf):
    rows = _train(spark, sf).select(people.label_class().alias("y"))
    ratio = F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1))
    return rows.agg(F.round(ratio, 9).alias("scale_pos"), F.round(ratio * 1.5, 9).alias("scale_pos_raised"))


@query
def split_labeled(spark, sf):
    rows = _train(spark, sf).select("row_id", people.label_class().alias("y")).filter("y is not null")
    return learn.hash_split(rows, "row_id").select("row_id", "is_validation")


@query
def strat_folds(spark, sf):
    rows = _train(spark, sf).select("row_id", people.label_class().alias("y")).filter("y is not null")
    return learn.stratified_folds(rows, "row_id").select("row_id", "fold")


# row-wise features


@query
def missing_stats(spark, sf):
    return _columns(spark, sf, tabular.missing(NAMES))


@query
def impute_flags(spark, sf):
    return _columns(spark, sf, tabular.imputed(NAMES))


@query
def row_stats(spark, sf):
    return _columns(spark, sf, tabular.row_stats(NAMES))


@query
def row_skew(spark, sf):
    return _columns(spark, sf, tabular.row_skew(NAMES), 6)


@query
def ratios(spark, sf):
    return _columns(spark, sf, tabular.ratios(), 6)


@query
def log_feats(spark, sf):
    return _columns(spark, sf, tabular.logs(), 9)


@query
def flag_feats(spark, sf):
    return _columns(spark, sf, tabular.high_flags())


@query
def square_feats(spark, sf):
    return _columns(spark, sf, tabular.squares(NAMES))


@query
def interactions(spark, sf):
    return _columns(spark, sf, tabular.products())


@query
def binary_pairs(spark, sf):
    return _columns(spark, sf, tabular.binary_pairs())


@query
def value_counts_row(spark, sf):
    return _columns(spark, sf, tabular.equal_counts(NAMES))


@query
def signed_log1p(spark, sf):
    return _columns(spark, sf, {n: scalars.signed_log1p(F.col(n)) for n in NAMES}, 9)


@query
def sigmoid(spark, sf):
    return _columns(spark, sf, {"narrow": scalars.sigmoid(tabular.f(15) / 10, 20.0), "wide": scalars.sigmoid(tabular.f(15), 35.0)}, 9)


@query
def clip_proba(spark, sf):
    sub = table(spark, sf, "submission")
    return sub.select("user_hash", scalars.between(scalars.no_nan(F.col("prediction")), 0.001, 0.999).alias("prediction"))


# fits over rows


def _labelled(spark, sf):
    return _train(spark, sf).select("row_id", *NAMES, people.label_class().alias("y")).filter("y is not null")


@query
def clip_bounds(spark, sf):
    train = _train(spark, sf).filter(people.label_class().isNotNull() | people.weak_negative())
    return scoring.clip_bounds(train, NAMES)


@query
def winsorize(spark, sf):
    """Rows of train and test with values clipped to the bounds; missing ones are 0. The bounds, one row per feature,
    become constants."""
    train = _train(spark, sf).filter(people.label_class().isNotNull() | people.weak_negative())
    bounds = {r["feature"]: (r["lo"], r["hi"]) for r in scoring.clip_bounds(train, NAMES).collect()}
    return _columns(spark, sf, {n: scalars.zero(scalars.between(F.col(n), *bounds.get(n, (-1.0, 1.0)))) for n in NAMES})


@query
def standardize(spark, sf):
    fitted = {r["feature"]: (r["mean"], r["std"]) for r in scoring.scaling(_train(spark, sf), NAMES).collect()}
    return _columns(spark, sf, {n: (scalars.zero(F.col(n)) - fitted[n][0]) / fitted[n][1] for n in NAMES if n in fitted}, 6)


@query
def class_stats(spark, sf):
    stats = scoring.class_stats(_labelled(spark, sf), NAMES)
    return stats.select("y", "feature", "n", F.round("sx", 4).alias("sx"), F.format_string("%.8e", "sxx").alias("sxx"), "n_missing", "n_rows")


@query
def lda_weights(spark, sf):
    return _r(scoring.linear_weights(scoring.class_stats(_labelled(spark, sf), NAMES)), 7)


def _weights(spark, sf):
    return scoring.linear_weights(scoring.class_stats(_labelled(spark, sf), NAMES))


@query
def linear_score(spark, sf):
    return _r(scoring.linear_score(_test(spark, sf), NAMES, _weights(spark, sf), "row_id"))


def _scores(spark, sf):
    """p, y of labelled rows of train by the linear score."""
    rows = scoring.linear_score(_labelled(spark, sf), NAMES, _weights(spark, sf), "row_id", "y")
    return rows.select("row_id", "y", F.round("score", 6).alias("p"))


@query
def cum_counts(spark, sf):
    return metrics.cumulative(_scores(spark, sf))


@query
def auc(spark, sf):
    return _r(metrics.auc(_scores(spark, sf)))


@query
def avg_precision(spark, sf):
    return _r(metrics.average_precision(_scores(spark, sf)))


@query
def score_dist(spark, sf):
    return metrics.distribution(_scores(spark, sf))


# thresholds


def _best(spark: SparkSession, best) -> DataFrame:
    return spark.createDataFrame([best] if best else [], "t_low double, t_high double, cost double")


@query
def cost_quantile(spark, sf):
    counted = settle(metrics.by_score(_scores(spark, sf)))
    steps = metrics.ranks(counted, 200)
    pairs = [(a, b) for i, a in enumerate(steps) for b in steps[i:]]
    best = metrics.best_thresholds(counted, pairs, COSTS["quantile"], False, True)
    return spark.createDataFrame([(-best[2] if best else 0.0,)], "score double")


@query
def cost_grid_linspace(spark, sf):
    steps = [0.01 + i * 0.01 for i in range(99)]
    return _best(spark, metrics.best_thresholds(metrics.by_score(_scores(spark, sf)), [(a, b) for a in steps for b in steps if b > a], COSTS["linspace"], True, True))


@query
def cost_grid_fixed(spark, sf):
    low, high = [0.01 + i * 0.01 for i in range(69)], [0.30 + i * 0.01 for i in range(69)]
    return _best(spark, metrics.best_thresholds(metrics.by_score(_scores(spark, sf)), [(a, b) for a in low for b in high if b > a], COSTS["fixed"], True, True))


@query
def cost_grid_relative(spark, sf):
    low = [0.05 + i * 0.02 for i in range(23)]
    pairs = [(a, (a + 0.05) + j * 0.02) for a in low for j in range(ceil((0.95 - (a + 0.05)) / 0.02))]
    return _best(spark, metrics.best_thresholds(metrics.by_score(_scores(spark, sf)), pairs, COSTS["relative"], False, False))


@query
def cost_scaled(spark, sf):
    best = cost_grid_fixed(spark, sf)
    n_test, n_labelled = table(spark, sf, "test").count(), _labelled(spark, sf).count()
    return best.select(F.round(F.col("cost") * F.lit(n_test / max(n_labelled, 1)), 4).alias("scaled_cost"))


def _thresholds(spark, sf, scores: DataFrame) -> tuple[float, float]:
    low, high = [0.01 + i * 0.01 for i in range(69)], [0.30 + i * 0.01 for i in range(69)]
    best = metrics.best_thresholds(metrics.by_score(scores), [(a, b) for a in low for b in high if b > a], COSTS["fixed"], True, True)
    return best[:2] if best else (0.0, 1.0)


@query
def decision_breakdown(spark, sf):
    scores = settle(_scores(spark, sf))
    return _r(metrics.breakdown(scores, *_thresholds(spark, sf, scores)), 9)


@query
def cost_lines(spark, sf):
    """What each kind of decision costs at the thresholds found."""
    scores = settle(_scores(spark, sf))
    return metrics.cost_lines(scores, *_thresholds(spark, sf, scores), COSTS["fixed"])


# links


def _people(spark, sf):
    train, test = _train(spark, sf), _test(spark, sf)
    return people.interest(train, test), people.user_labels(train)


def _links(spark, sf):
    return people.links(table(spark, sf, "social_graph", "user_a", "user_b"))


def _named(df: DataFrame) -> DataFrame:
    return _r(df.withColumnRenamed("key", "user_key"))


@query
def edges_bidir(spark, sf):
    return people.both_ways(_links(spark, sf))


@query
def edges_simple(spark, sf):
    return people.simple(_links(spark, sf))


@query
def degree_multi(spark, sf):
    return _named(graph.degrees(_people(spark, sf)[0], people.both_ways(_links(spark, sf))))


@query
def degree_simple(spark, sf):
    return _named(graph.degrees(_people(spark, sf)[0], people.simple(_links(spark, sf))))


@query
def degree_centrality(spark, sf):
    return _named(graph.degree_centrality(_people(spark, sf)[0], people.simple(_links(spark, sf)))).withColumn("centrality", F.round("centrality", 6))


@query
def neighbor_stats(spark, sf):
    users, labels = _people(spark, sf)
    return _named(graph.neighbour_counts(users, people.both_ways(_links(spark, sf)), labels))


@query
def known_neighbors(spark, sf):
    users, labels = _people(spark, sf)
    return _named(graph.known_neighbours(users, people.both_ways(_links(spark, sf)), labels))


@query
def edges_to_class(spark, sf):
    users, labels = _people(spark, sf)
    return _named(graph.edges_to_classes(users, people.both_ways(_links(spark, sf)), labels))


@query
def guilt_features(spark, sf):
    users, labels = _people(spark, sf)
    counts = graph.neighbour_counts(users, people.both_ways(_links(spark, sf)), labels)
    return _named(graph.guilt(counts, graph.base_rate(labels)))


@query
def second_pass(spark, sf):
    users, labels = _people(spark, sf)
    both = people.both_ways(_links(spark, sf))
    return _named(graph.second_pass(users, both, graph.known_neighbours(users, both, labels)))


@query
def neighbor_degree(spark, sf):
    return _named(graph.neighbour_degrees(_people(spark, sf)[0], people.simple(_links(spark, sf))))


@query
def one_hop(spark, sf):
    users, labels = _people(spark, sf)
    return _named(graph.one_hop(users, people.simple(_links(spark, sf)), labels))


@query
def two_hop(spark, sf):
    users, labels = _people(spark, sf)
    return _r(graph.hop_rates(graph.hops(users, people.simple(_links(spark, sf)), labels, 2), 2).withColumnRenamed("key", "user_key"), 9)


@query
def three_hop(spark, sf):
    users, labels = _people(spark, sf)
    return _r(graph.hop_rates(graph.hops(users, people.simple(_links(spark, sf)), labels, 3), 3).withColumnRenamed("key", "user_key"), 9)


@query
def clustering(spark, sf):
    return _named(graph.clustering(_people(spark, sf)[0], people.simple(_links(spark, sf))))


@query
def label_prop(spark, sf):
    users, labels = _people(spark, sf)
    return _named(graph.label_propagation(users, people.simple(_links(spark, sf)), labels))


@query
def pagerank_risk(spark, sf):
    users, labels = _people(spark, sf)
    return _named(graph.risk_propagation(users, people.simple(_links(spark, sf)), labels))


def _nodes(users, one):
    return users.union(one.select(F.col("u").alias("key"))).distinct()


@query
def components(spark, sf):
    users, one = _people(spark, sf)[0], people.simple(_links(spark, sf))
    return graph.components(_nodes(users, one), one).withColumnRenamed("key", "user_key")


@query
def component_stats(spark, sf):
    users, labels = _people(spark, sf)
    one = people.simple(_links(spark, sf))
    return _named(graph.component_stats(graph.components(_nodes(users, one), one), users, labels))


@query
def communities(spark, sf):
    users, one = _people(spark, sf)[0], people.simple(_links(spark, sf))
    return graph.communities(_nodes(users, one), one).withColumnRenamed("key", "user_key")


@query
def community_stats(spark, sf):
    users, labels = _people(spark, sf)
    one = people.simple(_links(spark, sf))
    parts = graph.communities(_nodes(users, one), one).withColumnRenamed("community", "component")
    return _named(graph.component_stats(parts, users, labels)).select("user_key", F.col("component").alias("community"), F.col("component_size").alias("community_size"), F.col("component_cheat_rate").alias("community_cheat_rate"))


#: Columns of a user's links that are 0 for a row without such a user; the others are null there.
_COUNTS = ["degree", "log_degree", "cheater", "clean", "labeled", "has_cheater", "neighbor_degree_mean", "neighbor_degree_max", "neighbor_degree_std", "triangles", "clustering", "component_size", "log_component_size", *[f"{n}_{h}hop" for n in ("n", "cheater", "clean") for h in (1, 2, 3)], "cheater_reach"]


def _link_features(spark, sf) -> DataFrame:
    """key and every feature of its links but those of more than one step: neighbours, their degrees, triangles,
    component, both propagations."""
    users, labels = _people(spark, sf)
    users, one, labels = settle(users), settle(people.simple(_links(spark, sf))), settle(labels)
    parts = graph.components(_nodes(users, one), one)
    tables = [
        graph.one_hop(users, one, labels), graph.neighbour_degrees(users, one), graph.clustering(users, one), graph.component_stats(parts, users, labels).drop("component"),
        graph.label_propagation(users, one, labels).withColumnRenamed("score", "label_prop_score"), graph.risk_propagation(users, one, labels).withColumnRenamed("risk", "pagerank_risk"),
    ]
    return reduce(lambda a, b: a.join(b, "key"), tables)


def _attached(spark, sf, rows: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with the features of their user's links; rows of nobody and users without links get 0 and null."""
    joined = rows.join(features, "key", "left")
    return joined.fillna(0, [c for c in _COUNTS if c in joined.columns])


@query
def attach_graph(spark, sf):
    """Every feature of links on every row of train and test, but those of attach_hops."""
    return _r(_attached(spark, sf, _rows(spark, sf).select("row_id", "key"), _link_features(spark, sf)).drop("key"))


@query
def attach_hops(spark, sf):
    """The features of users within two and three steps, on every row of train and test."""
    users, labels = _people(spark, sf)
    hops = graph.hop_rates(graph.hops(users, people.simple(_links(spark, sf)), labels, 3), 3)
    return _r(_attached(spark, sf, _rows(spark, sf).select("row_id", "key"), hops).drop("key"), 9)


@query
def graph_interactions(spark, sf):
    """Rate of cheaters nearby times missing values, and propagated risk times the row's mean; what is absent counts 0."""
    users, labels = _people(spark, sf)
    users, one, labels = settle(users), settle(people.simple(_links(spark, sf))), settle(labels)
    features = graph.one_hop(users, one, labels).select("key", "cheat_rate").join(graph.risk_propagation(users, one, labels), "key")
    rows = _attached(spark, sf, tabular.with_moments(_rows(spark, sf), NAMES), features)
    stats = tabular.missing(NAMES) | tabular.row_stats(NAMES)
    return rows.select("row_id", F.round(scalars.zero(F.col("cheat_rate")) * stats["missing_count"], 6).alias("rate_missing"), (F.round(scalars.zero(F.col("risk")) * scalars.zero(stats["row_mean"]), 3) + F.lit(0.0)).alias("risk_mean"))


# results


@query
def submission_format(spark, sf):
    scores = scoring.linear_score(_test(spark, sf), NAMES, _weights(spark, sf), "user_hash").select("user_hash", F.round("score", 6).alias("prediction"))
    return files.submission(scores)


@query
def validate_submission(spark, sf):
    return files.violations(table(spark, sf, "submission"), table(spark, sf, "test", "user_hash"))


# models


FOLDS = 5


def _model_rows(spark, sf) -> tuple[DataFrame, DataFrame, learn.View, list[str]]:
    """Rows to learn from (labelled, weakly negative), rows of test, the view that the model of a fold has of either,
    and the names of its features.

    Folds follow users, and a fold's model sees neither the labels of its users nor neighbours' rates made from them.
    """
    users, labels = _people(spark, sf)
    marked = labels.select("key", "y", learn.fold_of_user(F.col("key"), FOLDS).alias("fold"))
    near = settle(graph.counts_by_fold(users, people.simple(_links(spark, sf)), marked, FOLDS))
    rows = _train(spark, sf).withColumns({"y": people.label_class(), "weak": people.weak_negative()}).filter("y is not null or weak")
    true_y = F.when(F.col("weak"), F.lit(None)).otherwise(F.col("y"))
    rows = rows.withColumn("w", learn.sample_weights(true_y, F.col("weak"))).withColumns({"y": F.coalesce("y", F.lit(0)), "fold": learn.fold_of_user(F.coalesce("key", F.col("row_id").cast("string")), FOLDS)})
    own = tabular.missing(NAMES) | tabular.logs()
    names = [*NAMES, *own, *graph.FOLD_FEATURES]

    def shaped(df: DataFrame, *keep: str) -> DataFrame:
        joined = df.select("row_id", "key", *keep, *NAMES).join(near, "key", "left").fillna(0, [c for c in near.columns if c != "key"])
        # written down at once: a join or filter above the new columns would make the optimizer infer every combination of them
        return settle(joined.withColumns(own).drop("key"))

    view = lambda df, k: learn.prepared(df.withColumns(graph.without_fold(k, FOLDS)), names)
    return shaped(rows, "y", "w", "weak", "fold"), shaped(_test(spark, sf)), view, names


def _oof(spark, sf, learner: learn.Learner) -> DataFrame:
    rows, _, view, names = _model_rows(spark, sf)
    return learn.out_of_fold(rows, names, learner, "row_id", FOLDS, view)[0].select("row_id", "fold", "y", "p")


@query
def logreg(spark, sf):
    return _oof(spark, sf, learn.Learner("logistic"))


@query
def gbt_cv(spark, sf):
    return _oof(spark, sf, learn.Learner("boosted", rounds=20, depth=4))


@query
def rf_cv(spark, sf):
    return _oof(spark, sf, learn.Learner("forest", rounds=20, depth=6))


@query
def oof(spark, sf):
    return _oof(spark, sf, learn.Learner("logistic")).select("row_id", "p")


@query
def cv_summary(spark, sf):
    """Mean and deviation of the folds' AUC."""
    scores = settle(_oof(spark, sf, learn.Learner("logistic")))
    each = [(k, metrics.auc(scores.filter(F.col("fold") == k)).first()[0]) for k in range(FOLDS)]
    return spark.createDataFrame(each, "fold int, auc double").agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_pop("auc"), 6).alias("std_auc"))


LEARNERS = {"logistic": learn.Learner("logistic"), "boosted": learn.Learner("boosted", rounds=8, depth=3), "forest": learn.Learner("forest", rounds=10, depth=5)}


def _fitted(spark, sf):
    rows, test, view, names = _model_rows(spark, sf)
    fitted = {name: learn.out_of_fold(rows, names, learner, "row_id", FOLDS, view) for name, learner in LEARNERS.items()}
    return learn.blend({name: scores for name, (scores, _) in fitted.items()}, "row_id", "y", "fold"), {name: models for name, (_, models) in fitted.items()}, test, view


@query
def ensemble(spark, sf):
    return _fitted(spark, sf)[0]


@query
def stacking(spark, sf):
    return learn.stack(settle(_fitted(spark, sf)[0]), list(LEARNERS), "row_id", FOLDS)[0]


@query
def test_scores(spark, sf):
    """Rows of test by the mean of the fold models, by the stacked learner over them, and by whichever of the two has
    the greater AUC on rows held out from both."""
    blended, models, test, view = _fitted(spark, sf)
    stacked, stackers = learn.stack(settle(blended), list(LEARNERS), "row_id", FOLDS)
    stacked = settle(stacked)
    chosen = learn.better({"blend": metrics.auc(stacked.withColumnRenamed("blend", "p")).first()[0], "stacked": metrics.auc(stacked.withColumnRenamed("stacked", "p")).first()[0]})
    each = settle(learn.blend({name: learn.averaged(own, test, "row_id", view) for name, own in models.items()}, "row_id"))
    final = each.join(learn.averaged(stackers, each, "row_id").withColumnRenamed("p", "stacked"), "row_id")
    return final.select("row_id", F.round("blend", 6).alias("mean_score"), F.round("stacked", 6).alias("stacked_score"), F.round(chosen, 6).alias("prediction"), F.lit(chosen).alias("chosen"))


@query
def top_features(spark, sf):
    rows, _, view, names = _model_rows(spark, sf)
    model = learn.fit(view(rows, FOLDS - 1).filter(F.col("fold") != FOLDS - 1), names, learn.Learner("forest", rounds=20, depth=6))
    return spark.createDataFrame(learn.importance(model, names, 20), "feature string, importance double")


@query
def tune(spark, sf):
    """All combinations of the grid, tried on the rows of one fold."""
    rows, _, view, names = _model_rows(spark, sf)
    split = settle(view(rows, 0).select("row_id", "y", "weak", "fold", *names))
    grid = {"penalty": [0.003, 0.03], "positive": [2.0, 4.0], "weak_negative": [0.1, 0.5]}
    found = learn.tune(split.filter("fold != 0"), split.filter("fold = 0 and not weak"), names, grid)
    return spark.createDataFrame([(str(params), float(a), float(c)) for params, a, c in found], "parameters string, auc double, cost double")
