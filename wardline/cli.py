"""Command line: reads CSV tables, fits a learner, writes scored users of test, and checks what was written.

    python -m wardline.cli --train train.csv --test test.csv --graph social_graph.csv --out scores --learner ensemble
    python -m wardline.cli --test test.csv --validate scores
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import graph, learn, metrics, people, scoring, tabular
from wardline.session import session, settle
from wardline.sources import files

LEARNERS = {"logistic": learn.Learner("logistic"), "boosted": learn.Learner("boosted", rounds=40), "forest": learn.Learner("forest", rounds=60, depth=8)}


def locate(name: str, given: str | None) -> str | None:
    """The given path, or the first that exists of the usual places; a given path is never replaced."""
    return given or next((p for p in (name, os.path.join("sample-data", name), os.path.join("data", name)) if os.path.exists(p)), None)


def featured(rows: DataFrame, users: DataFrame, labels: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows with their own features and, given links, those of their user's neighbours."""
    names = people.feature_columns(rows)
    rows = tabular.with_moments(rows, names).withColumns(tabular.missing(names) | {k: v for k, v in tabular.row_stats(names).items() if k != "row_range"}).drop("_n", "_sum", "_mean")
    if links is None:
        return rows
    stats = graph.guilt(graph.neighbour_counts(users, people.both_ways(people.links(links)), labels), graph.base_rate(labels))
    return rows.join(stats, "key", "left")


def numbered(train: DataFrame) -> DataFrame:
    """train with row_id and observed_at; where a CSV table has none, its rows' place stands for both, so that the last
    row of a user counts and equal rows stay apart."""
    if "row_id" not in train.columns:
        train = settle(train.withColumn("row_id", F.monotonically_increasing_id()))
    return train if "observed_at" in train.columns else train.withColumn("observed_at", F.col("row_id"))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    test = people.cleaned(files.read_users(spark, locate("test.csv", args.test)))
    if args.validate:
        problems = files.malformed(spark, args.validate).collect()
        if not any(p.violation == "bad header" for p in problems):
            read = files.read_text(spark, args.validate).withColumn("prediction", F.expr("try_cast(prediction as double)"))
            problems += files.violations(read, test).collect()
        for p in problems:
            print(f"{p.violation}: {p.n} ({p.examples})")
        return int(bool(problems))
    train = people.cleaned(files.read_users(spark, locate("train.csv", args.train)))
    train = numbered(train)
    labels = people.user_labels(train)
    weak = people.weak_negative() if not args.no_pseudo else F.lit(False)
    rows = train.withColumns({"y": people.label_class(), "weak": weak}).filter("y is not null or weak")
    if rows.isEmpty():
        raise ValueError("train has no labelled rows")
    if args.learner == "linear":
        names = people.feature_columns(train)
        weights = scoring.linear_weights(scoring.class_stats(rows.filter("y is not null"), names))
        scored = scoring.linear_score(test, names, weights, "user_hash").withColumnRenamed("score", "prediction")
    else:
        links = None if args.no_graph else files.read_links(spark, locate("social_graph.csv", args.graph))
        users = people.interest(train, test)
        weights = learn.sample_weights(F.col("y"), F.col("weak"), args.pos_weight, args.weak_neg_weight)
        own = featured(rows.withColumns({"w": weights, "y": F.coalesce("y", F.lit(0))}), users, labels, links)
        names = people.model_columns(own, ("row_id", "y", "w", "is_cheating", "high_conf_clean", "observed_at"))
        ready = learn.stratified_folds(learn.prepared(own, names), "row_id", folds=args.folds).select("row_id", "user_hash", "y", "w", "weak", "fold", *names).persist()
        target = learn.prepared(featured(test, users, labels, links), names).select("user_hash", *names).persist()
        chosen = LEARNERS if args.learner == "ensemble" else {args.learner: LEARNERS[args.learner]}
        fitted = {name: learn.out_of_fold(ready, names, learner, "row_id", args.folds) for name, learner in chosen.items()}
        mixed = learn.blend({name: scores for name, (scores, _) in fitted.items()}, "row_id", "y")
        if args.eval:
            real = mixed.join(ready.filter("not weak").select("row_id"), "row_id", "left_semi").withColumnRenamed("blend", "p").persist()
            print(f"AUC {metrics.auc(real).first()[0]}, average precision {metrics.average_precision(real).first()[0]}")
        each = {name: learn.averaged(models, target, "user_hash") for name, (_, models) in fitted.items()}
        scored = learn.blend(each, "user_hash").select("user_hash", scored_between(F.col("blend")).alias("prediction"))
    files.write_submission(scored.groupBy("user_hash").agg(F.avg("prediction").alias("prediction")), args.out)
    return 0


def scored_between(p):
    return F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wardline")
    for name in ("--train", "--test", "--graph", "--validate"):
        parser.add_argument(name)
    parser.add_argument("--out", default="submission")
    parser.add_argument("--learner", choices=["linear", *LEARNERS, "ensemble"], default="logistic")
    parser.add_argument("--pos-weight", type=float, default=3.0)
    parser.add_argument("--weak-neg-weight", type=float, default=0.25)
    parser.add_argument("--folds", type=int, default=5)
    for name in ("--eval", "--no-graph", "--no-pseudo"):
        parser.add_argument(name, action="store_true")
    return run(session("wardline"), parser.parse_args(argv))


if __name__ == "__main__":
    sys.exit(main())
