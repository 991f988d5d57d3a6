"""Ranking metrics and threshold search over scores (p, y).

Scores are rounded to six digits, so there are at most 1,000,001 distinct ones: rows are counted per score first, and
only those counts are ever put in order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_score(scores: DataFrame) -> DataFrame:
    """p, pos, neg: labelled rows per distinct score, of six digits."""
    return scores.groupBy(F.round("p", 6).alias("p")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def cumulative(scores: DataFrame) -> DataFrame:
    """p, pos, neg and how many of each have at most this score."""
    return _cumulative(by_score(scores))


def _cumulative(counted: DataFrame) -> DataFrame:
    up = W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    return counted.withColumns({"cum_pos": F.sum("pos").over(up), "cum_neg": F.sum("neg").over(up)})


def auc(scores: DataFrame) -> DataFrame:
    """One row: the share of pairs in the right order, ties half; null without both classes."""
    c = cumulative(scores).agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return c.select(F.try_divide("won", F.col("pos") * F.col("neg")).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One row: precision at each distinct score, weighted by the recall it adds."""
    c = cumulative(scores)
    totals = c.agg(F.max("cum_pos").alias("all_pos"), F.max("cum_neg").alias("all_neg")).first()
    pos, neg = totals["all_pos"] or 0, totals["all_neg"] or 0
    above_pos, above_neg = F.lit(pos) - F.col("cum_pos") + F.col("pos"), F.lit(neg) - F.col("cum_neg") + F.col("neg")
    return c.agg(F.sum(F.try_divide(F.col("pos") * above_pos, F.lit(pos) * (above_pos + above_neg))).alias("average_precision"))


def distribution(scores: DataFrame) -> DataFrame:
    """Per class: rows, least, median and greatest score, and rows below 0.1 to 0.5."""
    below = [F.count_if(F.col("p") < t / 10).alias(f"below_0{t}") for t in range(1, 6)]
    return scores.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least"), F.median("p").alias("middle"), F.max("p").alias("greatest"), *below)


class Counts:
    """How many positive and negative rows lie below given thresholds; from one pass that counts per stretch."""

    def __init__(self, counted: DataFrame, thresholds: Iterable[float]) -> None:
        self.at = sorted(set(thresholds))
        marks = F.array(*[F.lit(t) for t in self.at])
        place = counted.select("pos", "neg", F.size(F.filter(marks, lambda t: t < F.col("p"))).alias("below"), F.size(F.filter(marks, lambda t: t <= F.col("p"))).alias("upto"))
        rows = place.groupBy("below", "upto").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
        n = len(self.at) + 1
        self._lt, self._le = [[0, 0] for _ in range(n)], [[0, 0] for _ in range(n)]
        self.total = [sum(r["pos"] for r in rows), sum(r["neg"] for r in rows)]
        for i in range(len(self.at)):
            self._lt[i] = [sum(r[c] for r in rows if r["upto"] <= i) for c in ("pos", "neg")]
            self._le[i] = [sum(r[c] for r in rows if r["below"] <= i) for c in ("pos", "neg")]

    def below(self, t: float) -> list[int]:
        return self._lt[bisect_left(self.at, t)]

    def upto(self, t: float) -> list[int]:
        return self._le[bisect_right(self.at, t) - 1]


def ranks(counted: DataFrame, grid: int) -> list[float]:
    """Distinct scores at the ranks int(k / (grid - 1) * (n - 1)) for k below grid, from rows per score; at most grid values."""
    c = _cumulative(counted).select("p", (F.col("cum_pos") + F.col("cum_neg")).alias("upto"), (F.col("pos") + F.col("neg")).alias("n"))
    total = c.agg(F.max("upto")).first()[0] or 0
    wanted = F.array(*[F.lit(int(k / (grid - 1) * (total - 1))) for k in range(grid)]) if total else F.array().cast("array<int>")
    hit = F.exists(wanted, lambda i: (i < F.col("upto")) & (i >= F.col("upto") - F.col("n")))
    return sorted(r["p"] for r in c.filter(hit).select("p").collect())


def best_thresholds(counted: DataFrame, pairs: list[tuple[float, float]], costs: tuple[float, float, float, float], low_closed: bool, high_closed: bool) -> tuple[float, float, float] | None:
    """The pair of thresholds of least cost, the first of equals, with its cost, from rows per score.

    costs: positive left through, negative stopped, negative looked at, positive looked at. Rows up to the low
    threshold (below it unless low_closed) go through; rows from the high one (above it unless high_closed) are stopped.
    """
    if not pairs:
        return None
    counts = Counts(counted, [t for pair in pairs for t in pair])
    through: Callable[[float], list[int]] = counts.upto if low_closed else counts.below
    kept: Callable[[float], list[int]] = counts.below if high_closed else counts.upto
    missed, stopped, looked_neg, looked_pos = costs
    best = None
    for low, high in pairs:
        (a, b), (c, d) = through(low), kept(high)
        cost = missed * a + stopped * (counts.total[1] - d) + looked_neg * (d - b) + looked_pos * (c - a)
        if best is None or cost < best[2]:
            best = (low, high, float(cost))
    return best


def cost_lines(scores: DataFrame, low: float, high: float, costs: tuple[float, float, float, float]) -> DataFrame:
    """line, n, cost: cheaters let through, clean ones stopped, rows looked at (clean and cheating) and the total, for closed thresholds."""
    p, y = F.col("p"), F.col("y")
    through, stop = p <= low, p >= high
    look = ~through & ~stop
    kinds = [("cheaters through", through & (y == 1)), ("clean stopped", stop & ~through & (y == 0)), ("clean looked at", look & (y == 0)), ("cheaters looked at", look & (y == 1))]
    one = scores.agg(*[F.count_if(c).alias(f"_{i}") for i, (_, c) in enumerate(kinds)])
    lines = [F.struct(F.lit(name).alias("line"), F.col(f"_{i}").alias("n"), (F.col(f"_{i}") * F.lit(float(costs[i]))).alias("cost")) for i, (name, _) in enumerate(kinds)]
    whole = F.struct(F.lit("total").alias("line"), sum((F.col(f"_{i}") for i in range(1, len(kinds))), F.col("_0")).alias("n"), sum((F.col(f"_{i}") * F.lit(float(costs[i])) for i in range(1, len(kinds))), F.col("_0") * F.lit(float(costs[0]))).alias("cost"))
    return one.select(F.explode(F.array(*lines, whole)).alias("l")).select("l.line", "l.n", "l.cost")


def breakdown(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Rows and share per region (through, look, stop) and class, for closed thresholds."""
    region = F.when(F.col("p") <= low, "through").when(F.col("p") >= high, "stop").otherwise("look")
    counted = scores.groupBy(region.alias("region"), "y").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
