"""Row-wise features. Each function gives columns to select; none shuffles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import flag, ratio, total, zero

Columns = dict[str, Column]
#: Feature numbers of the ratios, logs, products and pairs.
RATIOS_EPS = [(15, 17), (16, 17), (8, 10)]
RATIOS_SAFE = [(2, 3), (4, 6), (8, 9)]
LOGS = [10, 15, 16]
PRODUCTS = [(1, 2), (3, 4), (8, 9), (13, 14)]
BINARY = [7, 11, 13, 14]
HIGH = [(10, 1000.0), (15, 10.0)]


def f(number: int) -> Column:
    return F.col(f"feature_{number:03d}")


def missing(names: list[str]) -> Columns:
    flags = {f"{n}_missing": F.col(n).isNull().cast("int") for n in names}
    count = total(list(flags.values()))
    return {"missing_count": count, "missing_ratio": count / F.lit(float(len(names))), **flags}


def imputed(names: list[str]) -> Columns:
    """Null as 0, with an indicator of each."""
    return {n: zero(F.col(n)) for n in names} | {f"{n}_missing": F.col(n).isNull().cast("int") for n in names}


def with_moments(df: DataFrame, names: list[str]) -> DataFrame:
    """df with _n, _sum and _mean of the values present in a row, which the row statistics build on.

    A projection of its own, so that the mean is computed once; plain arithmetic, so all of it is generated code.
    """
    n = total([F.col(c).isNotNull().cast("int") for c in names])
    t = total([F.lit(0.0), *[zero(F.col(c)) for c in names]])
    return df.withColumns({"_n": n, "_sum": t}).withColumn("_mean", F.try_divide("_sum", "_n"))


def _power_sum(names: list[str], power: int) -> Column:
    """Sum of powers of the deviations from the mean; a missing value deviates by 0."""
    off = [F.coalesce(F.col(c), F.col("_mean")) - F.col("_mean") for c in names]
    return total([d * d if power == 2 else d * d * d for d in off])


def row_stats(names: list[str]) -> Columns:
    """Mean, sample deviation, least, greatest, range and sum of the values present; the sum of none is 0.
    For rows with moments."""
    n, mean = F.col("_n"), F.col("_mean")
    spread = F.sqrt(F.try_divide(_power_sum(names, 2), n - 1))
    low, high = (F.least(*names), F.greatest(*names)) if len(names) > 1 else (F.col(names[0]), F.col(names[0]))
    return {"row_mean": mean, "row_std": F.when(n > 1, spread), "row_min": low, "row_max": high, "row_range": high - low, "row_sum": F.col("_sum")}


def row_skew(names: list[str]) -> Columns:
    """Bias-corrected skewness of the values present: null below three, 0 where they are all equal.
    For rows with moments."""
    n = F.col("_n").cast("double")
    second, third = F.try_divide(_power_sum(names, 2), n), F.try_divide(_power_sum(names, 3), n)
    skew = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.try_divide(third, second * F.sqrt(second))
    return {"row_skew": F.when(n > 2, F.when(second > 1e-14, skew).otherwise(0.0))}


def ratios() -> Columns:
    eps = {f"ratio_{a:03d}_{b:03d}": ratio(f(a), f(b) + 1e-8) for a, b in RATIOS_EPS}
    safe = {f"safe_ratio_{a:03d}_{b:03d}": zero(f(a)) / F.coalesce(F.nullif(f(b), F.lit(0.0)), F.lit(1.0)) for a, b in RATIOS_SAFE}
    return eps | safe


def logs() -> Columns:
    part = lambda n: F.greatest(zero(f(n)), F.lit(0.0))
    return {f"log_{n:03d}": F.log1p(part(n)) for n in LOGS} | {"sqrt_010": F.sqrt(part(10))}


def high_flags() -> Columns:
    return {f"high_{n:03d}": flag(f(n) > bound) for n, bound in HIGH}


def squares(names: list[str]) -> Columns:
    return {f"{n}_sq": zero(F.col(n)) * zero(F.col(n)) for n in names}


def products() -> Columns:
    return {f"product_{a:03d}_{b:03d}": zero(f(a)) * zero(f(b)) for a, b in PRODUCTS}


def binary_pairs() -> Columns:
    both = {f"and_{a:03d}_{b:03d}": (zero(f(a)) * zero(f(b))).cast("int") for a, b in combinations(BINARY, 2)}
    return both | {f"or_{a:03d}_{b:03d}": (zero(f(a)) + zero(f(b)) > 0).cast("int") for a, b in combinations(BINARY, 2)}


def equal_counts(names: list[str]) -> Columns:
    return {"zeros": total([flag(F.col(n) == 0.0) for n in names]), "ones": total([flag(F.col(n) == 1.0) for n in names])}
