"""Percentiles by their several definitions, ratios, rounding, exact tests, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_cont(x: Column | str, q: float) -> Column:
    """Linear interpolation between neighbours."""
    return F.percentile(x, q)


def nearest_floor(x: Column, q: float) -> Column:
    """Element floor(q * n) of the sorted values, the last at most; nulls left out."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.least(F.size(values) - 1, F.floor(F.lit(q) * F.size(values)).cast("int")))


def nearest_round(x: Column, percent: float) -> Column:
    """Element round(percent / 100 * (n - 1)) of the sorted values, halves to even."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.least(F.size(values) - 1, F.bround(F.lit(percent / 100) * (F.size(values) - 1), 0).cast("int")))


def upper_median(x: Column) -> Column:
    """Element n // 2 of the sorted values."""
    values = F.array_sort(F.collect_list(x))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def binomial_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact p of the sign test: twice the upper tail of Binomial(n, 1/2), 1 at most; 1 without pairs."""
    n, k = (wins + losses).cast("int"), F.greatest(wins, losses).cast("int")
    # Logs of factorials, so that the largest term doesn't overflow; each next one from the one before.
    log_factorial = lambda m: F.aggregate(F.when(m >= 1, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    first = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0)))
    steps = F.when(k < n, F.sequence(k, n - 1)).otherwise(F.array().cast("array<int>"))
    onward = lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["sum"] + a["term"] * (n - i) / (i + 1)).alias("sum"))
    tail = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), onward)["sum"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """USD at prices for a million tokens."""
    return F.bround((tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / 1_000_000, 8)
