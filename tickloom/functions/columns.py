"""Column builders shared by the operators (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

div = F.try_divide


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def skew_corrected(g1: Column, n: Column) -> Column:
    """Sample skewness from the population one; NULL below three values."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1.0)) / F.when(n > 2, n - 2.0))


def kurt_corrected(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population one; NULL below four values."""
    den = F.when(n > 3, (n - 2.0) * (n - 3.0))
    return F.when(n >= 4, (n - 1.0) / den * ((n + 1.0) * g2 + 6.0))


def sharpe(mean: Column, std: Column, ppy: int, rf: float) -> Column:
    return F.when(std > 0, (mean - rf / ppy) / F.when(std > 0, std) * (ppy**0.5)).otherwise(0.0)


MAX_LOG = 709.0  # beyond, the exponential leaves the range of doubles


def exp_in_range(log: Column) -> Column:
    """The exponential, NULL where it is beyond the range of a double; the logarithm says how large it is."""
    return F.when(log < MAX_LOG, F.exp(log))


def log_product(x: Column) -> Column:
    """Aggregate: the logarithm of the product of positive factors; NULL if one is not positive."""
    return F.when(F.count_if(x <= 0) == 0, F.sum(F.when(x > 0, F.log(x))))


def product(x: Column) -> Column:
    """Aggregate: the product from logarithms, sign and zeros, so that no step leaves the range of doubles; NULL if the result does."""
    size = exp_in_range(F.sum(F.when(x != 0, F.log(F.abs(x)))))
    sign = F.when(F.count_if(x < 0) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.count_if(x == 0) > 0, 0.0).otherwise(sign * size)


def share(condition: Column) -> Column:
    """Share of the rows with a known condition for which it holds."""
    return F.avg(condition.cast("double"))


def attach(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Put the columns of a global aggregate next to every row. ``totals`` has one row, because it has no keys."""
    return df.crossJoin(F.broadcast(totals))
