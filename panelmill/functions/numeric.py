"""Column helpers for doubles: Spark keeps NaN apart from NULL and ANSI division raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column | str) -> Column:
    """c where it is a finite number, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def is_finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are finite; NULL for fewer than two rows or no variance.

    F.corr raises under ANSI for a constant input, so it is built from covariance and deviations.
    """
    ok = is_finite(x) & is_finite(y)
    a, b = F.when(ok, x), F.when(ok, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def skew_sample(c: Column) -> Column:
    """Bias-adjusted skewness (NULL below three values or without variance)."""
    n, m, m2, m3 = F.count(c).cast("double"), F.avg(c), F.avg(c * c), F.avg(c * c * c)
    var = m2 - m * m
    pop = F.try_divide(m3 - 3 * m * m2 + 2 * m * m * m, F.pow(F.greatest(var, F.lit(0.0)), F.lit(1.5)))
    return F.when(F.count(c) > 2, pop * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def rounded(c: Column, digits: int) -> Column:
    """Half-even rounding without a negative zero."""
    return F.bround(c, digits) + F.lit(0.0)
