"""Information coefficients: per-date correlation of factor and forward returns, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.numeric import corr, skew_sample, rounded
from panelmill.operators.returns import forward_returns, forward_returns_of, in_factor_range


def daily_ic(factor: DataFrame, returns: DataFrame, hp: int) -> DataFrame:
    """(date, ic): Pearson correlation over the ids of a date; dates without two pairs keep a null ic."""
    fwd = forward_returns(in_factor_range(returns, factor), hp)
    x = factor.select("date", "id", "factor").join(fwd, ["date", "id"], "left")
    return x.groupBy("date").agg(corr(F.col("factor"), F.col("fwd")).alias("ic"))


def rolling_ic(ic: DataFrame, daily: bool) -> DataFrame:
    """ic with its mean over 21 rows (daily) or 12; null until the window is full and while it holds a null.

    One row per date: the window runs over the dates alone.
    """
    n = 21 if daily else 12
    w = W.orderBy("date").rowsBetween(-(n - 1), 0)
    return ic.withColumn("ic_mean", F.when(F.count("ic").over(w) == n, F.avg("ic").over(w)))


def ic_aggregates(c: str = "ic") -> list[Column]:
    x = F.col(c)
    return [
        rounded(F.avg(x), 3).alias("mean"), rounded(F.median(x), 3).alias("median"), rounded(F.stddev_samp(x), 3).alias("std"),
        rounded(F.try_divide(F.avg(x), F.stddev_samp(x)), 3).alias("mean_std"), rounded(skew_sample(x), 3).alias("skew"),
    ]


def ic_summary(ic: DataFrame, hp: int) -> DataFrame:
    """One row per holding period: mean, median, deviation, their ratio and bias-adjusted skew, rounded to 3."""
    return ic.agg(*ic_aggregates()).select(F.lit(f"{hp}D").alias("horizon"), "*")


def ic_horizon(factor: DataFrame, returns: DataFrame, intervals: list[int]) -> DataFrame:
    """ic_summary for each holding period. All periods are columns over one window partitioning, one join and one aggregate
    per date; only the dates' correlations become rows."""
    periods = sorted(set(intervals))
    if not periods:
        raise ValueError("intervals must not be empty")
    fwd = forward_returns_of(in_factor_range(returns, factor), {f"_f{h}": h for h in periods})
    x = factor.select("date", "id", "factor").join(fwd, ["date", "id"], "left")
    daily = x.groupBy("date").agg(*[corr(F.col("factor"), F.col(f"_f{h}")).alias(f"_{h}") for h in periods])
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("hp"), F.col(f"_{h}").alias("ic")) for h in periods]))
    return daily.select(each.alias("_x")).select("_x.hp", "_x.ic").groupBy("hp").agg(*ic_aggregates()).select(F.concat(F.col("hp").cast("string"), F.lit("D")).alias("horizon"), "mean", "median", "std", "mean_std", "skew")
