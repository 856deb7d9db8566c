"""Return statistics per series in one grouped job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.numeric import rounded
from panelmill.operators.returns import cumulative
from panelmill.session import let_workers_import


def sharpe(ret: Column, ann: int) -> Column:
    return F.try_divide(F.avg(ret), F.stddev_samp(ret)) * F.sqrt(F.lit(float(ann)))


def cagr(ret: Column, ann: int) -> Column:
    """Percent a year; the zero row counts as a period."""
    return (F.pow(F.product(1 + ret), F.lit(float(ann)) / F.count(ret)) - 1) * 100


def annual_volatility(ret: Column, ann: int) -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(ann))) * 100


def share_up(ret: Column) -> Column:
    return F.avg((ret > 0).cast("double"))


def cumulative_returns(series: DataFrame) -> DataFrame:
    """(date, series, cum): growth of 1."""
    return series.select("date", "series", cumulative("ret", ["series"]).alias("cum"))


def drawdowns(series: DataFrame, ret: str = "ret") -> DataFrame:
    """series rows with dd: fall from the running maximum of the growth of 1, the start included."""
    w = W.partitionBy("series").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    x = series.withColumn("_cum", cumulative(ret, ["series"]))
    return x.withColumn("dd", F.try_divide(F.col("_cum"), F.greatest(F.lit(1.0), F.max("_cum").over(w))) - 1).drop("_cum")


def flip_lower_half(series: DataFrame, position: Column, count: int) -> DataFrame:
    """Negate the returns of the lower half of the buckets (position > ceil(n / 2)); null for the middle one of an odd number."""
    return series.withColumn("ret", _held(position, count))


def _held(position: Column, count: int) -> Column:
    half = -(-count // 2)
    r = F.when((position == half) & F.lit(count % 2 == 1), F.lit(None)).when(position > half, -F.col("ret")).otherwise(F.col("ret"))
    return r.cast("double")


def max_drawdown(series: DataFrame) -> DataFrame:
    """(series, max_drawdown): percent."""
    return drawdowns(series).groupBy("series").agg((F.min("dd") * 100).alias("max_drawdown"))


def statistics(series: DataFrame, ann: int, flip: bool = False, position: Column | None = None, count: int = 0) -> DataFrame:
    """One row per series: Sharpe ratio, CAGR, volatility and drawdown in percent, share of periods up.

    series: (date, series, ret). With flip, drawdowns of the lower buckets are those of holding them short.
    One window and one aggregate, both partitioned by series; a series has one row a date.
    """
    ret = F.col("ret")
    x = series.withColumn("_held", _held(position, count) if flip else ret)
    return drawdowns(x, "_held").groupBy("series").agg(
        sharpe(ret, ann).alias("sharpe"), cagr(ret, ann).alias("cagr"), annual_volatility(ret, ann).alias("annual_vol"),
        (F.min("dd") * 100).alias("max_drawdown"), share_up(ret).alias("periods_up"),
    )


def per_series(series: DataFrame, name: str, func: Callable) -> DataFrame:
    """A statistic of the caller's: a Column expression over 'ret', or a pandas function run as a grouped aggregate."""
    try:
        c = func(F.col("ret"))
    except Exception:
        c = None
    if isinstance(c, Column):
        return series.groupBy("series").agg(c.alias(name))
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], name: [float(func(pdf.sort_values("date")["ret"]))]})

    let_workers_import(series.sparkSession)
    return series.groupBy("series").applyInPandas(run, f"series string, `{name}` double")


def inspection(bucketed: DataFrame) -> DataFrame:
    """Factor summary per bucket: median, deviation, least, greatest (rounded to 2), count and percent of all."""
    g = bucketed.groupBy("ntile").agg(
        rounded(F.median("factor"), 2).alias("median"), rounded(F.stddev_samp("factor"), 2).alias("std"),
        rounded(F.min("factor"), 2).alias("min"), rounded(F.max("factor"), 2).alias("max"), F.count("*").alias("count"),
    )
    return g.withColumn("count_pct", rounded(F.col("count") * 100.0 / F.sum("count").over(W.partitionBy(F.lit(1))), 2))


def counts_per_date(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("date").agg(F.count("*").alias("count"))


def per_date_and_bucket(bucketed: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Counts and exact medians per date, one column per bucket: the bucket list is given, so the pivot needs no extra job."""
    p = bucketed.groupBy("date").pivot("ntile", list(range(1, buckets + 1)))
    return p.agg(F.count("factor")), p.agg(F.median("factor"))
