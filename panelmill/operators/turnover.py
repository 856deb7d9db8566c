"""Factor autocorrelation and bucket turnover by date positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.numeric import corr, rounded
from panelmill.operators.panel import positions
from panelmill.session import fetched


def lagged(panel: DataFrame, value: str, h: int) -> DataFrame:
    """panel (with pos) and _prev: the value of the same id h date positions earlier, by a join on (id, position).

    Not lag(): an id with gaps would get the value of another position.
    """
    back = panel.select("id", (F.col("pos") + h).alias("pos"), F.col(value).alias("_prev"))
    return panel.join(back, ["id", "pos"], "left")


def autocorrelation(factor: DataFrame, h: int) -> DataFrame:
    """(date, autocorrelation): cross-sectional correlation of the factor with itself h positions earlier."""
    p = factor.select("date", "id", "factor").join(fetched(positions(factor)), "date")
    return lagged(p, "factor", h).groupBy("date").agg(corr(F.col("factor"), F.col("_prev")).alias("autocorrelation"))


def bucket_turnover(bucketed: DataFrame, h: int, buckets: int | None = None, drop_warmup: bool = False) -> DataFrame:
    """(date, ntile, turnover): share of a bucket's members that were not in it h positions before, for the first
    and the last bucket (the largest that occurs, unless given).

    Only these two buckets are looked back into; an id that was in neither counts as changed, so the first h
    dates are 1 (left out with drop_warmup).
    """
    last = F.lit(buckets) if buckets else bucketed.agg(F.max("ntile")).scalar()
    p = bucketed.select("date", "id", "ntile").where((F.col("ntile") == 1) | (F.col("ntile") == last)).join(fetched(positions(bucketed)), "date")
    x = lagged(p, "ntile", h)
    out = x.groupBy("date", "pos", "ntile").agg(F.avg(F.coalesce((F.col("ntile") != F.col("_prev")).cast("double"), F.lit(1.0))).alias("turnover"))
    return (out.where(F.col("pos") > h) if drop_warmup else out).select("date", "ntile", "turnover")


def summarise(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean, median and sample deviation, rounded to 3."""
    x = F.col(value)
    return df.groupBy(*by).agg(rounded(F.avg(x), 3).alias("mean"), rounded(F.median(x), 3).alias("median"), rounded(F.stddev_samp(x), 3).alias("std"))
