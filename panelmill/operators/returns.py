"""Returns over date positions: simple, forward, cumulative; rolling sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.numeric import finite
from panelmill.operators.panel import positions
from panelmill.session import fetched

LOWEST, HIGHEST = -0.75, 1.5


def simple_returns(prices: DataFrame) -> DataFrame:
    """(date, id, ret, pos) from (date, id, price), at most one row per (date, id): dense over all dates and ids from the second date on.

    A gap carries the last price forward, so its return is 0 and the move falls on the day prices resume.
    Missing and infinite returns become 0; the rest is clipped to [-0.75, 1.5]. pos numbers the dates from 1 for
    the first date of all.

    The dates are fetched once. Rows are windowed by id and each is exploded over the dates up to the id's next row (the
    first one also back to the first date), so the dense rows need no join with a grid; an id's rows are bounded by the dates.
    """
    p = prices.where("id IS NOT NULL").select("date", "id", finite(F.col("price").cast("double")).alias("price"))
    days = fetched(positions(p))
    w = W.partitionBy("id").orderBy("pos")
    x = p.join(days, "date").withColumn("_px", F.last("price", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    end = days.agg(F.max("pos")).scalar()
    x = x.select(
        "id", F.col("pos").alias("_at"), (F.try_divide(F.col("_px"), F.lag("_px").over(w)) - 1).alias("_r"),
        F.when(F.lag("pos").over(w).isNull(), 1).otherwise(F.col("pos")).alias("_from"), F.coalesce(F.lead("pos").over(w) - 1, end).alias("_to"),
    )
    g = x.where("_from <= _to").select("id", "_at", "_r", F.explode(F.sequence("_from", "_to")).alias("pos")).where("pos > 1").join(days, "pos")
    r = F.coalesce(F.when(F.col("pos") == F.col("_at"), finite("_r")), F.lit(0.0))
    return g.select("date", "id", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), r)).alias("ret"), "pos")


def forward_returns(returns: DataFrame, hp: int) -> DataFrame:
    """(date, id, fwd): the compounded return of the next hp dates; null for the last hp dates. returns is dense."""
    return forward_returns_of(returns, {"fwd": hp})


def forward_returns_of(returns: DataFrame, periods: dict[str, int]) -> DataFrame:
    """(date, id, and per name the compounded return of so many next dates), over one partitioning and sort."""
    w = W.partitionBy("id").orderBy("date")

    def ahead(hp: int) -> Column:
        f = w.rowsBetween(1, hp)
        return F.when(F.count("*").over(f) == hp, F.product(1 + F.col("ret")).over(f) - 1)

    return returns.select("date", "id", *[ahead(hp).alias(name) for name, hp in periods.items()])


def in_factor_range(returns: DataFrame, factor: DataFrame) -> DataFrame:
    """Returns between the first and the last factor date; the two bounds are scalar subqueries."""
    lo, hi = factor.agg(F.min("date")).scalar(), factor.agg(F.max("date")).scalar()
    return returns.where((F.col("date") >= lo) & (F.col("date") <= hi))


def cumulative(ret: str, keys: list[str], order: str = "date") -> Column:
    """Compounded growth of 1 up to each row."""
    return F.product(1 + F.col(ret)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def pct_change(value: str, n: int, keys: list[str], order: str = "date") -> Column:
    """Relative change over n rows."""
    return F.try_divide(F.col(value), F.lag(value, n).over(W.partitionBy(*keys).orderBy(order))) - 1


def rolling_sum(value: str, n: int, keys: list[str], order: str = "date") -> Column:
    """Sum of the last n rows, null until there are n."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count("*").over(w) == n, F.sum(value).over(w))


def pad_extra_day(df: DataFrame, freq: str, value: float, column: str) -> DataFrame:
    """One more row before the first date, with a constant."""
    from panelmill.functions.dates import period_before

    first = df.agg(F.min("date").alias("date")).select(period_before(F.col("date"), freq).alias("date"), F.lit(float(value)).alias(column))
    return first.where("date IS NOT NULL").unionByName(df.select("date", column))


def aligned_panel(bucketed: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns in the factor's date range with the bucket each id was in: (date, pos, id, ret, factor, ntile).

    A left join onto the returns grid; ids without a bucket that day keep null. pos numbers the dates in range.
    """
    r = in_factor_range(returns, bucketed)
    if "pos" in returns.columns:  # numbered already: shift to the first date in range
        r = r.select("date", "id", "ret", (F.col("pos") - r.agg(F.min("pos")).scalar() + 1).alias("pos"))
    else:
        r = r.select("date", "id", "ret").join(fetched(positions(r)), "date")
    return r.join(bucketed.select("date", "id", "factor", "ntile"), ["date", "id"], "left").select("date", "pos", "id", "ret", "factor", "ntile")
