"""Trailing-period totals on a complete calendar by a bucketed range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_totals(
    daily: DataFrame,
    entity: str,
    date: str,
    amount: str,
    periods: tuple[int, ...] = (7, 30),
    bucket_days: int = 15,
) -> DataFrame:
    """Totals and averages of `amount` over each trailing period, for every calendar day of every entity's span.

    daily: at most one row per (entity, date); `amount` may be null or not finite (it then counts as no
    activity, but the row still widens the entity's span). The span runs from the first to the last date.
    Averages divide by the length of the period, so days without activity count as zero, as do days before
    the first row. Rows with a null entity or date are dropped; an empty input gives an empty result.

    Result: entity, date, total_<n>d, avg_<n>d, days_<n>d (days with activity) per period n.

    Each calendar day falls in one date bucket; each daily total is copied to the buckets from which its
    trailing bounds can be reached (3 at most for 30 days and 15-day buckets). The join is then an equi-join
    on (entity, bucket) with the bounds as residual, and the aggregate works on that same partitioning: no
    shuffle after the join. A (entity, bucket) pair holds bucket_days calendar rows and at most
    longest + bucket_days totals, whatever the entity's share of all rows.
    """
    longest = max(periods)
    rows = daily.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).select(
        F.col(entity).alias("_e"), F.unix_date(F.col(date)).alias("_d"), F.col(amount).cast("double").alias("_a")
    )
    spine = (
        rows.groupBy("_e")
        .agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
        .select("_e", F.explode(F.sequence("_lo", "_hi")).alias("_day"))
        .withColumn("_b", F.floor(F.col("_day") / bucket_days).cast("int"))
    )
    usable = F.col("_a").isNotNull() & ~F.isnan("_a") & (F.abs(F.col("_a")) < F.lit(float("inf")))
    totals = rows.where(usable).select(
        F.col("_e").alias("_te"),
        "_d",
        "_a",
        F.explode(
            F.sequence(F.floor(F.col("_d") / bucket_days).cast("int"), F.floor((F.col("_d") + longest - 1) / bucket_days).cast("int"))
        ).alias("_tb"),
    )
    back = F.col("_day") - F.col("_d")
    joined = spine.join(
        totals,
        (F.col("_e") == F.col("_te")) & (F.col("_b") == F.col("_tb")) & (back >= 0) & (back < longest),
        "left",
    )
    aggs = []
    for n in periods:
        inside = back < n
        aggs += [
            F.coalesce(F.sum(F.when(inside, F.col("_a"))), F.lit(0.0)).alias(f"total_{n}d"),
            F.count(F.when(inside, F.col("_a"))).alias(f"days_{n}d"),
        ]
    out = joined.groupBy("_e", "_b", "_day").agg(*aggs)
    cols = [F.col("_e").alias(entity), F.date_from_unix_date("_day").alias(date)]
    for n in periods:
        cols += [F.col(f"total_{n}d"), (F.col(f"total_{n}d") / F.lit(float(n))).alias(f"avg_{n}d"), F.col(f"days_{n}d")]
    return out.select(*cols)
