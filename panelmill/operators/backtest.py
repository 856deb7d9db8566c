"""Overlapping equal-weight bucket portfolios: weights, returns, spreads, group tilts, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.dates import period_before
from panelmill.functions.numeric import is_finite
from panelmill.operators.panel import positions
from panelmill.session import fetched

#: A single weight above this share is reported.
CONCENTRATED = 0.05


def bucket_counts(aligned: DataFrame) -> DataFrame:
    """(date, ntile, n): members per bucket and date after alignment with the returns."""
    return aligned.where("ntile IS NOT NULL").groupBy("date", "ntile").agg(F.count("*").alias("n"))


def _members(aligned: DataFrame, hp: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows of aligned in a bucket, with w, a member's weight on each of the hp dates from its own on. counted: the panel in
    which members are counted, if not this."""
    # counts are partial aggregates, a row per date and bucket: no bucket is gathered in a task to be counted
    n = fetched(bucket_counts(aligned if counted is None else counted))
    return aligned.where("ntile IS NOT NULL").join(n, ["date", "ntile"]).withColumn("w", 1 / (F.col("n") * hp)).drop("n")


def member_weights(aligned: DataFrame, hp: int) -> DataFrame:
    """(pos, id, ntile, weight): one row for each membership and each of the hp date positions it lasts, from position hp on.

    Sums over it are those over bucket_weights, but need no exchange by id first. The last position bounds the explosion.
    """
    last = aligned.agg(F.max("pos")).scalar()
    m = _members(aligned, hp).select("pos", "id", "ntile", F.col("w").alias("weight")).withColumn("_last", F.least(F.col("pos") + (hp - 1), last))
    return m.select("id", "ntile", "weight", F.explode(F.sequence("pos", "_last")).alias("pos")).where(F.col("pos") >= hp).select("pos", "id", "ntile", "weight")


def bucket_weights(aligned: DataFrame, hp: int) -> DataFrame:
    """(pos, id, ntile, weight): each id's share of each bucket on each date position from hp on.

    A date's members weigh 1 / (members * hp) on that and the following hp - 1 positions; weights of overlapping
    starts add up. Each membership is exploded to its hp positions and summed: rows * hp, no dense grid.
    """
    return member_weights(aligned, hp).groupBy("pos", "id", "ntile").agg(F.sum("weight").alias("weight"))


def bucket_returns(aligned: DataFrame, hp: int, buckets: int, freq: str) -> DataFrame:
    """(date, ntile, ret): same-day return of every bucket on every date position from hp on, after a zero row.

    The zero row stands at the position before the first one, or a period before the first date for hp = 1. A
    bucket without members has return 0.

    An id's returns of the hp positions from a date on are gathered over one window by id; each membership then gives
    its weighted returns to these positions, summed map-side to a row per position and bucket. So the panel is shuffled
    once, by id, whatever hp is.
    """
    w = W.partitionBy("id").orderBy("pos").rangeBetween(0, hp - 1)
    ahead = aligned.select("date", "pos", "id", "ntile", F.collect_list(F.struct("pos", "ret")).over(w).alias("_ahead"))
    each = _members(ahead, hp, aligned).select("ntile", "w", F.explode("_ahead").alias("_a")).select("ntile", "w", "_a.pos", "_a.ret").where(F.col("pos") >= hp)
    r = each.groupBy("pos", "ntile").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    dates = positions(aligned)
    every = dates.where(F.col("pos") >= hp).select("date", "pos", F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("ntile"))
    body = every.join(r, ["pos", "ntile"], "left").select("date", "ntile", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    zero = zero_date(dates, hp, freq).select("date", F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("ntile"), F.lit(0.0).alias("ret"))
    return body.unionByName(zero)


def zero_date(dates: DataFrame, hp: int, freq: str) -> DataFrame:
    """The date of the zero row: one row, or none without dates."""
    if hp == 1:
        return dates.where("pos = 1").select(period_before(F.col("date"), freq).alias("date"))
    return dates.where(F.col("pos") == hp - 1).select("date")


def universe_returns(aligned: DataFrame, hp: int, freq: str) -> DataFrame:
    """(date, ret): equal weight over all ids in any bucket that day, on the same dates as the buckets."""
    dates = positions(aligned)
    r = aligned.where("ntile IS NOT NULL").groupBy("date").agg(F.avg("ret").alias("ret"))
    body = dates.where(F.col("pos") >= hp).join(r, "date", "left").select("date", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    return body.unionByName(zero_date(dates, hp, freq).select("date", F.lit(0.0).alias("ret")))


def series_returns(aligned: DataFrame, hp: int, buckets: int, freq: str, long_short: bool = True, market_neutral: bool = True, show_uni: bool = False) -> DataFrame:
    """(date, series, ret) of the whole report in long form: 'Ntile: k', 'universe', '1 vs N' and '2 vs N-1'.

    market_neutral subtracts the universe from every bucket; spreads are half the difference of two buckets,
    which that leaves unchanged.
    """
    b = bucket_returns(aligned, hp, buckets, freq)
    u = universe_returns(aligned, hp, freq).select("date", F.lit(0).alias("ntile"), "ret")
    # one row per date with all buckets, from which every series follows: no self-joins
    of = lambda k: F.max(F.when(F.col("ntile") == k, F.col("ret")))
    wide = b.unionByName(u).groupBy("date").agg(*[of(k).alias(f"_{k}") for k in range(buckets + 1)])
    less = F.col("_0") if market_neutral else F.lit(0.0)
    series = [(f"Ntile: {k}", F.col(f"_{k}") - less) for k in range(1, buckets + 1)]
    if show_uni:
        series.append(("universe", F.col("_0")))
    if long_short:
        pairs = [(1, buckets)] + ([(2, buckets - 1)] if buckets > 3 else [])
        series += [(f"{x} vs {z}", (F.col(f"_{x}") - F.col(f"_{z}")) / 2) for x, z in pairs]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), c.alias("ret")) for n, c in series]))
    return wide.select("date", each.alias("_s")).select("date", "_s.series", "_s.ret")


def concentration(aligned: DataFrame, hp: int, most: float = CONCENTRATED) -> DataFrame:
    """(date, ntile, weight): dates on which one member of a bucket weighs more than `most` before averaging over hp."""
    return bucket_counts(aligned).select("date", "ntile", (1 / (F.col("n") * hp)).alias("weight")).where(F.col("weight") > most)


def group_shares(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """(grp, share): share of each group among the ids; an id without group is in group -1."""
    g = ids.select("id").distinct().join(groups, "id", "left").select(F.coalesce(F.col("grp"), F.lit(-1)).alias("grp"))
    per = g.groupBy("grp").agg(F.count("*").alias("n"))
    return per.select("grp", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


def group_tilts(weights: DataFrame, dates: DataFrame, groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(date, ntile, grp, tilt): weight of each group in a bucket less the group's share of the universe.

    weights: (pos, id, ntile, weight), of member_weights or bucket_weights. Every group of the universe appears on every date and bucket that has
    weights; without a member its tilt is minus its share.
    """
    g = weights.join(groups, "id", "left").groupBy("pos", "ntile", F.coalesce(F.col("grp"), F.lit(-1)).alias("grp")).agg(F.sum("weight").alias("weight"))
    # the few groups as one array: no cross join
    every = shares.agg(F.collect_list(F.struct("grp", "share"))).scalar()
    grid = weights.select("pos", "ntile").distinct().select("pos", "ntile", F.explode(every).alias("_g")).select("pos", "ntile", "_g.grp", "_g.share")
    t = grid.join(g, ["pos", "ntile", "grp"], "left").select("pos", "ntile", "grp", (F.coalesce("weight", F.lit(0.0)) - F.col("share")).alias("tilt"))
    return t.join(fetched(dates), "pos").select("date", "ntile", "grp", "tilt")


def average_tilts(tilts: DataFrame) -> DataFrame:
    """(ntile, grp, tilt): mean of the daily tilts."""
    return tilts.groupBy("ntile", "grp").agg(F.avg("tilt").alias("tilt"))


def long_short_tilts(tilts: DataFrame, buckets: int) -> DataFrame:
    """(date, grp, tilt): tilt of bucket 1 less that of the last bucket."""
    sign = F.when(F.col("ntile") == 1, F.col("tilt")).when(F.col("ntile") == buckets, -F.col("tilt"))
    return tilts.where(F.col("ntile").isin(1, buckets)).groupBy("date", "grp").agg(F.sum(sign).alias("tilt"))


def coverage(factor: DataFrame, returns: DataFrame) -> DataFrame:
    """One row with four percentages of the factor rows: missing factor; finite factors lost as (date, id) has no
    returns row in the grid; finite factors without a usable return; and their sum, 'unusable', which counts the
    last two from all finite factors and so may count a row twice."""
    f = factor.select("date", "id", "factor")
    j = f.join(returns.select("date", "id", F.lit(1).alias("_there"), F.col("ret").alias("_ret")), ["date", "id"], "left")
    ok = is_finite("factor")
    pct = lambda c: F.try_divide(F.count_if(c) * 100.0, F.count("*"))
    return j.agg(
        pct(~F.coalesce(ok, F.lit(False))).alias("missing"),
        pct(ok & F.col("_there").isNull()).alias("lost_in_alignment"),
        pct(ok & (F.col("_ret").isNull() | F.isnan("_ret"))).alias("lost_for_returns"),
    ).withColumn("unusable", F.col("missing") + F.col("lost_in_alignment") + F.col("lost_for_returns"))
