"""Universes and membership: intervals, long tables, ranked universes, holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.dates import trading_days
from panelmill.operators.panel import check_columns, handle_duplicates
from panelmill.sources.query import link_join


def members_by_interval(intervals: DataFrame, days: DataFrame, id: str, start: str = "from", end: str = "thru") -> DataFrame:
    """(date, id) for every calendar day inside an id's interval, both ends included.

    Each interval is exploded over its days and kept where the day is in the calendar: an equi semi join in
    place of a nested-loop range join. Intervals are cut to the calendar's range first, so a long membership
    costs the days of the window only. Null ids or starts are dropped; a null end is open.
    """
    lo, hi = days.agg(F.min("date")).scalar(), days.agg(F.max("date")).scalar()
    x = intervals.select(F.col(id), F.greatest(F.col(start).cast("date"), lo).alias("_a"), F.least(F.coalesce(F.col(end).cast("date"), hi), hi).alias("_z"), F.col(start).alias("_s"))
    x = x.where(F.col(id).isNotNull() & F.col("_s").isNotNull() & (F.col("_a") <= F.col("_z")))
    every = x.select(id, F.explode(F.sequence("_a", "_z")).alias("date"))
    return every.join(days.select("date").distinct(), "date", "left_semi").select("date", id)


class MembershipAdjuster:
    """Cuts data to the days on which an id belongs to a universe."""

    def __init__(self, spark: SparkSession, id: str = "symbol"):
        self.spark, self.id = spark, id
        self.universe: DataFrame | None = None

    def add_universe_info(self, universe: DataFrame, start_date: str, end_date: str, calendar: str | DataFrame = "NYSE") -> DataFrame:
        """Universe as intervals id, from, thru. A repeated id is an error."""
        u = check_columns([self.id, "from", "thru"], universe)
        handle_duplicates(u, "ValueError", self.id, subset=[self.id])
        days = calendar.where(F.col("date").between(start_date, end_date)) if isinstance(calendar, DataFrame) else trading_days(self.spark, start_date, end_date, calendar)
        self.universe = members_by_interval(u, days, self.id)
        return self.universe

    def add_universe_info_long(self, universe: DataFrame, start_date: str | None = None, end_date: str | None = None, closed: str = "neither") -> DataFrame:
        """Universe as rows (date, id); the dates are excluded unless closed='both'."""
        u = check_columns(["date", self.id], universe)
        if start_date is not None:
            u = u.where(F.col("date") >= F.lit(start_date).cast("date")) if closed == "both" else u.where(F.col("date") > F.lit(start_date).cast("date"))
        if end_date is not None:
            u = u.where(F.col("date") <= F.lit(end_date).cast("date")) if closed == "both" else u.where(F.col("date") < F.lit(end_date).cast("date"))
        self.universe = u
        return u

    def add_universe_info_from_db(self, name: str, universes: dict, start_date: str, end_date: str) -> DataFrame:
        """A built universe: fetched with both dates, then used with both dates excluded."""
        if name not in universes:
            raise ValueError(f"Universe {name!r} is not known")
        return self.add_universe_info_long(universes[name].where(F.col("date").between(start_date, end_date)), start_date, end_date)

    def adjust_data_for_membership(self, data: DataFrame) -> DataFrame:
        """The universe's rows with the data of that day and id; a member's missing day stays as a row of nulls."""
        if self.universe is None:
            raise ValueError("Universe is not set")
        check_columns(["date", self.id], data)
        return self.universe.join(data, ["date", self.id], "left").select(*data.columns)


def market_cap_ranks(
    daily: DataFrame, id: str, price: str, shares: str, days: DataFrame, row_filter: str = "true", keep: list[str] | None = None,
    least_price: float = 3.0, window: int = 253, positive_only: bool = False,
) -> DataFrame:
    """Per date the ids ranked by trailing mean market value, from values of the row before (no look-ahead).

    daily: one row per (date, id). Steps: trading days only; price and shares of the previous row; row_filter;
    mean of |price| * shares and least |price| over the last `window` rows; rows whose least price exceeds
    least_price and whose mean is there (and positive, if positive_only); row_number by falling mean, ties by
    id. Result: date, id, keep, ttm_min_prc, ttm_mc, ttm_mc_rank.

    Two exchanges: by id for the windows, by date for the rank. `rank <= k` downstream becomes a group limit
    below that exchange.
    """
    w = W.partitionBy(id).orderBy("date")
    back = w.rowsBetween(-(window - 1), 0)
    x = daily.join(days.select("date").distinct(), "date", "left_semi")
    # NaN is a missing reading here, as in every other operator
    px, sh = F.nanvl(F.col(price), F.lit(None)), F.nanvl(F.col(shares), F.lit(None))
    x = x.select("date", id, *(keep or []), F.lag(px).over(w).alias("_p"), F.lag(sh).over(w).alias("_n"), F.expr(f"({row_filter})").alias("_ok"))
    x = x.where("_ok").select("date", id, *(keep or []), F.min(F.abs("_p")).over(back).alias("ttm_min_prc"), F.avg(F.abs("_p") * F.col("_n")).over(back).alias("ttm_mc"))
    x = x.where((F.col("ttm_min_prc") > least_price) & ((F.col("ttm_mc") > 0) if positive_only else F.col("ttm_mc").isNotNull()))
    return x.withColumn("ttm_mc_rank", F.row_number().over(W.partitionBy("date").orderBy(F.desc("ttm_mc"), id)))


def ranked_universe(ranks: DataFrame, max_rank: int, min_rank: int = 1, start_date: str = "1980-01-01", rank: str = "ttm_mc_rank") -> DataFrame:
    """Rows of a rank range after a date."""
    return ranks.where(F.col(rank).between(min_rank, max_rank) & (F.col("date") > F.lit(start_date).cast("date")))


def link_permno(df: DataFrame, gvkey_links: DataFrame, ticker_links: DataFrame, permno: str = "permno", dedup: str | None = None) -> DataFrame:
    """df with gvkey, iid, id and ticker, cusip valid on its date, both ends included: two chained left range joins.

    Overlapping links give several rows unless dedup='first', which keeps per (date, permno) the first by gvkey,
    iid, ticker. id is gvkey_iid, with an empty iid where that is null.
    """
    x = link_join(df, gvkey_links, {permno: "lpermno"}, ["gvkey", "liid"], "linkdt", "linkenddt", "linktype IN ('LU', 'LC')")
    x = x.withColumnRenamed("liid", "iid").withColumn("id", F.concat("gvkey", F.lit("_"), F.coalesce("iid", F.lit(""))))
    x = link_join(x, ticker_links, {permno: "permno"}, ["ticker", "cusip"], "sdate", "edate")
    if dedup == "first":
        w = W.partitionBy("date", permno).orderBy(F.col("gvkey").asc_nulls_last(), F.col("iid").asc_nulls_last(), F.col("ticker").asc_nulls_last())
        x = x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return x


def holdings_universe(holdings: DataFrame, days: DataFrame, fund: str, id: str) -> DataFrame:
    """(date, fund, id): holdings of the latest snapshot on every calendar day from it up to the next snapshot.

    Snapshot dates of a fund become intervals by lead(); only the intervals are exploded, and an equi-join
    brings the members back. After the last snapshot the holdings last until the calendar ends.
    """
    hi = days.agg(F.max("date")).scalar()
    h = holdings.where(F.col(id).isNotNull() & F.col(fund).isNotNull() & F.col("date").isNotNull()).select(fund, F.col("date").alias("_snap"), id).distinct()
    w = W.partitionBy(fund).orderBy("_snap")
    spans = h.select(fund, "_snap").distinct().withColumn("_until", F.coalesce(F.date_add(F.lead("_snap").over(w), -1), hi)).where("_snap <= _until")
    each = spans.select(fund, "_snap", F.explode(F.sequence("_snap", "_until")).alias("date")).join(days.select("date").distinct(), "date", "left_semi")
    return each.join(h, [fund, "_snap"]).select("date", fund, id)


def fund_id(summary: DataFrame, ticker: str | None = None, portno: int | None = None) -> int:
    """The one portfolio id of a ticker; no match and several matches are errors, the latter naming the funds."""
    if portno is not None:
        return portno
    if ticker is None:
        raise ValueError("Either a ticker or a portfolio number must be given")
    funds = summary.where((F.col("ticker") == ticker) & F.col("crsp_portno").isNotNull()).groupBy("crsp_portno").agg(F.min("fund_name"))
    got = funds.orderBy("crsp_portno").limit(20).collect()
    ids = [r[0] for r in got]
    if not ids:
        raise ValueError(f"Ticker {ticker} is not known")
    if len(ids) > 1:
        raise ValueError(f"Ticker {ticker} belongs to several funds: " + "; ".join(f"{r[0]} {r[1]}" for r in got))
    return ids[0]


def parse_fund_name(name: str) -> dict:
    """'ETF_SPY' names a ticker, 'ETF_5648362' a portfolio number."""
    kind, _, rest = name.partition("_")
    if kind.upper() != "ETF" or not rest:
        raise ValueError(f"{name!r} is not of the form ETF_<ticker or number>")
    return {"portno": int(rest)} if rest.isdigit() else {"ticker": rest.upper()}
