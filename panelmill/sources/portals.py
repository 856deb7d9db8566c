"""Pricing and group portals: thin, lazy objects the reports read from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.dates import annualization, to_period
from panelmill.operators.panel import positions
from panelmill.operators.returns import simple_returns
from panelmill.session import written
from panelmill.sources.query import Query


class BasePortal:
    """What every portal offers: name and assets; prices have periods and delta_data, groups group_information and group_mapping."""

    name = "portal"

    @property
    def assets(self) -> DataFrame:
        raise NotImplementedError

    @property
    def periods(self) -> DataFrame:
        raise NotImplementedError

    @property
    def delta_data(self) -> DataFrame:
        raise NotImplementedError

    @property
    def group_information(self) -> DataFrame:
        raise NotImplementedError

    @property
    def group_mapping(self) -> dict:
        """{id: group} on the driver, for small universes."""
        raise NotImplementedError


class PricingPortal(BasePortal):
    """Returns of assets: adjusted prices of the table on exchange days, missing prices left out, at a frequency other than daily the
    last of each period, then simple returns."""

    name = "pricing"

    def __init__(self, query: Query, assets, search_by: str, start_date: str, end_date: str, field: str = "prc", table: str = "crsp.sd", freq: str = "D", calendar="NYSE"):
        annualization(freq)
        q = query.query_timeseries_table(table, [field], assets, search_by, start_date, end_date).dropna(field).distinct()
        if calendar is not None:
            # days without a price would be dropped again: the calendar only selects
            q = q._with(q.df.join(q.calendar_days(calendar), "date", "left_semi"))
        self.freq, self.id = freq, search_by
        prices = q.df.select("date", F.col(search_by).alias("id"), F.col(field).alias("price"))
        if freq != "D":  # the last price of a period
            prices = prices.groupBy(to_period("date", freq).alias("date"), "id").agg(F.max_by("price", "date").alias("price"))
        # written once: ids, dates and prices of the grid of returns are read from it
        self.prices = written(prices, "prices")
        self.returns = simple_returns(self.prices)

    @classmethod
    def from_prices(cls, prices: DataFrame, freq: str = "D") -> PricingPortal:
        """From a (date, id, price) frame."""
        self = cls.__new__(cls)
        self.freq, self.id, self.prices, self.returns = freq, "id", prices, simple_returns(prices)
        return self

    @property
    def assets(self) -> DataFrame:
        return self.returns.select("id").distinct()

    @property
    def periods(self) -> DataFrame:
        return positions(self.returns).select("date")

    @property
    def delta_data(self) -> DataFrame:
        return self.returns


class SectorPortal(BasePortal):
    """A static group per asset; no group is -1. An asset with several rows has the least group."""

    name = "groups"

    def __init__(self, query: Query, assets, search_by: str = "permno", field: str = "gsector", table: str = "link.crsp_cstat_link", id: str | None = None):
        q = query.query_no_date_table(table, [field], assets, id or search_by)
        src = q.df.select(F.col(id or search_by).alias("id"), F.coalesce(F.col(field), F.lit(-1)).alias("grp"))
        self.groups = src.where("id IS NOT NULL").groupBy("id").agg(F.min(F.when(F.col("grp") != -1, F.col("grp"))).alias("_g")).select("id", F.coalesce("_g", F.lit(-1)).alias("grp"))

    @classmethod
    def from_groups(cls, groups: DataFrame) -> SectorPortal:
        """From an (id, grp) frame with one row per id."""
        self = cls.__new__(cls)
        self.groups = groups.select("id", F.coalesce(F.col("grp"), F.lit(-1)).alias("grp"))
        return self

    @property
    def assets(self) -> DataFrame:
        return self.groups.select("id").distinct()

    @property
    def group_information(self) -> DataFrame:
        return self.groups

    @property
    def group_mapping(self) -> dict:
        return {r["id"]: r["grp"] for r in self.groups.toLocalIterator()}


class TimeVaryingGroups(BasePortal):
    """Groups valid from a date on, (id, since, grp); the group of an (id, date) is the last one known."""

    name = "time-varying groups"

    def __init__(self, changes: DataFrame):
        self.kind = changes.schema["grp"].dataType
        self.changes = changes.select("id", F.col("since").alias("date"), F.col("grp").cast("string").alias("value"))

    def at(self, panel: DataFrame) -> DataFrame:
        from panelmill.operators.asof import as_known_at

        h = self.changes.select("id", F.lit("grp").alias("attribute"), F.unix_date("date").alias("since"), "value")
        return as_known_at(panel, "id", "date", h, ["grp"], {"grp": self.kind})
