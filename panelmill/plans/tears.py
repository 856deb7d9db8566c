"""The report facade: six entry points that return lazy DataFrames by name."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.dates import annualization
from panelmill.operators import backtest, ic, stats, turnover
from panelmill.operators.cross import bucket_factor
from panelmill.operators.panel import check_columns, check_factor, clean_panel, positions
from panelmill.operators.returns import aligned_panel, in_factor_range
from panelmill.session import Tables, written


class Ntile:
    """Quantile reports of a factor over a pricing panel and, optionally, a group map.

    pricing: an object with .returns (date, id, ret, dense) and .freq; groups: one with .groups (id, grp). Every
    method returns {report: {output: DataFrame}}; outputs run when they are asked for. Before that only the input checks
    run, and the bucketed and the aligned panel and the series of returns are written where a report has them: all its
    outputs read these files, which clear() deletes.
    """

    def __init__(self, pricing_portal, group_portal=None):
        self.pricing, self.group = pricing_portal, group_portal
        self._held = Tables(pricing_portal.returns.sparkSession)

    def clear(self) -> None:
        self._held.clear()

    def _prepare(self, factor: DataFrame, buckets: int = 1, needs: str = "") -> tuple:
        """(factor, bucketed panel, aligned panel), of the latter two those that are needed: 'b', 'ba' or none."""
        f = clean_panel(check_columns(["date", "id", "factor"], factor), "factor")
        for text in check_factor(f, self.pricing.returns, freq=self.pricing.freq):
            warnings.warn(text, stacklevel=3)
        with self._held:
            b = written(bucket_factor(f, buckets), "bucketed") if "b" in needs else None
            a = written(aligned_panel(b, self.pricing.returns), "aligned") if "a" in needs else None
        return f, b, a

    def _inspection(self, b: DataFrame, buckets: int) -> dict:
        count, median = stats.per_date_and_bucket(b, buckets)
        return {"summary": stats.inspection(b), "count": stats.counts_per_date(b), "ntile_count": count, "ntile_median": median}

    def _backtest(self, a: DataFrame, buckets: int, hp: int, long_short: bool, market_neutral: bool, show_uni: bool, show_ntile_tilts: bool) -> dict:
        ann = annualization(self.pricing.freq)
        with self._held:  # a row per date and series, from which all outputs of returns follow
            s = written(backtest.series_returns(a, hp, buckets, self.pricing.freq, long_short, market_neutral, show_uni), "series")
        own, spread = s.where(F.startswith("series", F.lit("Ntile"))), s.where(~F.startswith("series", F.lit("Ntile")))
        place = F.expr("try_cast(substring(series, 8) AS INT)")
        out = {
            "returns": s, "cumulative": stats.cumulative_returns(s), "weights": backtest.bucket_weights(a, hp), "concentration": backtest.concentration(a, hp),
            "ntile_stats": stats.statistics(own, ann, market_neutral, place, buckets), "spread_stats": stats.statistics(spread, ann),
        }
        if self.group is not None and (show_ntile_tilts or long_short):
            share = backtest.group_shares(self.group.groups, a)
            tilts = backtest.group_tilts(backtest.member_weights(a, hp), positions(a), self.group.groups, share)
            if show_ntile_tilts:
                out |= {"tilts": tilts, "average_tilts": backtest.average_tilts(tilts)}
            if long_short:
                ls = backtest.long_short_tilts(tilts, buckets)
                out |= {"long_short_tilts": ls, "average_long_short_tilts": ls.groupBy("grp").agg(F.avg("tilt").alias("tilt"))}
        return out

    def _ic(self, f: DataFrame, hp: int) -> dict:
        daily = ic.daily_ic(f, self.pricing.returns, hp)
        return {"ic": ic.rolling_ic(daily, self.pricing.freq == "D"), "summary": ic.ic_summary(daily, hp)}

    def _turnover(self, f: DataFrame, b: DataFrame, hp: int) -> dict:
        auto, turn = turnover.autocorrelation(f, hp), turnover.bucket_turnover(b, hp)
        return {
            "autocorrelation": auto, "turnover": turn,
            "autocorrelation_summary": turnover.summarise(auto, "autocorrelation", []), "turnover_summary": turnover.summarise(turn, "turnover", ["ntile"]),
        }

    def full_tear(self, factor, buckets, holding_period, long_short=True, market_neutral=True, show_uni=False, show_ntile_tilts=False) -> dict:
        f, b, a = self._prepare(factor, buckets, "ba")
        return {
            "coverage": {"coverage": backtest.coverage(f, in_factor_range(self.pricing.returns, f))},
            "inspection": self._inspection(b, buckets),
            "backtest": self._backtest(a, buckets, holding_period, long_short, market_neutral, show_uni, show_ntile_tilts),
            "ic": self._ic(f, holding_period),
            "turnover": self._turnover(f, b, holding_period),
        }

    def ntile_backtest_tear(self, factor, buckets, holding_period, long_short=True, market_neutral=True, show_uni=False, show_ntile_tilts=False) -> dict:
        _, _, a = self._prepare(factor, buckets, "ba")
        return {"backtest": self._backtest(a, buckets, holding_period, long_short, market_neutral, show_uni, show_ntile_tilts)}

    def ntile_inspection_tear(self, factor, buckets) -> dict:
        _, b, _ = self._prepare(factor, buckets, "b")
        return {"inspection": self._inspection(b, buckets)}

    def ntile_ic_tear(self, factor, holding_period) -> dict:
        f, _, _ = self._prepare(factor)
        return {"ic": self._ic(f, holding_period)}

    def ntile_turnover_tear(self, factor, buckets, holding_period) -> dict:
        f, b, _ = self._prepare(factor, buckets, "b")
        return {"turnover": self._turnover(f, b, holding_period)}

    def ntile_ic_horizon(self, factor, intervals, show_individual=False) -> dict:
        f, _, _ = self._prepare(factor)
        out = {"horizon": {"summary": ic.ic_horizon(f, self.pricing.returns, list(intervals))}}
        if show_individual:
            out |= {f"ic_{h}": self._ic(f, h) for h in sorted(set(intervals))}
        return out
