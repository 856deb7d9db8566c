"""One query per operator over the project's tables, each with its SQL.

Panels: supplier-month (`pm`: price = sum of prices over sum of quantities, factor = quantity), the two daily
security files with their standing rows, the link tables and the market-cap ranking. Derived doubles are rounded
to 6 digits on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.dates import SPECIAL_CLOSINGS, DateConfig, annualization, period_end, period_name, to_period, trading_days
from panelmill.functions.numeric import corr
from panelmill.operators import backtest, ic, stats, turnover
from panelmill.operators.cross import bucket_factor, ntile_columns, rank_columns, robust_scores
from panelmill.operators.membership import MembershipAdjuster, holdings_universe, link_permno, market_cap_ranks, members_by_interval, ranked_universe
from panelmill.operators.panel import check_columns, clean_factor, factor_facts, finite_filter, positions, price_pivot
from panelmill.operators.returns import aligned_panel, forward_returns, pad_extra_day, pct_change, rolling_sum, simple_returns
from panelmill.operators.standing import standing_rows, standing_sql
from panelmill.operators.walkforward import LeastSquares, fold_table, walk_forward
from panelmill.plans.tears import Ntile
from panelmill.session import fetched, read, written
from panelmill.sources.portals import PricingPortal, SectorPortal
from panelmill.sources.query import Query, forward_fill

N, HP = 5, 3
#: Value columns in the order that decides between rows of one key and loaded_at. A query that reads only the first few
#: of them picks by these, and its values are the same.
CRSP_FIELDS, CSTAT_FIELDS, ISSUE_FIELDS = ["prc", "shrout", "shrcd", "cfacpr", "cfacshr"], ["prccd", "cshoc", "ajexdi"], ["priusa", "fic", "tpci", "curcdd"]
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            # + 0: no negative zero on either side
            _SQL[f.__name__] = re.sub(r"\bround(_even)?\(", r"0 + round\1(", sql)
        return f

    return keep


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


# ---- panels -----------------------------------------------------------------------------------------------------


def pm(s: SparkSession, d: str) -> DataFrame:
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    x = read(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), to_period("l_shipdate", "M").alias("date"))
    return x.agg(F.sum("l_quantity").alias("factor"), (money / F.sum("l_quantity")).alias("price"))


def pm_both(s, d) -> tuple[DataFrame, DataFrame]:
    """(factor, returns) of one panel, written once: factor, prices, ids and dates are read from it, not each from the line items."""
    p = written(pm(s, d), "panel")
    return p.select("date", "id", "factor"), simple_returns(p.select("date", "id", "price"))


def pm_factor(s, d) -> DataFrame:
    return pm(s, d).select("date", "id", "factor")


def pm_returns(s, d) -> DataFrame:
    return pm_both(s, d)[1]


def pm_aligned(s, d) -> DataFrame:
    """Written once: weights, dates and universe all read it."""
    f, r = pm_both(s, d)
    return written(aligned_panel(bucket_factor(f, N), r), "aligned")


def groups(s, d) -> DataFrame:
    n = read(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("grp"))
    return read(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), "grp")


def crsp(s, d, *cols: str) -> DataFrame:
    return standing_rows(read(s, d, "crsp_sd"), ["permno", "date"], list(cols))


def q(s, d, freq: str = "D") -> Query:
    cal = read(s, d, "trading_cal").select(F.col("trading_days").alias("date"))
    tables = {
        "crsp.sd": crsp(s, d, *CRSP_FIELDS),
        "crsp.raw": read(s, d, "crsp_sd"),
        "cstat.sd": standing_rows(read(s, d, "cstat_sd"), ["gvkey", "iid", "date"], CSTAT_FIELDS).withColumn("id", F.concat("gvkey", F.lit("_"), "iid")),
        "link.crsp_cstat_link": read(s, d, "crsp_cstat_link"),
        "calendar": cal,
    }
    top = read(s, d, "temp_rank_crsp_mc").where("ttm_mc_rank <= 20").select("date", "permno")
    return Query(s, tables, {"TOP_20": top}, freq)


def calendar(s, d) -> DataFrame:
    return read(s, d, "trading_cal").select(F.col("trading_days").alias("date"))


_PM = """pm AS (SELECT l_suppkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS factor,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS price FROM lineitem GROUP BY 1, 2)"""
_NT = f"""{_PM}, nt AS (SELECT date, id, factor, ntile({N}) OVER (PARTITION BY date ORDER BY factor DESC, id) AS ntile FROM pm)"""
_RET = """dd AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM pm)),
 gr AS (SELECT dd.date, dd.pos, i.id, pm.price FROM dd CROSS JOIN (SELECT DISTINCT id FROM pm) i LEFT JOIN pm ON pm.date = dd.date AND pm.id = i.id),
 fl AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM gr),
 rr AS (SELECT date, pos, id, px / nullif(lag(px) OVER (PARTITION BY id ORDER BY pos), 0) - 1 AS r FROM fl),
 ret AS (SELECT date, pos - 1 AS pos, id, greatest(-0.75, least(1.5, coalesce(r, 0))) AS ret FROM rr WHERE pos > 1)"""
_AL = f"""{_NT}, {_RET}, al AS (SELECT ret.date, ret.pos, ret.id, ret.ret, nt.factor, nt.ntile FROM ret LEFT JOIN nt ON nt.date = ret.date AND nt.id = ret.id),
 mp AS (SELECT max(pos) AS mp FROM al),
 wt AS (SELECT p.pos, a.id, a.ntile, sum(a.w) AS weight FROM (SELECT pos, id, ntile, 1.0 / CAST(count(*) OVER (PARTITION BY date, ntile) * {HP} AS DOUBLE) AS w FROM al WHERE ntile IS NOT NULL) a
  JOIN (SELECT DISTINCT pos FROM al) p ON p.pos BETWEEN a.pos AND a.pos + {HP - 1} WHERE p.pos >= {HP} GROUP BY 1, 2, 3),
 ds AS (SELECT DISTINCT date, pos FROM al),
 br AS (SELECT ds.date, k.ntile, coalesce(sum(wt.weight * al.ret), 0) AS ret FROM ds CROSS JOIN (SELECT unnest(range(1, {N + 1})) AS ntile) k
  LEFT JOIN wt ON wt.pos = ds.pos AND wt.ntile = k.ntile LEFT JOIN al ON al.pos = wt.pos AND al.id = wt.id WHERE ds.pos >= {HP} GROUP BY 1, 2
  UNION ALL SELECT ds.date, k.ntile, 0 FROM ds CROSS JOIN (SELECT unnest(range(1, {N + 1})) AS ntile) k WHERE ds.pos = {HP - 1}),
 un AS (SELECT ds.date, coalesce(avg(al.ret), 0) AS ret FROM ds LEFT JOIN al ON al.date = ds.date AND al.ntile IS NOT NULL WHERE ds.pos >= {HP} GROUP BY 1
  UNION ALL SELECT date, 0 FROM ds WHERE pos = {HP - 1}),
 se AS (SELECT br.date, 'Ntile: ' || br.ntile AS series, br.ret - un.ret AS ret FROM br JOIN un ON un.date = br.date
  UNION ALL SELECT date, 'universe', ret FROM un
  UNION ALL SELECT date, '1 vs {N}', (sum(CASE WHEN ntile = 1 THEN ret WHEN ntile = {N} THEN -ret END)) / 2 FROM br GROUP BY 1
  UNION ALL SELECT date, '2 vs {N - 1}', (sum(CASE WHEN ntile = 2 THEN ret WHEN ntile = {N - 1} THEN -ret END)) / 2 FROM br GROUP BY 1)"""
_GRP = """g AS (SELECT s_suppkey AS id, coalesce(n_regionkey, -1) AS grp FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey),
 sh AS (SELECT coalesce(g.grp, -1) AS grp, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM (SELECT DISTINCT id FROM al) i LEFT JOIN g ON g.id = i.id GROUP BY 1),
 ti AS (SELECT ds.date, x.ntile, sh.grp, coalesce(w.weight, 0) - CAST(sh.share AS DOUBLE) AS tilt FROM (SELECT DISTINCT pos, ntile FROM wt) x CROSS JOIN sh JOIN ds ON ds.pos = x.pos
  LEFT JOIN (SELECT wt.pos, wt.ntile, coalesce(g.grp, -1) AS grp, sum(wt.weight) AS weight FROM wt LEFT JOIN g ON g.id = wt.id GROUP BY 1, 2, 3) w ON w.pos = x.pos AND w.ntile = x.ntile AND w.grp = sh.grp)"""
_FWD = """fw AS (SELECT date, id, CASE WHEN count(*) OVER w = {hp} THEN product(1 + ret) OVER w - 1 END AS fwd FROM ret
  WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {hp} FOLLOWING))"""
_CORR = "CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) > 1 THEN CASE WHEN isfinite(corr({x}, {y})) THEN corr({x}, {y}) END END"
_IC = f"""{_PM}, {_RET}, {_FWD.format(hp=HP)}, ics AS (SELECT pm.date, {_CORR.format(x="pm.factor", y="fw.fwd")} AS ic FROM pm LEFT JOIN fw ON fw.date = pm.date AND fw.id = pm.id GROUP BY 1)"""


_STANDING_CRSP, _STANDING_CSTAT = [*CRSP_FIELDS, "vol"], [*CSTAT_FIELDS, *ISSUE_FIELDS]
_STC = standing_sql("crsp_sd", "permno, date", _STANDING_CRSP, "st")
_STK = standing_sql("cstat_sd", "gvkey, iid, date", _STANDING_CSTAT, "sk", ", gvkey || '_' || iid AS kid")
_NN = "CASE WHEN NOT isnan({0}) THEN {0} END"


# ---- scans, projections, filters ----------------------------------------------------------------------------------


@query("SELECT permno, shrcd, min(date) AS min_date, max(date) AS max_date FROM crsp_sd GROUP BY 1, 2")
def sc2_sc5_static_attributes(s, d):
    return q(s, d).query_static_table("crsp.raw", ["shrcd"], "*", "permno").df


_TOP = "(SELECT {}(date) FROM temp_rank_crsp_mc WHERE ttm_mc_rank <= 20)"


def _span(x: DataFrame) -> tuple[str, str]:
    """First and last date; any range will do where there is none."""
    lo, hi = x.agg(F.min("date"), F.max("date")).first()
    return str(lo or "1900-01-01"), str(hi or "1900-01-01")


@query(f"""WITH {_STC} SELECT date, permno, round(abs(prc / nullif(cfacpr, 0)), 6) AS prc, round(shrout * cfacshr, 6) AS shrout FROM st
 WHERE permno IN (SELECT permno FROM temp_rank_crsp_mc WHERE ttm_mc_rank <= 20 AND date BETWEEN (SELECT min(date) FROM crsp_sd) AND (SELECT max(date) FROM crsp_sd))
 AND date IS NOT NULL""")
def sc1_sc6_adjusted_scan_of_universe(s, d):
    """From the first to the last date of the daily file."""
    x = q(s, d).query_timeseries_table("crsp.sd", ["prc", "shrout"], "TOP_20", "permno", *_span(read(s, d, "crsp_sd")))
    return r6(x.df, "prc", "shrout")


@query(f"SELECT DISTINCT date, permno FROM temp_rank_crsp_mc WHERE ttm_mc_rank <= 20 AND date BETWEEN {_TOP.format('min')} AND {_TOP.format('max')}")
def sc3_universe_scan(s, d):
    """From the first to the last date of the universe, both included."""
    x = q(s, d)
    return x.query_universe_table("TOP_20", ["permno"], *_span(x.universes["TOP_20"])).distinct().df


@query("SELECT lpermno, gvkey, gsector FROM crsp_cstat_link")
def sc4_table_without_dates(s, d):
    return q(s, d).query_no_date_table("link.crsp_cstat_link", ["gvkey", "gsector"], "*", "lpermno").df


@query("SELECT date, permno, prc FROM crsp_sd WHERE permno IS NOT NULL")
def sc7_j1_asset_list(s, d):
    """The list is that of all ids of the table."""
    ids = [r[0] for r in read(s, d, "crsp_sd").select("permno").dropna().distinct().collect()]
    return q(s, d).query_timeseries_table("crsp.raw", ["prc"], ids, "permno", adjust=False).df


_PX = f"""{_STC}, dz AS (SELECT trading_days AS date FROM trading_cal WHERE trading_days BETWEEN '2024-01-01' AND '2024-12-31'),
 p0 AS (SELECT st.date, permno AS id, abs(prc / nullif(cfacpr, 0)) AS price FROM st JOIN dz ON dz.date = st.date),
 pm AS (SELECT date, id, CASE WHEN isfinite(price) THEN price END AS price FROM p0 WHERE price IS NOT NULL AND NOT isnan(price))"""


@query(f"WITH {_PX}, {_RET} SELECT date, id, round(ret, 6) AS ret FROM ret")
def sc16_a1_pricing_portal(s, d):
    p = PricingPortal(q(s, d), "*", "permno", "2024-01-01", "2024-12-31", calendar=calendar(s, d))
    return r6(p.returns.select("date", "id", "ret"), "ret")


@query("SELECT lpermno AS id, coalesce(min(gsector), -1) AS grp FROM crsp_cstat_link WHERE lpermno IS NOT NULL GROUP BY 1")
def sc17_group_portal(s, d):
    return SectorPortal(q(s, d), "*", "lpermno").groups


@query(f"""WITH {_STC} SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date, permno AS security, round(abs(prc) * shrout, 4) AS mc FROM st
 WHERE shrcd = 11 AND shrout IS NOT NULL AND NOT isnan(shrout) AND date >= '2024-01-01'""")
def pr3_to_pr11_builder_chain(s, d):
    x = q(s, d).query_timeseries_table("crsp.sd", ["prc", "shrout", "shrcd"], "*", "permno", "2024", adjust=False)
    x = x.add_to_select("round(abs(prc) * shrout, 4)", "mc").where("shrcd = 11").dropna("shrout").rename({"permno": "security"}).set_freq("M")
    return x._with(x.df.select("date", "security", "mc")).distinct().df


@query(f"WITH {_AL} SELECT date, series, round(ret, 6) AS ret FROM se WHERE series LIKE 'Ntile%'")
def pr14_bucket_series(s, d):
    x = backtest.series_returns(pm_aligned(s, d), HP, N, "M", show_uni=True)
    return r6(x.where(F.startswith("series", F.lit("Ntile"))), "ret")


@query(f"WITH {_NT} SELECT date, id, ntile FROM nt WHERE ntile IN (1, (SELECT max(ntile) FROM nt))")
def pr18_top_and_bottom(s, d):
    b = bucket_factor(pm_factor(s, d), N)
    last = b.agg(F.max("ntile")).scalar()
    return b.where((F.col("ntile") == 1) | (F.col("ntile") == last)).select("date", "id", "ntile")


@query("SELECT permno, date, prc, shrout FROM crsp_sd WHERE isfinite(prc) AND isfinite(shrout)")
def pr19_finite_filter(s, d):
    return finite_filter(read(s, d, "crsp_sd").select("permno", "date", "prc", "shrout"), 0.1)[0]


@query("SELECT permno, date, ttm_mc FROM (SELECT *, row_number() OVER (PARTITION BY permno, date ORDER BY ttm_mc NULLS FIRST) AS rn FROM temp_rank_crsp_mc) WHERE rn = 1 AND isfinite(ttm_mc)")
def a17_g14_clean_factor(s, d):
    x = read(s, d, "temp_rank_crsp_mc").select("permno", "date", "ttm_mc")
    return clean_factor(x, "ttm_mc", "permno").select("permno", "date", "ttm_mc")


# ---- joins ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_STC} SELECT st.date, st.permno, st.prc, t.ttm_mc_rank FROM st JOIN temp_rank_crsp_mc t ON t.date = st.date AND t.permno = st.permno""")
def j2_query_join(s, d):
    a = q(s, d).query_timeseries_table("crsp.sd", ["prc"], "*", "permno", adjust=False)
    return a.join(read(s, d, "temp_rank_crsp_mc").select("date", "permno", "ttm_mc_rank"), {"date": "date", "permno": "permno"}).df


@query(f"""WITH {_STK}, dz AS (SELECT trading_days AS date FROM trading_cal WHERE trading_days BETWEEN '2024-01-01' AND '2024-12-31')
 SELECT dz.date, i.kid AS id, {_NN.format('sk.prccd')} AS prccd FROM (SELECT DISTINCT kid FROM sk) i CROSS JOIN dz LEFT JOIN sk ON sk.kid = i.kid AND sk.date = dz.date""")
def j3_calendar_densify(s, d):
    return q(s, d).query_timeseries_table("cstat.sd", ["prccd"], "*", "id", "2024-01-01", "2024-12-31", adjust=False).set_calendar(calendar(s, d)).df


@query(f"""WITH {_STC} SELECT st.date, st.permno, l.gvkey FROM st LEFT JOIN crsp_cstat_link l ON l.lpermno = st.permno AND st.date > l.linkdt AND st.date < l.linkenddt
 AND l.linktype IN ('LU', 'LC')""")
def j4_linker_strict(s, d):
    a = q(s, d).query_timeseries_table("crsp.sd", [], "*", "permno")
    return a.add_linker_table(read(s, d, "crsp_cstat_link"), {"permno": "lpermno"}, ["gvkey"], "linkdt", "linkenddt", "linktype IN ('LU', 'LC')").df


@query(f"""WITH {_STC}, x AS (SELECT st.date, st.permno, l.gvkey FROM st JOIN crsp_cstat_link l ON l.lpermno = st.permno AND st.date > l.linkdt AND st.date < l.linkenddt)
 SELECT * FROM x WHERE gvkey IN (SELECT gvkey FROM cstat_sd)""")
def j5_reset_universe(s, d):
    a = q(s, d).query_timeseries_table("crsp.sd", [], "*", "permno")
    a = a.add_linker_table(read(s, d, "crsp_cstat_link"), {"permno": "lpermno"}, ["gvkey"], "linkdt", "linkenddt")
    return a.reset_universe(read(s, d, "cstat_sd").select("gvkey"), "gvkey").df


_FA = """fa AS (SELECT o_custkey, CAST(last_day(make_date(year(o_orderdate) + 1, 6, 1)) AS DATE) AS date, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS sales FROM orders GROUP BY 1, 2)"""


def _annual(s, d):
    x = read(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    yearly = x.groupBy("o_custkey", F.trunc("date", "year").alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("sales"))
    return Query(s)._with(yearly, id="o_custkey").add_date_to_fa_ff()


@query(f"WITH {_FA} SELECT o_custkey, date, CAST(sales AS DOUBLE) AS sales FROM fa")
def dt12_effective_dates(s, d):
    return _annual(s, d).df.select("o_custkey", "date", F.col("sales").cast("double").alias("sales"))


@query(f"""WITH {_FA}, dy AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders),
 m AS (SELECT dy.o_custkey, dy.date, fa.sales, row_number() OVER (PARTITION BY dy.o_custkey, dy.date ORDER BY fa.date DESC) AS rn
 FROM dy JOIN fa ON fa.o_custkey = dy.o_custkey AND fa.date <= dy.date AND fa.date >= dy.date - 390)
 SELECT o_custkey, date, CAST(sales AS DOUBLE) AS sales FROM m WHERE rn = 1""")
def j6_fundamentals_as_of(s, d):
    days = read(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date")).distinct()
    x = Query(s)._with(days, id="o_custkey").join_funda_to_table_ff(_annual(s, d), {"o_custkey": "o_custkey"})
    return x.df.select("o_custkey", "date", F.col("sales").cast("double").alias("sales"))


_RANK = f"""{_STC}, td AS (SELECT trading_days AS date FROM trading_cal),
 lg AS (SELECT st.date, permno, shrcd, lag({_NN.format('prc')}) OVER w AS p, lag({_NN.format('shrout')}) OVER w AS n FROM st JOIN td ON td.date = st.date WINDOW w AS (PARTITION BY permno ORDER BY st.date)),
 tm AS (SELECT date, permno, min(abs(p)) OVER w AS ttm_min_prc, avg(abs(p) * n) OVER w AS ttm_mc FROM lg WHERE shrcd = 11 WINDOW w AS (PARTITION BY permno ORDER BY date ROWS BETWEEN 252 PRECEDING AND CURRENT ROW)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ttm_mc DESC, permno) AS ttm_mc_rank FROM tm WHERE ttm_min_prc > 3 AND ttm_mc IS NOT NULL)"""


def _ranks(s, d):
    return market_cap_ranks(crsp(s, d, "prc", "shrout", "shrcd"), "permno", "prc", "shrout", calendar(s, d), "shrcd = 11")


@query(f"WITH {_RANK} SELECT date, permno, ttm_min_prc, ttm_mc, ttm_mc_rank FROM rk")
def w8_to_w11_market_cap_ranks(s, d):
    return _ranks(s, d)


#: Primary common issues of domestic companies: the issue number, where it is one, is that of the primary issue.
_PRIMARY = "fic = 'USA' AND tpci = '0' AND curcdd = 'USD' AND priusa = CASE WHEN {}(iid, '^[0-9]*$') THEN try_cast(iid AS INT) END"


@query(f"""WITH {_STK}, td AS (SELECT trading_days AS date FROM trading_cal),
 lg AS (SELECT sk.date, kid, iid, priusa, fic, tpci, curcdd, lag({_NN.format('prccd')}) OVER w AS p, lag({_NN.format('cshoc')}) OVER w AS n FROM sk JOIN td ON td.date = sk.date WINDOW w AS (PARTITION BY kid ORDER BY sk.date)),
 tm AS (SELECT date, kid, min(abs(p)) OVER w AS mp, avg(abs(p) * n) OVER w AS mc FROM lg WHERE {_PRIMARY.format('regexp_full_match')} WINDOW w AS (PARTITION BY kid ORDER BY date ROWS BETWEEN 252 PRECEDING AND CURRENT ROW)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mc DESC, kid) AS ttm_mc_rank FROM tm WHERE mp > 3 AND mc > 0)
 SELECT date, kid AS id, ttm_mc_rank FROM rk WHERE ttm_mc_rank BETWEEN 3 AND 20 AND date > '2024-02-01'""")
def sk9_issue_universe(s, d):
    """Ranks among the primary domestic issues, from ranks and values of the row before."""
    x = standing_rows(read(s, d, "cstat_sd"), ["gvkey", "iid", "date"], [*CSTAT_FIELDS, *ISSUE_FIELDS]).withColumn("id", F.concat("gvkey", F.lit("_"), "iid"))
    r = market_cap_ranks(x, "id", "prccd", "cshoc", calendar(s, d), _PRIMARY.format("regexp_like"), positive_only=True)
    return ranked_universe(r, 20, 3, "2024-02-01").select("date", "id", "ttm_mc_rank")


@query(f"""WITH {_RANK}, u AS (SELECT date, permno, ttm_mc_rank FROM rk WHERE ttm_mc_rank <= 30 AND date > '2024-01-15')
 SELECT u.date, u.permno, u.ttm_mc_rank, l.gvkey, l.liid AS iid, l.gvkey || '_' || coalesce(l.liid, '') AS id, b.ticker, b.cusip FROM u
 LEFT JOIN crsp_cstat_link l ON l.lpermno = u.permno AND l.linktype IN ('LU', 'LC') AND u.date >= l.linkdt AND (l.linkenddt IS NULL OR u.date <= l.linkenddt)
 LEFT JOIN crsp_ibes_link b ON b.permno = u.permno AND u.date >= b.sdate AND (b.edate IS NULL OR u.date <= b.edate)""")
def sk10_j7_linked_universe(s, d):
    u = ranked_universe(_ranks(s, d), 30, 1, "2024-01-15").select("date", "permno", "ttm_mc_rank")
    return link_permno(u, read(s, d, "crsp_cstat_link"), read(s, d, "crsp_ibes_link"))


def _days_of(s, d, x: DataFrame, date: str) -> DataFrame:
    """The calendar from the first to the last date of a table."""
    lo, hi = (x.agg(f(F.to_date(date))).scalar() for f in (F.min, F.max))
    return calendar(s, d).where(F.col("date").between(lo, hi))


_SHIPPED = "(SELECT CAST({}(l_shipdate) AS DATE) FROM lineitem)"


@query(f"""WITH dz AS (SELECT trading_days AS date FROM trading_cal WHERE trading_days BETWEEN {_SHIPPED.format("min")} AND {_SHIPPED.format("max")}),
 h AS (SELECT DISTINCT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS snap, l_returnflag AS fund, l_suppkey AS id FROM lineitem),
 sp AS (SELECT fund, snap, coalesce(lead(snap) OVER (PARTITION BY fund ORDER BY snap) - 1, {_SHIPPED.format("max")}) AS until FROM (SELECT DISTINCT fund, snap FROM h))
 SELECT dz.date, h.fund, h.id FROM sp JOIN dz ON dz.date BETWEEN sp.snap AND sp.until JOIN h ON h.fund = sp.fund AND h.snap = sp.snap""")
def j8_sk13_holdings_universe(s, d):
    """All holdings, on every trading day from the first to the last ship date."""
    x = read(s, d, "lineitem")
    h = x.select(to_period("l_shipdate", "Q").alias("date"), F.col("l_returnflag").alias("fund"), F.col("l_suppkey").alias("id"))
    return holdings_universe(h, _days_of(s, d, x, "l_shipdate"), "fund", "id")


def _intervals(s, d):
    x = read(s, d, "orders").withColumn("_d", F.to_date("o_orderdate"))
    return x.groupBy(F.col("o_custkey").alias("id")).agg(F.min("_d").alias("from"), F.max("_d").alias("thru"))


_ORDERED = "(SELECT CAST({}(o_orderdate) AS DATE) FROM orders)"
_MEMB_ALL = f"""dz AS (SELECT trading_days AS date FROM trading_cal WHERE trading_days BETWEEN {_ORDERED.format("min")} AND {_ORDERED.format("max")}),
 iv AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders GROUP BY 1),
 mm AS (SELECT dz.date, iv.id FROM iv JOIN dz ON dz.date BETWEEN iv.a AND iv.z)"""


@query(f"WITH {_MEMB_ALL} SELECT date, id FROM mm")
def j9_interval_members(s, d):
    """Memberships over the whole range of the orders."""
    return members_by_interval(_intervals(s, d), _days_of(s, d, read(s, d, "orders"), "o_orderdate"), "id")


@query(f"""WITH {_MEMB_ALL}, x AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2)
 SELECT mm.date, mm.id, x.total FROM mm LEFT JOIN x ON x.id = mm.id AND x.date = mm.date""")
def j10_adjust_for_membership(s, d):
    """Order totals of every member day over the whole range of the orders."""
    orders = read(s, d, "orders").withColumn("_d", F.to_date("o_orderdate"))
    lo, hi = orders.agg(F.min("_d"), F.max("_d")).first()
    a = MembershipAdjuster(s, "id")
    # without orders any range will do
    a.add_universe_info(_intervals(s, d), str(lo or "1900-01-01"), str(hi or "1900-01-01"), calendar(s, d))
    data = orders.groupBy(F.col("_d").alias("date"), F.col("o_custkey").alias("id"))
    return a.adjust_data_for_membership(data.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")))


@query(f"""WITH {_STC} SELECT u.date, u.permno, st.prc FROM (SELECT date, permno FROM temp_rank_crsp_mc WHERE ttm_mc_rank <= 20 AND date > {_TOP.format('min')} AND date < {_TOP.format('max')}) u
 LEFT JOIN st ON st.date = u.date AND st.permno = u.permno""")
def j11_j12_long_universe(s, d):
    """Between the first and the last date of the universe, both excluded, as always with this operator."""
    a, universes = MembershipAdjuster(s, "permno"), q(s, d).universes
    a.add_universe_info_from_db("TOP_20", universes, *_span(universes["TOP_20"]))
    return a.adjust_data_for_membership(crsp(s, d, "prc").select("date", "permno", "prc"))


@query(f"WITH {_AL} SELECT date, id, round(ret, 6) AS ret, ntile FROM al")
def j13_alignment(s, d):
    return r6(pm_aligned(s, d).select("date", "id", "ret", "ntile"), "ret")


@query(f"""WITH {_PM}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM pm)), p AS (SELECT pm.*, dd.pos FROM pm JOIN dd ON dd.date = pm.date)
 SELECT a.date, a.id, a.factor, b.factor AS previous FROM p a LEFT JOIN p b ON b.id = a.id AND b.pos = a.pos - {HP}""")
def j17_positional_lag(s, d):
    f = pm_factor(s, d)
    p = f.join(fetched(positions(f)), "date")
    return turnover.lagged(p, "factor", HP).select("date", "id", "factor", F.col("_prev").alias("previous"))


# ---- returns and portfolios -----------------------------------------------------------------------------------------


@query(f"WITH {_PM}, {_RET} SELECT date, id, round(ret, 6) AS ret FROM ret")
def a1_simple_returns(s, d):
    return r6(pm_returns(s, d).select("date", "id", "ret"), "ret")


@query(f"WITH {_PM}, {_RET}, {_FWD.format(hp=HP)} SELECT date, id, round(fwd, 6) AS fwd FROM fw")
def a2_forward_returns(s, d):
    return r6(forward_returns(pm_returns(s, d), HP), "fwd")


@query(f"WITH {_AL} SELECT pos, id, ntile, round(weight, 6) AS weight FROM wt")
def a3_w12_bucket_weights(s, d):
    return r6(backtest.bucket_weights(pm_aligned(s, d), HP), "weight")


@query(f"WITH {_AL} SELECT date, ntile, round(ret, 6) AS ret FROM br")
def a4_bucket_returns(s, d):
    return r6(backtest.bucket_returns(pm_aligned(s, d), HP, N, "M"), "ret")


@query(f"WITH {_AL} SELECT date, round(ret, 6) AS ret FROM un")
def a5_universe_returns(s, d):
    return r6(backtest.universe_returns(pm_aligned(s, d), HP, "M"), "ret")


@query(f"WITH {_AL} SELECT date, series, round(ret, 6) AS ret FROM se")
def a6_a7_a8_series_and_spreads(s, d):
    return r6(backtest.series_returns(pm_aligned(s, d), HP, N, "M", show_uni=True), "ret")


@query(f"WITH {_AL} SELECT date, ntile, round(1.0 / CAST(count(*) * {HP} AS DOUBLE), 6) AS weight FROM al WHERE ntile IS NOT NULL GROUP BY 1, 2 HAVING 1.0 / CAST(count(*) * {HP} AS DOUBLE) > 0.01")
def a9_g18_concentration(s, d):
    return r6(backtest.concentration(pm_aligned(s, d), HP, 0.01), "weight")


@query(f"WITH {_AL} SELECT wt.pos, wt.id, wt.ntile, round(wt.weight * al.ret, 6) AS weighted FROM wt JOIN al ON al.pos = wt.pos AND al.id = wt.id")
def a10_components(s, d):
    a = pm_aligned(s, d)
    w = backtest.bucket_weights(a, HP).join(a.select("pos", "id", "ret"), ["pos", "id"])
    return w.select("pos", "id", "ntile", F.round(F.col("weight") * F.col("ret"), 6).alias("weighted"))


def _tilts(s, d):
    a, g = pm_aligned(s, d), groups(s, d)
    return backtest.group_tilts(backtest.member_weights(a, HP), positions(a), g, backtest.group_shares(g, a))


@query(f"WITH {_AL}, {_GRP} SELECT date, ntile, grp, round(tilt, 6) AS tilt FROM ti")
def a11_j15_group_tilts(s, d):
    return r6(_tilts(s, d), "tilt")


@query(f"WITH {_AL}, {_GRP} SELECT ntile, grp, round(avg(tilt), 6) AS tilt FROM ti GROUP BY 1, 2")
def a12_average_tilts(s, d):
    return r6(backtest.average_tilts(_tilts(s, d)), "tilt")


@query(f"WITH {_AL}, {_GRP} SELECT date, grp, round(sum(CASE WHEN ntile = 1 THEN tilt ELSE -tilt END), 6) AS tilt FROM ti WHERE ntile IN (1, {N}) GROUP BY 1, 2")
def a13_long_short_tilts(s, d):
    return r6(backtest.long_short_tilts(_tilts(s, d), N), "tilt")


@query(f"""WITH {_AL}, {_GRP} SELECT grp, round(CAST(share AS DOUBLE), 6) AS share FROM sh""")
def g12_group_shares(s, d):
    return r6(backtest.group_shares(groups(s, d), pm_aligned(s, d)), "share")


@query(f"""WITH {_PX}, {_RET}, f AS (SELECT date, permno AS id, ttm_mc AS factor FROM temp_rank_crsp_mc), j AS (SELECT f.*, r.ret, r.id IS NOT NULL AS there FROM f LEFT JOIN ret r ON r.date = f.date AND r.id = f.id),
 a AS (SELECT count(*) FILTER (factor IS NULL OR NOT isfinite(factor)) * 100.0 / count(*) AS missing, count(*) FILTER (isfinite(factor) AND NOT there) * 100.0 / count(*) AS lost_in_alignment,
 count(*) FILTER (isfinite(factor) AND ret IS NULL) * 100.0 / count(*) AS lost_for_returns FROM j)
 SELECT round(CAST(missing AS DOUBLE), 6) AS missing, round(CAST(lost_in_alignment AS DOUBLE), 6) AS lost_in_alignment, round(CAST(lost_for_returns AS DOUBLE), 6) AS lost_for_returns,
 round(CAST(missing + lost_in_alignment + lost_for_returns AS DOUBLE), 6) AS unusable FROM a""")
def a14_coverage(s, d):
    p = PricingPortal(q(s, d), "*", "permno", "2024-01-01", "2024-12-31", calendar=calendar(s, d))
    f = read(s, d, "temp_rank_crsp_mc").select("date", F.col("permno").alias("id"), F.col("ttm_mc").alias("factor"))
    return r6(backtest.coverage(f, p.returns), "missing", "lost_in_alignment", "lost_for_returns", "unusable")


@query(f"WITH {_AL} SELECT date, round(ret, 6) AS ret FROM un UNION ALL SELECT CAST(min(date) - INTERVAL 1 MONTH AS DATE), 0 FROM un")
def a15_padding(s, d):
    return r6(pad_extra_day(backtest.universe_returns(pm_aligned(s, d), HP, "M"), "M", 0.0, "ret"), "ret")


@query(f"""WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_returnflag AS f, l_quantity AS v FROM lineitem)
 SELECT date, round(avg(v) FILTER (f = 'A'), 6) AS "A", round(avg(v) FILTER (f = 'N'), 6) AS "N", round(avg(v) FILTER (f = 'R'), 6) AS "R" FROM p GROUP BY 1""")
def a16_price_pivot(s, d):
    x = read(s, d, "lineitem").select(to_period("l_shipdate", "M").alias("date"), "l_returnflag", "l_quantity")
    return r6(price_pivot(x, "l_quantity", ["A", "N", "R"], "l_returnflag"), "A", "N", "R")


# ---- cross-section, summaries -----------------------------------------------------------------------------------------


@query(f"WITH {_NT} SELECT date, id, factor, ntile FROM nt")
def w1_w2_ntile(s, d):
    return bucket_factor(pm_factor(s, d), N)


@query(f"WITH {_PM} SELECT date, id, ntile({N}) OVER (PARTITION BY date ORDER BY factor DESC NULLS LAST, id) AS factor, ntile({N}) OVER (PARTITION BY date ORDER BY price DESC NULLS LAST, id) AS price FROM pm")
def w4_ntile_columns(s, d):
    return ntile_columns(pm(s, d).select("date", "id", "factor", "price"), N, ["date"], ["id"])


def _rank_sql(fn: str, tie: str = "") -> str:
    col = lambda c: f"CASE WHEN {_NN.format(c)} IS NOT NULL THEN {fn}() OVER (PARTITION BY date ORDER BY {_NN.format(c)} ASC NULLS LAST{tie}) END"
    st = standing_sql("crsp_sd", "permno, date", ["prc", "vol"], "st")
    return f"WITH {st} SELECT date, permno, {col('prc')} AS prc, {col('vol')} AS vol FROM st"


def _rank(kind: str):
    return lambda s, d: rank_columns(crsp(s, d, "prc", "vol").select("date", "permno", "prc", "vol"), ["date"], ["permno"], kind)


for _kind in ("percent_rank", "rank", "dense_rank", "cume_dist", "row_number"):
    _f = _rank(_kind)
    _f.__name__ = f"w5_{_kind}"
    query(_rank_sql(_kind, ", permno" if _kind == "row_number" else ""))(_f)


@query(f"""WITH {_PM} SELECT date, id, round((factor - median(factor) OVER (PARTITION BY date)) / nullif(stddev_samp(factor) OVER (PARTITION BY date), 0), 6) AS factor,
 round((price - median(price) OVER (PARTITION BY date)) / nullif(stddev_samp(price) OVER (PARTITION BY date), 0), 6) AS price FROM pm""")
def w5b_robust_scores(s, d):
    return r6(robust_scores(pm(s, d).select("date", "id", "factor", "price"), ["date"], ["id"]), "factor", "price")


@query(f"WITH {_NT} SELECT ntile, round_even(median(factor), 2) AS median, round_even(stddev_samp(factor), 2) AS std, round_even(min(factor), 2) AS min, round_even(max(factor), 2) AS max, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS count_pct FROM nt GROUP BY 1")
def g2_inspection(s, d):
    return stats.inspection(bucket_factor(pm_factor(s, d), N))


@query(f"WITH {_NT} SELECT date, count(*) AS count FROM nt GROUP BY 1")
def g3_count_per_date(s, d):
    return stats.counts_per_date(bucket_factor(pm_factor(s, d), N))


@query(f"WITH {_NT} SELECT date, " + ", ".join(f'count(*) FILTER (ntile = {k}) AS "{k}"' for k in range(1, N + 1)) + " FROM nt GROUP BY 1")
def g4_count_per_bucket(s, d):
    return stats.per_date_and_bucket(bucket_factor(pm_factor(s, d), N), N)[0].fillna(0)


@query(f"WITH {_NT} SELECT date, " + ", ".join(f'median(factor) FILTER (ntile = {k}) AS "{k}"' for k in range(1, N + 1)) + " FROM nt GROUP BY 1")
def g5_median_per_bucket(s, d):
    return stats.per_date_and_bucket(bucket_factor(pm_factor(s, d), N), N)[1]


@query(f"WITH {_IC} SELECT date, round(ic, 6) AS ic FROM ics")
def g6_j14_daily_ic(s, d):
    return r6(ic.daily_ic(*pm_both(s, d), HP), "ic")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS ic FROM lineitem GROUP BY 1")
def g7_pair_correlation(s, d):
    return r6(read(s, d, "lineitem").groupBy("l_returnflag").agg(corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("ic")), "ic")


_SUM = "round_even(avg(ic), 3) AS mean, round_even(median(ic), 3) AS median, round_even(stddev_samp(ic), 3) AS std, round_even(avg(ic) / stddev_samp(ic), 3) AS mean_std, round_even(skewness(ic), 3) AS skew"


@query(f"WITH {_IC} SELECT '{HP}D' AS horizon, {_SUM} FROM ics")
def g8_ic_summary(s, d):
    return ic.ic_summary(ic.daily_ic(*pm_both(s, d), HP), HP)


@query(
    f"WITH {_PM}, {_RET}, "
    + ", ".join(_FWD.format(hp=h).replace("fw AS", f"fw{h} AS", 1) + f", ic{h} AS (SELECT {_CORR.format(x='pm.factor', y='f.fwd')} AS ic FROM pm LEFT JOIN fw{h} f ON f.date = pm.date AND f.id = pm.id GROUP BY pm.date)" for h in (1, 3, 6))
    + " " + " UNION ALL ".join(f"SELECT '{h}D' AS horizon, {_SUM} FROM ic{h}" for h in (1, 3, 6))
)
def g9_o6_ic_horizon(s, d):
    return ic.ic_horizon(*pm_both(s, d), [6, 1, 3])


_TURN = f"""{_NT}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM nt)),
 e AS (SELECT nt.date, dd.pos, nt.id, nt.ntile FROM nt JOIN dd ON dd.date = nt.date WHERE ntile IN (1, {N})),
 tv AS (SELECT a.date, a.ntile, avg(CASE WHEN b.ntile IS NULL OR b.ntile <> a.ntile THEN 1.0 ELSE 0.0 END) AS turnover FROM e a LEFT JOIN e b ON b.id = a.id AND b.pos = a.pos - {HP} GROUP BY 1, 2)"""


@query(f"WITH {_TURN} SELECT date, ntile, round(CAST(turnover AS DOUBLE), 6) AS turnover FROM tv")
def g10_turnover(s, d):
    return r6(turnover.bucket_turnover(bucket_factor(pm_factor(s, d), N), HP), "turnover")


@query(f"WITH {_TURN} SELECT ntile, round_even(avg(turnover), 3) AS mean, round_even(median(turnover), 3) AS median, round_even(stddev_samp(turnover), 3) AS std FROM tv GROUP BY 1")
def g11_turnover_summary(s, d):
    return turnover.summarise(turnover.bucket_turnover(bucket_factor(pm_factor(s, d), N), HP), "turnover", ["ntile"])


_AUTO = f"""{_PM}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM pm)), p AS (SELECT pm.*, dd.pos FROM pm JOIN dd ON dd.date = pm.date),
 ac AS (SELECT a.date, {_CORR.format(x="a.factor", y="b.factor")} AS c FROM p a LEFT JOIN p b ON b.id = a.id AND b.pos = a.pos - {HP} GROUP BY 1)"""


@query(f"WITH {_AUTO} SELECT date, round(c, 6) AS autocorrelation FROM ac")
def w17_autocorrelation(s, d):
    return r6(turnover.autocorrelation(pm_factor(s, d), HP), "autocorrelation")


@query(f"""WITH {_STK}, y AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS m FROM sk)
 SELECT gvkey, iid, m AS date, max_by(prccd, date) FILTER (prccd IS NOT NULL AND NOT isnan(prccd)) AS prccd, max_by(cshoc, date) FILTER (cshoc IS NOT NULL AND NOT isnan(cshoc)) AS cshoc
 FROM y GROUP BY 1, 2, 3""")
def g13_dt6_last_of_period(s, d):
    x = standing_rows(read(s, d, "cstat_sd"), ["gvkey", "iid", "date"], ["prccd", "cshoc"])
    return DateConfig("M", resample=True, grouper_keys=["gvkey", "iid"]).configure_dates(x, "date").select("gvkey", "iid", "date", "prccd", "cshoc")


# ---- windows ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_STK} SELECT date, kid AS id, last_value({_NN.format('prccd')} IGNORE NULLS) OVER w AS prccd, last_value({_NN.format('cshoc')} IGNORE NULLS) OVER w AS cshoc FROM sk
 WINDOW w AS (PARTITION BY kid ORDER BY date RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 0 DAYS FOLLOWING)""")
def w6_bounded_fill(s, d):
    return forward_fill(q(s, d).tables["cstat.sd"].select("date", "id", "prccd", "cshoc"), "id", ["prccd", "cshoc"], 5)


@query(f"WITH {_STC} SELECT date, permno, prc, lag(prc, 2) OVER (PARTITION BY permno ORDER BY date) AS prc_lag_2 FROM st")
def w7_shift(s, d):
    return q(s, d).query_timeseries_table("crsp.sd", ["prc"], "*", "permno", adjust=False).shift("prc", 2).df


@query(f"WITH {_PM} SELECT date, id, CASE WHEN count(*) OVER w = 4 THEN sum(factor) OVER w END AS total FROM pm WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def w12_rolling_sum(s, d):
    return pm_factor(s, d).select("date", "id", rolling_sum("factor", 4, ["id"]).alias("total"))


@query(f"WITH {_IC} SELECT date, round(ic, 6) AS ic, round(CASE WHEN count(ic) OVER w = 12 THEN avg(ic) OVER w END, 6) AS ic_mean FROM ics WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def w13_rolling_ic(s, d):
    return r6(ic.rolling_ic(ic.daily_ic(*pm_both(s, d), HP), False), "ic", "ic_mean")


_CUM = f"{_AL}, cu AS (SELECT date, series, ret, product(1 + ret) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM se)"


def _series(s, d):
    return backtest.series_returns(pm_aligned(s, d), HP, N, "M", show_uni=True)


@query(f"WITH {_CUM} SELECT date, series, round(cum, 6) AS cum FROM cu")
def w14_cumulative(s, d):
    return r6(stats.cumulative_returns(_series(s, d)), "cum")


_DD = f"{_CUM}, dw AS (SELECT date, series, cum / greatest(1.0, max(cum) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM cu)"


@query(f"WITH {_DD} SELECT date, series, round(dd, 6) AS dd FROM dw")
def w15_drawdowns(s, d):
    return r6(stats.drawdowns(_series(s, d)).select("date", "series", "dd"), "dd")


@query(f"WITH {_PM} SELECT date, id, round(price / nullif(lag(price, 2) OVER (PARTITION BY id ORDER BY date), 0) - 1, 6) AS change FROM pm")
def w16_percent_change(s, d):
    return r6(pm(s, d).select("date", "id", pct_change("price", 2, ["id"]).alias("change")), "change")


# ---- dates ----------------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
 CAST(date_trunc('year', o_orderdate) AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS b FROM orders""")
def dt3_dt10_periods(s, d):
    c = F.col("o_orderdate")
    return read(s, d, "orders").select(*[to_period(c, f).alias(f.lower()) for f in "DWMQAB"]).distinct()


@query("""SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(last_day(o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q,
 CAST(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS a, CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS w FROM orders""")
def dt4_period_ends(s, d):
    c = F.col("o_orderdate")
    return read(s, d, "orders").select(to_period(c, "D").alias("d"), *[period_end(c, f).alias(f.lower()) for f in "MQAW"]).distinct()


@query(f"""WITH {_STK}, dz AS (SELECT trading_days AS date FROM trading_cal WHERE trading_days BETWEEN '2024-01-01' AND '2024-12-31'), i AS (SELECT DISTINCT kid FROM sk),
 al AS (SELECT i.kid, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS date FROM i),
 f AS (SELECT al.kid, al.date, last_value({_NN.format('prccd')} IGNORE NULLS) OVER (PARTITION BY al.kid ORDER BY al.date RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW) AS prccd FROM al LEFT JOIN sk ON sk.kid = al.kid AND sk.date = al.date)
 SELECT f.date, f.kid AS id, f.prccd FROM f JOIN dz ON dz.date = f.date""")
def dt11_resample(s, d):
    return q(s, d).query_timeseries_table("cstat.sd", ["prccd"], "*", "id", "2024-01-01", "2024-12-31", adjust=False).resample(calendar(s, d), 4).df


# ---- statistics, reports, models --------------------------------------------------------------------------------------------


_STATS = f"""{_DD}, bs AS (SELECT series, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12.0) AS sharpe, (pow(product(1 + ret), 12.0 / count(*)) - 1) * 100 AS cagr, stddev_samp(ret) * sqrt(12.0) * 100 AS annual_vol,
 avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS periods_up FROM se GROUP BY 1), md AS (SELECT series, min(dd) * 100 AS max_drawdown FROM dw GROUP BY 1)"""
_STATS_OUT = "round(sharpe, 6) AS sharpe, round(cagr, 6) AS cagr, round(annual_vol, 6) AS annual_vol, round(max_drawdown, 6) AS max_drawdown, round(CAST(periods_up AS DOUBLE), 6) AS periods_up"
_STAT_COLS = ("sharpe", "cagr", "annual_vol", "max_drawdown", "periods_up")


@query(f"WITH {_STATS} SELECT bs.series, {_STATS_OUT} FROM bs JOIN md ON md.series = bs.series")
def st1_to_st6_statistics(s, d):
    return r6(stats.statistics(_series(s, d), 12), *_STAT_COLS)


_HALF = -(-N // 2)


@query(f"""WITH {_AL}, fl2 AS (SELECT date, series, CASE WHEN k = {_HALF} THEN NULL WHEN k > {_HALF} THEN -ret ELSE ret END AS ret FROM (SELECT *, CAST(series[8:] AS INT) AS k FROM se WHERE series LIKE 'Ntile%')),
 cu AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM fl2),
 dw AS (SELECT series, cum / greatest(1.0, max(cum) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM cu)
 SELECT series, round(min(dd) * 100, 6) AS max_drawdown FROM dw GROUP BY 1""")
def st4_flipped_drawdown(s, d):
    x = _series(s, d).where(F.startswith("series", F.lit("Ntile")))
    return r6(stats.max_drawdown(stats.flip_lower_half(x, F.expr("try_cast(substring(series, 8) AS INT)"), N)), "max_drawdown")


@query(f"WITH {_AL} SELECT series, round(max(ret), 6) AS best FROM se GROUP BY 1")
def g17_u4_own_statistic(s, d):
    return r6(stats.per_series(_series(s, d), "best", F.max), "best")


class _Portal:
    freq = "M"

    def __init__(self, returns):
        self.returns = returns


def _report(s, d) -> tuple[Ntile, DataFrame]:
    f, r = pm_both(s, d)
    return Ntile(_Portal(r), SectorPortal.from_groups(groups(s, d))), f


@query(f"WITH {_AL} SELECT date, series, round(ret, 6) AS ret FROM se WHERE series <> 'universe'")
def t2_t3_full_report(s, d):
    n, f = _report(s, d)
    return r6(n.full_tear(f, N, HP)["backtest"]["returns"], "ret")


@query(f"WITH {_NT} SELECT date, count(*) AS count FROM nt GROUP BY 1")
def t4_inspection_report(s, d):
    n, f = _report(s, d)
    return n.ntile_inspection_tear(f, N)["inspection"]["count"]


@query(f"WITH {_IC} SELECT '{HP}D' AS horizon, {_SUM} FROM ics")
def t5_ic_report(s, d):
    n, f = _report(s, d)
    return n.ntile_ic_tear(f, HP)["ic"]["summary"]


@query(f"WITH {_TURN} SELECT date, ntile, round(CAST(turnover AS DOUBLE), 6) AS turnover FROM tv")
def t6_turnover_report(s, d):
    n, f = _report(s, d)
    return r6(n.ntile_turnover_tear(f, N, HP)["turnover"]["turnover"], "turnover")


@query(_SQL["g9_o6_ic_horizon"])
def t7_ic_horizon_report(s, d):
    n, f = _report(s, d)
    return n.ntile_ic_horizon(f, [1, 3, 6])["horizon"]["summary"]


def _long(report: dict) -> DataFrame:
    """All outputs of a report as (report, output, date, series, value): a row per number; keys other than the date are in series, before the number's column."""
    out = None
    for name, outputs in report.items():
        for output, x in outputs.items():
            kinds = dict(x.dtypes)
            keys = [c for c in x.columns if c != "date" and (c in ("pos", "id", "ntile", "grp", "series", "horizon") or kinds[c] == "string")]
            values = [c for c in x.columns if c != "date" and c not in keys]
            label = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in keys]
            each = F.explode(F.array(*[F.struct(F.concat_ws(", ", *label, F.lit(c)).alias("series"), F.col(c).cast("double").alias("value")) for c in values]))
            date = (F.col("date") if "date" in kinds else F.lit(None)).cast("date").alias("date")
            x = x.select(F.lit(name).alias("report"), F.lit(output).alias("output"), date, each.alias("_x"))
            x = x.select("report", "output", "date", "_x.series", "_x.value")
            out = x if out is None else out.unionByName(x)
    return r6(out, "value")


@query()
def t2_t3_full_report_whole(s, d):
    n, f = _report(s, d)
    return _long(n.full_tear(f, N, HP, show_uni=True, show_ntile_tilts=True))


@query()
def t4_inspection_report_whole(s, d):
    n, f = _report(s, d)
    return _long(n.ntile_inspection_tear(f, N))


@query()
def t5_ic_report_whole(s, d):
    n, f = _report(s, d)
    return _long(n.ntile_ic_tear(f, HP))


@query()
def t6_turnover_report_whole(s, d):
    n, f = _report(s, d)
    return _long(n.ntile_turnover_tear(f, N, HP))


_FOLDS = f"""{_PM}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM pm)), n AS (SELECT count(*) AS n FROM dd),
 fo AS (SELECT i AS fold, i * 4 + 23 AS te, i * 4 + 23 - 24 + 1 AS ts, i * 4 + 23 + 3 AS ps, least(i * 4 + 23 + 3 + 3, n - 1) AS pe FROM n, (SELECT unnest(range(0, 1000)) AS i) WHERE i < (n - 24 - 2) / CAST(4 AS DOUBLE))"""


@query(f"""WITH {_FOLDS} SELECT fold, a.date AS train_start, b.date AS train_end, c.date AS pred_start, e.date AS pred_end
 FROM fo JOIN dd a ON a.pos = ts JOIN dd b ON b.pos = te JOIN dd c ON c.pos = ps JOIN dd e ON e.pos = pe""")
def u3_folds(s, d):
    return fold_table(pm(s, d), 2, 4, rolling=24)


@query(f"""WITH {_FOLDS}, x AS (SELECT pm.*, dd.pos FROM pm JOIN dd ON dd.date = pm.date),
 fit AS (SELECT fold, regr_slope(price, factor) AS b, regr_intercept(price, factor) AS a FROM fo JOIN x ON x.pos BETWEEN ts AND te GROUP BY 1)
 SELECT x.date, x.id, fo.fold, round(fit.a + fit.b * x.factor, 4) AS prediction FROM fo JOIN fit ON fit.fold = fo.fold JOIN x ON x.pos BETWEEN fo.ps AND fo.pe""")
def u1_u2_walk_forward(s, d):
    out = walk_forward(LeastSquares(), pm(s, d), ["factor"], "price", 2, 4, rolling=24)
    return out.withColumn("prediction", F.round("prediction", 4))


# ---- the rest of the survey's ids -------------------------------------------------------------------------------------------


@query(f"WITH {_AL} SELECT date, series, round(ret, 6) AS ret FROM se")
def t3_backtest_report(s, d):
    n, f = _report(s, d)
    return r6(n.ntile_backtest_tear(f, N, HP, show_uni=True)["backtest"]["returns"], "ret")


@query(f"""WITH {_AL}, {_GRP} SELECT 'average' AS kind, CAST(ntile AS BIGINT) AS ntile, grp, round(avg(tilt), 6) AS tilt FROM ti GROUP BY 2, 3
 UNION ALL SELECT 'long short', NULL, grp, round(avg(tilt), 6) FROM (SELECT date, grp, sum(CASE WHEN ntile = 1 THEN tilt ELSE -tilt END) AS tilt FROM ti WHERE ntile IN (1, {N}) GROUP BY 1, 2) GROUP BY 3""")
def t2_t9_report_tilts(s, d):
    n, f = _report(s, d)
    out = n.full_tear(f, N, HP, show_ntile_tilts=True)["backtest"]
    a = out["average_tilts"].select(F.lit("average").alias("kind"), F.col("ntile").cast("long").alias("ntile"), "grp", "tilt")
    b = out["average_long_short_tilts"].select(F.lit("long short").alias("kind"), F.lit(None).cast("long").alias("ntile"), "grp", "tilt")
    return r6(a.unionByName(b), "tilt")


@query(f"""WITH {_STATS} SELECT bs.series, {_STATS_OUT} FROM bs JOIN md ON md.series = bs.series WHERE bs.series LIKE '% vs %'""")
def t2_report_statistics(s, d):
    n, f = _report(s, d)
    return r6(n.full_tear(f, N, HP)["backtest"]["spread_stats"], *_STAT_COLS)


@query(_SQL["g17_u4_own_statistic"])
def u4_own_python_function(s, d):
    """The caller's function over a pandas series, as a grouped aggregate."""
    return r6(stats.per_series(_series(s, d), "best", lambda x: x.to_numpy().max()), "best")


@query(f"""WITH {_PM}, {_RET}, k AS (SELECT date, id, count(*) AS n FROM pm GROUP BY 1, 2), dt AS (SELECT DISTINCT date FROM pm) SELECT (SELECT sum(n) FROM k)::BIGINT AS rows, (SELECT max(n) FROM k) AS most_rows_of_a_key,
 (SELECT count(*) FROM dt) AS periods, (SELECT count(*) FROM dt WHERE isodow(date) = 1) AS starts_w, (SELECT count(*) FROM dt WHERE day(date) = 1) AS starts_m,
 (SELECT count(*) FROM dt WHERE day(date) = 1 AND month(date) IN (1, 4, 7, 10)) AS starts_q, (SELECT count(*) FROM dt WHERE dayofyear(date) = 1) AS starts_a,
 (SELECT count(DISTINCT id) FROM pm WHERE id NOT IN (SELECT id FROM ret)) AS ids_without_returns, (SELECT count(*) FROM dt WHERE date IN (SELECT date FROM ret)) AS periods_with_returns""")
def pr20_o7_factor_facts(s, d):
    f, r = pm_both(s, d)
    x = factor_facts(f, r)
    return s.createDataFrame([tuple(x.values())], ", ".join(f"{k.lower()} long" for k in x))


@query("SELECT date, permno, ttm_mc FROM temp_rank_crsp_mc")
def pr15_pr16_checked_columns(s, d):
    return check_columns(["date", "permno", "ttm_mc"], read(s, d, "temp_rank_crsp_mc"))


@query(f"WITH {_STC} SELECT date, permno, lag(prc, 1) OVER w AS prc, lag(shrout, 1) OVER w AS shrout FROM st WINDOW w AS (PARTITION BY permno ORDER BY date)")
def w18_shift_all(s, d):
    return q(s, d).query_timeseries_table("crsp.sd", ["prc", "shrout"], "*", "permno", adjust=False).shift_all(1).df


@query(f"WITH {_STC} SELECT permno, date, prc FROM st WHERE NOT isnan(prc)")
def o1_sk17_ordered_temp_view(s, d):
    x = q(s, d).query_timeseries_table("crsp.sd", ["prc"], "*", "permno", adjust=False).dropna("prc").order_by("prc", "DESC").to_temp("mill_prices")
    return x.spark.sql("SELECT permno, date, prc FROM mill_prices")


@query("""WITH e AS (SELECT gvkey, max(date) AS og_cstat_date, max(cshoc) FILTER (NOT isnan(cshoc)) AS shares FROM cstat_sd WHERE gvkey IS NOT NULL AND date IS NOT NULL GROUP BY gvkey, year(date)),
 x AS (SELECT *, CAST(last_day(make_date(year(og_cstat_date) + 1, 6, 1)) AS DATE) AS date FROM e)
 SELECT x.date, x.og_cstat_date, x.gvkey, x.shares, l.lpermno AS permno FROM x LEFT JOIN crsp_cstat_link l ON l.gvkey = x.gvkey AND x.date > l.linkdt AND x.date < l.linkenddt
 AND l.linktype IN ('LU', 'LC') AND l.linkprim IN ('P', 'C')""")
def dt12_effective_dates_with_link(s, d):
    """Yearly figures per company, in effect from June of the next year, with the permno linked on that date."""
    x = read(s, d, "cstat_sd").where("gvkey IS NOT NULL AND date IS NOT NULL")
    yearly = x.groupBy("gvkey", F.year("date").alias("y")).agg(F.max("date").alias("date"), F.max(F.nanvl("cshoc", F.lit(None))).alias("shares")).select("date", "gvkey", "shares")
    return Query(s)._with(yearly, id="gvkey").add_date_to_fa_ff(read(s, d, "crsp_cstat_link")).df


_CLOSED = ", ".join(f"'{x}'" for x in SPECIAL_CLOSINGS)


@query(f"""WITH y AS (SELECT unnest(range(1975, 2025)) AS y), a AS (SELECT y, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM y),
 b AS (SELECT y, h, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS l FROM a), c AS (SELECT y, h + l - 7 * ((y % 19 + 11 * h + 22 * l) // 451) + 114 AS k FROM b),
 gf AS (SELECT CAST(make_date(y, k // 31, k % 31 + 1) - INTERVAL 2 DAY AS DATE) AS d FROM c),
 el AS (SELECT CAST(make_date(y, 11, 1) + INTERVAL 1 DAY * ((8 - isodow(make_date(y, 11, 1))) % 7 + 1) AS DATE) AS d FROM y WHERE y IN (1976, 1980))
 SELECT trading_days AS date FROM trading_cal WHERE trading_days BETWEEN '1975-01-01' AND '2024-12-31' AND trading_days NOT IN (SELECT d FROM gf) AND trading_days NOT IN (SELECT d FROM el)
 AND trading_days NOT IN (SELECT make_date(y, 1, 1) + (8 - CAST(isodow(make_date(y, 1, 1)) AS INT)) % 7 + 14 FROM y WHERE y >= 1998)
 AND trading_days NOT IN (SELECT make_date(y, 6, 19) + CASE isodow(make_date(y, 6, 19)) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END FROM y WHERE y >= 2022)
 AND strftime(trading_days, '%Y-%m-%d') NOT IN ({_CLOSED})""")
def dt13_exchange_days(s, d):
    """Exchange days by rule; the delivered calendar holds Good Fridays, third Mondays of January, 19 June, election days and unscheduled closings as well."""
    return trading_days(s, "1975-01-01", "2024-12-31")


@query("""SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS quarter, CAST(o_orderdate AS TIMESTAMP) AS stamp FROM orders""")
def dt1_dt5_dt8_dt14_text_dates(s, d):
    """Dates given as text with a format: to periods by a configuration and its copy, and to timestamps."""
    x = read(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("quarter"), F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"))
    c = DateConfig("M", target_data_type="timestamp", date_format="%d/%m/%Y")
    x = c.copy(freq="Q").configure_dates(x, "quarter")
    return c.copy(freq="D", date_format="%Y%m%d").configure_dates(x, "stamp")


@query("""SELECT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS ordered, CAST(max_by(date_trunc('year', o_orderdate + INTERVAL 60 DAY), o_orderkey) AS DATE) AS due, max_by(o_totalprice, o_orderkey) AS price
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 GROUP BY 1, 2""")
def dt7_last_of_year_by_one_of_two_dates(s, d):
    o = read(s, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("ordered")).agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
    x = o.withColumn("due", F.date_add("ordered", 60)).select("o_custkey", "ordered", "due", "price")
    return DateConfig("A", resample=True, resample_key="ordered", grouper_keys=["o_custkey"]).configure_dates(x, ["ordered", "due"])


@query("SELECT unnest(['D', 'W', 'M', 'Q', 'Y', 'A']) AS freq, unnest(['Daily', 'Weekly', 'Monthly', 'Quarterly', 'Yearly', 'Yearly']) AS name, unnest([252, 52, 12, 4, 1, 1]) AS periods")
def dt9_st7_frequencies(s, d):
    return s.createDataFrame([(f, period_name(f), annualization(f)) for f in "DWMQYA"], "freq string, name string, periods int")


@query(f"WITH {_STC} SELECT permno AS id, count(DISTINCT date) AS days FROM st WHERE NOT isnan(prc) AND NOT isnan(cfacpr) AND cfacpr <> 0 AND date IN (SELECT trading_days FROM trading_cal WHERE year(trading_days) = 2024) GROUP BY 1")
def sc18_portal_assets(s, d):
    """Assets of a pricing portal with the days it has prices for."""
    p = PricingPortal(q(s, d), "*", "permno", "2024-01-01", "2024-12-31", calendar=calendar(s, d))
    return p.assets.join(p.prices, "id").groupBy("id").agg(F.count_distinct("date").alias("days"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
