"""Queries over the whole of their tables: rows that a cut would leave out come out."""

import datetime as dt
import os

import pytest

import __spark_entry__ as entry
from panelmill.operators.membership import fund_id
from panelmill.sources.ingest import read_csv, shape

SF = "/root/testdata/sf0.001"
T = lambda y, m, d: dt.datetime(y, m, d)


def tables(spark, tmp_path, **frames):
    for name, (data, schema) in frames.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def every_day(a, z):
    return [a + dt.timedelta(k) for k in range((z - a).days + 1)]


def test_holdings_of_any_quantity_and_year(spark, tmp_path):
    items = [(T(1995, 2, 3), 50.0, "A", 1), (T(1995, 3, 1), 2.0, "A", 2), (T(1999, 5, 1), 1.0, "A", 3), (T(1999, 5, 1), 50.0, "N", 4), (T(1999, 7, 9), 7.0, "A", 2)]
    days = every_day(dt.date(1995, 1, 1), dt.date(2000, 1, 31))
    d = tables(spark, tmp_path, lineitem=(items, "l_shipdate timestamp, l_quantity double, l_returnflag string, l_suppkey long"), trading_cal=([(x,) for x in days], "trading_days date"))
    want, quarter = [], lambda x: dt.date(x.year, (x.month - 1) // 3 * 3 + 1, 1)
    held = {(quarter(x), fund, i) for x, _, fund, i in items}
    for day in every_day(dt.date(1995, 2, 3), dt.date(1999, 7, 9)):
        for fund in "AN":
            last = max((q for q, f, _ in held if f == fund and q <= day), default=None)
            want += [(day, fund, i) for q, f, i in held if f == fund and q == last]
    assert rows(entry.queries()["j8_sk13_holdings_universe"](spark, d), "date", "fund", "id") == sorted(want)


def test_members_and_totals_after_1996(spark, tmp_path):
    orders = [(1, T(1995, 3, 1), 5.0), (1, T(1997, 1, 3), 7.5), (2, T(1999, 8, 2), 1.25), (2, T(1999, 8, 2), 2.0), (2, T(1999, 8, 5), 4.0)]
    days = every_day(dt.date(1994, 12, 1), dt.date(2001, 12, 31))
    d = tables(spark, tmp_path, orders=(orders, "o_custkey long, o_orderdate timestamp, o_totalprice double"), trading_cal=([(x,) for x in days if x.weekday() < 5], "trading_days date"))
    spans = {1: (dt.date(1995, 3, 1), dt.date(1997, 1, 3)), 2: (dt.date(1999, 8, 2), dt.date(1999, 8, 5))}
    want = sorted((day, i) for i, span in spans.items() for day in every_day(*span) if day.weekday() < 5)
    assert rows(entry.queries()["j9_interval_members"](spark, d), "date", "id") == want
    x = entry.queries()["j10_adjust_for_membership"](spark, d)
    assert rows(x, "date", "id") == want
    assert rows(x.where("total IS NOT NULL"), "date", "id", "total") == [
        (dt.date(1995, 3, 1), 1, 5.0), (dt.date(1997, 1, 3), 1, 7.5), (dt.date(1999, 8, 2), 2, 3.25), (dt.date(1999, 8, 5), 2, 4.0),
    ]


@pytest.mark.parametrize("late", ["12.5", "A1"])
def test_csv_cells_beyond_the_inferred_type_are_not_lost(spark, tmp_path, late):
    src = tmp_path / "in.csv"
    src.write_text("k,x\n" + "".join(f"{i},{i}\n" for i in range(6000)) + f"6000,{late}\n")
    spec = {"schema": "mill_late", "table": "t", "file_path": str(src)}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        shape(spark, spec).collect()
    for x in (shape(spark, spec | {"rows_to_interpret": 7000}), shape(spark, spec | {"csv_schema": "k int, x string"})):
        assert x.count() == 6001 and x.where("x IS NULL").count() == 0 and str(x.where("k = 6000").first()["x"]) == late
    assert read_csv(spark, str(src), 7000).columns == ["k", "x"]


def daily_tables(spark, tmp_path, daily, ranks):
    schema = "date date, permno int, prc double, shrout double, cfacpr double, cfacshr double, shrcd int, loaded_at timestamp"
    cstat = ([], "gvkey string, iid string, date date, prccd double, cshoc double, ajexdi double, loaded_at timestamp")
    return tables(
        spark, tmp_path, crsp_sd=(daily, schema), cstat_sd=cstat, crsp_cstat_link=([], "lpermno int"), trading_cal=([], "trading_days date"),
        temp_rank_crsp_mc=(ranks, "date date, permno int, ttm_mc_rank int"),
    )


def test_universe_over_the_whole_year(spark, tmp_path):
    a, b, c = dt.date(2024, 1, 5), dt.date(2024, 9, 2), dt.date(2024, 12, 30)
    daily = [(x, i, -4.0, 2.0, 2.0, 3.0, 11, T(2025, 2, 1)) for x in (dt.date(2024, 1, 2), a, b, c) for i in (1, 2)]
    d = daily_tables(spark, tmp_path, daily, [(a, 1, 1), (b, 1, 20), (c, 1, 3), (b, 2, 21)])
    run = lambda name, *cols: rows(entry.queries()[name](spark, d), *cols)
    assert run("sc1_sc6_adjusted_scan_of_universe", "date", "permno", "prc", "shrout") == [(x, 1, 2.0, 6.0) for x in (dt.date(2024, 1, 2), a, b, c)]
    assert run("sc3_universe_scan", "date", "permno") == [(a, 1), (b, 1), (c, 1)]
    assert run("j11_j12_long_universe", "date", "permno", "prc") == [(b, 1, -4.0)]


def test_asset_list_of_all_ids(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    daily = [(day + dt.timedelta(k), i, i + k / 2, 1.0, 1.0, 1.0, 11, T(2024, 2, 1)) for i in range(1200) for k in (0, 1)]
    d = daily_tables(spark, tmp_path, daily, [])
    assert rows(entry.queries()["sc7_j1_asset_list"](spark, d), "date", "permno", "prc") == sorted(x[:3] for x in daily)


def test_fund_with_many_names_is_still_ambiguous(spark):
    names = [(1, "X", f"name {k}") for k in range(40)]
    funds = lambda data: spark.createDataFrame(data, "crsp_portno int, ticker string, fund_name string").coalesce(1)
    assert fund_id(funds(names), "X") == 1
    for k in range(2, 12):
        with pytest.raises(ValueError, match=f"1 name 0; {k} other"):
            fund_id(funds([*names, (k, "X", "other")]), "X")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_reports_run_all_their_outputs(spark):
    q, got = entry.queries(), {}
    for name in ("t2_t3_full_report", "t4_inspection_report", "t5_ic_report", "t6_turnover_report"):
        for r in q[name + "_whole"](spark, SF).collect():
            got.setdefault(name, {}).setdefault((r["report"], r["output"]), set()).add((r["date"], r["series"], r["value"]))
    full = got["t2_t3_full_report"]
    assert len(full) == 21 and {r for r, _ in full} == {"coverage", "inspection", "backtest", "ic", "turnover"}
    for name, report in (("t4_inspection_report", "inspection"), ("t5_ic_report", "ic"), ("t6_turnover_report", "turnover")):
        assert got[name] == {k: v for k, v in full.items() if k[0] == report}
    returns = {(r["date"], f"series={r['series']}, ret", r["ret"]) for r in q["t2_t3_full_report"](spark, SF).collect()}
    assert {x for x in full["backtest", "returns"] if "universe" not in x[1]} == returns
    assert full["inspection", "count"] == {(r["date"], "count", r["count"]) for r in q["t4_inspection_report"](spark, SF).collect()}
    assert full["turnover", "turnover"] == {(r["date"], f"ntile={r['ntile']}, turnover", r["turnover"]) for r in q["t6_turnover_report"](spark, SF).collect()}
