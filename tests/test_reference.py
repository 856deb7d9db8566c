"""Reference operators: hand-computed panels, re-created expectations, properties."""

import datetime as dt
import os
import warnings

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelmill.functions import dates
from panelmill.functions.numeric import corr, skew_sample
from panelmill.operators import backtest, ic, stats, turnover
from panelmill.operators.cross import bucket_factor, ntile_columns, rank_columns, robust_scores
from panelmill.operators.membership import MembershipAdjuster, fund_id, holdings_universe, link_permno, market_cap_ranks, parse_fund_name
from panelmill.operators.panel import check_factor, dense_grid, finite_filter, handle_duplicates, positions
from panelmill.operators.returns import aligned_panel, forward_returns, simple_returns
from panelmill.operators.walkforward import LeastSquares, fold_table, walk_forward
from panelmill.plans.tears import Ntile
from panelmill.sources.ingest import Store, db_tables, drop_schema, ingest, table_info
from panelmill.sources.portals import PricingPortal, SectorPortal, TimeVaryingGroups
from panelmill.sources.query import Query, adjusted, link_join

D = lambda n: dt.date(2010, 1, 4) + dt.timedelta(n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- membership: the expectations of the original tests


MEMBERS = [("BOB", "2009-01-01", "2012-01-01"), ("LARY", "2010-01-05", "2010-01-07"), ("JEFF", "2011-03-02", "2020-03-02")]


def members(spark, data=MEMBERS):
    return spark.createDataFrame(data, "symbol string, from string, thru string").withColumns({c: F.to_date(c) for c in ("from", "thru")})


JAN = [dt.date(2010, 1, k) for k in (4, 5, 6, 7, 8, 11, 12)]


def test_universe_index(spark):
    got = rows(MembershipAdjuster(spark).add_universe_info(members(spark), "2010-01-04", "2010-01-12"))
    assert got == sorted([(d, "BOB") for d in JAN] + [(dt.date(2010, 1, k), "LARY") for k in (5, 6, 7)], key=str)


def test_universe_errors(spark):
    a = MembershipAdjuster(spark)
    with pytest.raises(ValueError, match='Required column "symbol" is not present'):
        a.add_universe_info(spark.createDataFrame([], "foo int, foo1 int, foo2 int"), "2010-01-04", "2010-01-12")
    twice = [MEMBERS[0], ("BOB", *MEMBERS[1][1:]), MEMBERS[2]]
    with pytest.raises(ValueError) as e:
        a.add_universe_info(members(spark, twice), "2010-01-04", "2010-01-12")
    assert str(e.value) == "The column symbol is 0.333 duplicates, 1 rows\n"
    data = spark.createDataFrame([], "foo int, notSymbol int, factor int")
    with pytest.raises(ValueError, match="Universe is not set"):
        a.adjust_data_for_membership(data)
    a.add_universe_info(members(spark), "2010-01-04", "2010-01-12")
    with pytest.raises(ValueError, match='Required column "date" is not present'):
        a.adjust_data_for_membership(data)


def test_adjust_for_membership(spark):
    data = [("BOB", d, 46 + d.day) for d in JAN if d.day != 8] + [("LARY", d, 16 + d.day) for d in [*JAN, dt.date(2010, 1, 13)]] + [("FOO", dt.date(2010, 1, 8), 0)]
    a = MembershipAdjuster(spark)
    a.add_universe_info(members(spark), "2010-01-04", "2010-01-12")
    got = rows(a.adjust_data_for_membership(spark.createDataFrame(data, "symbol string, date date, factor long")))
    want = [("BOB", d, None if d.day == 8 else 46 + d.day) for d in JAN] + [("LARY", dt.date(2010, 1, k), 16 + k) for k in (5, 6, 7)]
    assert got == sorted(want, key=str)


def test_long_universe_excludes_both_ends(spark):
    u = spark.createDataFrame([(d, "BOB") for d in JAN], "date date, symbol string")
    a = MembershipAdjuster(spark)
    assert a.add_universe_info_long(u, "2010-01-04", "2010-01-12").count() == 5
    assert a.add_universe_info_long(u, "2010-01-04", "2010-01-12", closed="both").count() == 7
    assert a.add_universe_info_from_db("U", {"U": u}, "2010-01-05", "2010-01-08").count() == 2


# ---- folds


CASES = [
    ((10, 5, 30, None), [(0, 29, 40, 44), (0, 34, 45, 49), (0, 39, 50, 54), (0, 44, 55, 59)]),
    ((7, 8, 30, None), [(0, 29, 37, 44), (0, 37, 45, 52), (0, 45, 53, 59)]),
    ((10, 5, None, 30), [(0, 29, 40, 44), (5, 34, 45, 49), (10, 39, 50, 54), (15, 44, 55, 59)]),
    ((7, 8, None, 30), [(0, 29, 37, 44), (8, 37, 45, 52), (16, 45, 53, 59)]),
]


def walk_panel(spark, value=0.0):
    start = dt.date(2010, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(i), s, value, 0.0) for i in range(60) for s in ("BOB", "JEFF", "CARL")], "date date, id string, x double, y double")


@pytest.mark.parametrize("args,want", CASES)
def test_folds(spark, args, want):
    start = dt.date(2010, 1, 1)
    got = rows(fold_table(walk_panel(spark), args[0], args[1], expanding=args[2], rolling=args[3]))
    assert [tuple((x - start).days for x in r[1:]) for r in got] == want


def test_no_folds_when_there_is_no_room(spark):
    assert fold_table(walk_panel(spark), 31, 5, expanding=30).count() == 0


@pytest.mark.parametrize(
    "args,text",
    [
        ((0, 5, 30, None), "eval_days and/or refit_every must be greater than zero"),
        ((10, -1, 30, None), "eval_days and/or refit_every must be greater than zero"),
        ((10, 5, -30, None), "expanding must be greater than zero"),
        ((10, 5, None, -30), "rolling must be greater than zero"),
        ((10, 5, 30, 30), "minTrainDays and rollingDays can not both be defined"),
        ((10, 5, None, None), "minTrainDays or rollingDays must be defined"),
    ],
)
def test_fold_errors(spark, args, text):
    with pytest.raises(ValueError, match=text):
        walk_forward(LeastSquares(), walk_panel(spark), ["x"], "y", args[0], args[1], args[2], args[3])


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_walk_forward_rejects_bad_values(spark, bad):
    p = walk_panel(spark)
    hit = F.when((F.col("id") == "BOB") & (F.col("date") == "2010-01-05"), F.lit(bad).cast("double"))
    with pytest.raises(ValueError, match="There are nan or inf values in the features"):
        walk_forward(LeastSquares(), p.withColumn("x", F.when(hit.isNotNull() | ((F.col("id") == "BOB") & (F.col("date") == "2010-01-05")), hit).otherwise(F.col("x"))), ["x"], "y", 10, 5, 30)
    with pytest.raises(ValueError, match="There are nan or inf values in the target"):
        walk_forward(LeastSquares(), p.withColumn("y", F.when((F.col("id") == "BOB") & (F.col("date") == "2010-01-05"), hit).otherwise(F.col("y"))), ["x"], "y", 10, 5, 30)


def test_walk_forward_predicts(spark):
    p = walk_panel(spark).withColumn("x", F.dayofyear("date").cast("double") + F.length("id")).withColumn("y", 3 + 2 * F.col("x"))
    got = walk_forward(LeastSquares(), p, ["x"], "y", 10, 5, expanding=30).join(p, ["date", "id"])
    assert got.count() == 60 and got.where(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count() == 0


# ---- a 3-date, 4-asset panel by hand


PANEL = [(0, "a", 4.0), (0, "b", 3.0), (0, "c", 2.0), (0, "d", 1.0), (1, "a", 4.0), (1, "b", 1.0), (1, "c", 3.0), (1, "d", 2.0), (2, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0), (2, "d", 4.0)]
RET = {0: (0.01, 0.02, 0.03, 0.04), 1: (0.04, 0.03, 0.02, 0.01), 2: (-0.01, 0.02, -0.03, 0.04)}


def small(spark):
    f = spark.createDataFrame([(D(k), i, v) for k, i, v in PANEL], "date date, id string, factor double")
    r = spark.createDataFrame([(D(k), i, v) for k, vs in RET.items() for i, v in zip("abcd", vs)], "date date, id string, ret double")
    return f, r


def test_ntile_by_hand(spark):
    f, _ = small(spark)
    got = {(r["date"], r["id"]): r["ntile"] for r in bucket_factor(f, 2).collect()}
    assert [got[D(0), x] for x in "abcd"] == [1, 1, 2, 2] and [got[D(1), x] for x in "abcd"] == [1, 2, 1, 2] and [got[D(2), x] for x in "abcd"] == [2, 2, 1, 1]


def test_ntile_skips_null_nan_inf_and_breaks_ties_by_id(spark):
    f = spark.createDataFrame([(D(0), "b", 1.0), (D(0), "a", 1.0), (D(0), "c", None), (D(0), "d", float("nan")), (D(0), "e", float("inf")), (None, "f", 1.0)], "date date, id string, factor double")
    assert rows(bucket_factor(f, 2).select("id", "ntile")) == [("a", 1), ("b", 2)]
    assert bucket_factor(f.limit(0), 3).count() == 0


@pytest.mark.parametrize("buckets", [1, 5, 7])
def test_hot_dates_are_split_with_equal_results(spark, buckets):
    rng = np.random.default_rng(buckets)
    data = [(D(0), i, float(rng.integers(0, 40))) for i in range(700)] + [(D(1), i, float(rng.normal())) for i in range(60)] + [(D(2), i, 1.0) for i in range(300)]
    data += [(D(3), i, float(i)) for i in range(3)] + [(D(0), 9000, None), (D(0), 9001, float("nan")), (D(1), 9002, float("inf"))]
    f = spark.createDataFrame(data, "date date, id int, factor double")
    assert rows(bucket_factor(f, buckets, part=50)) == rows(bucket_factor(f, buckets)) and len(rows(bucket_factor(f, buckets))) == 1063


def test_weights_and_returns_by_hand(spark):
    f, r = small(spark)
    a = aligned_panel(bucket_factor(f, 2), r)
    w1 = {tuple(x)[:3]: x["weight"] for x in backtest.bucket_weights(a, 1).collect()}
    assert w1[1, "a", 1] == pytest.approx(0.5) and len(w1) == 12
    w2 = {tuple(x)[:3]: x["weight"] for x in backtest.bucket_weights(a, 2).collect()}
    assert w2[2, "a", 1] == pytest.approx(0.5) and w2[2, "b", 1] == pytest.approx(0.25) and w2[2, "c", 1] == pytest.approx(0.25)
    b1 = {(x["date"], x["ntile"]): x["ret"] for x in backtest.bucket_returns(a, 1, 2, "D").collect()}
    assert b1[D(0), 1] == pytest.approx(0.015) and b1[D(1), 1] == pytest.approx(0.03) and b1[D(2), 2] == pytest.approx(0.005) and b1[D(-1), 1] == 0
    b2 = {(x["date"], x["ntile"]): x["ret"] for x in backtest.bucket_returns(a, 2, 2, "D").collect()}
    assert b2[D(0), 1] == 0 and b2[D(1), 1] == pytest.approx(0.5 * 0.04 + 0.25 * 0.03 + 0.25 * 0.02) and len(b2) == 6


def test_spread_is_the_same_market_neutral(spark):
    f, r = small(spark)
    a = aligned_panel(bucket_factor(f, 4), r)
    get = lambda neutral: {(x["date"], x["series"]): x["ret"] for x in backtest.series_returns(a, 1, 4, "D", market_neutral=neutral).collect() if "vs" in x["series"]}
    x, y = get(True), get(False)
    assert set(x) == set(y) and {s for _, s in x} == {"1 vs 4", "2 vs 3"}
    assert all(x[k] == pytest.approx(y[k]) for k in x)
    assert x[D(0), "1 vs 4"] == pytest.approx((0.01 - 0.04) / 2)


def test_forward_returns_and_ic_by_hand(spark):
    f, r = small(spark)
    fwd = {(x["date"], x["id"]): x["fwd"] for x in forward_returns(r, 2).collect()}
    assert fwd[D(0), "a"] == pytest.approx(1.04 * 0.99 - 1) and fwd[D(1), "a"] is None
    got = {x["date"]: x["ic"] for x in ic.daily_ic(f, r, 1).collect()}
    assert got[D(0)] == pytest.approx(np.corrcoef([4, 3, 2, 1], RET[1])[0, 1]) and got[D(2)] is None


def test_turnover_warms_up_with_one(spark):
    f, _ = small(spark)
    got = {(x["date"], x["ntile"]): x["turnover"] for x in turnover.bucket_turnover(bucket_factor(f, 2), 1).collect()}
    assert got[D(0), 1] == 1.0 and got[D(1), 1] == 0.5 and got[D(2), 1] == 0.5
    assert turnover.bucket_turnover(bucket_factor(f, 2), 1, drop_warmup=True).count() == 4


def test_positional_lag_over_gaps(spark):
    f = spark.createDataFrame([(D(0), "a", 1.0), (D(2), "a", 2.0), (D(0), "b", 1.0), (D(1), "b", 5.0), (D(2), "b", 3.0)], "date date, id string, factor double")
    x = turnover.lagged(f.join(positions(f), "date"), "factor", 1)
    assert {(r["id"], r["pos"]): r["_prev"] for r in x.collect()} == {("a", 1): None, ("a", 3): None, ("b", 1): None, ("b", 2): 1.0, ("b", 3): 5.0}


@pytest.mark.parametrize("n,want", [(4, [1, 1, -1, -1]), (5, [1, 1, None, -1, -1])])
def test_drawdown_flip(spark, n, want):
    s = spark.createDataFrame([(D(0), f"Ntile: {k}", 1.0, k) for k in range(1, n + 1)], "date date, series string, ret double, k int")
    got = {r["k"]: r["ret"] for r in stats.flip_lower_half(s, F.col("k"), n).collect()}
    assert [got[k] for k in range(1, n + 1)] == want


def test_statistics_by_hand(spark):
    r = [0.0, 0.1, -0.2, 0.05]
    s = spark.createDataFrame([(D(i), "x", v) for i, v in enumerate(r)], "date date, series string, ret double")
    got = stats.statistics(s, 252).first()
    assert got["sharpe"] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * 252**0.5)
    assert got["cagr"] == pytest.approx((np.prod(1 + np.array(r)) ** (252 / 4) - 1) * 100)
    assert got["max_drawdown"] == pytest.approx(-20) and got["periods_up"] == 0.5
    assert stats.per_series(s, "worst", lambda x: float(x.min()) if isinstance(x, pd.Series) else None).first()["worst"] == -0.2


def test_simple_returns_gap_and_clip(spark):
    p = spark.createDataFrame([(D(0), "a", 10.0), (D(2), "a", 11.0), (D(0), "b", 1.0), (D(1), "b", 9.0), (D(2), "b", 0.5), (D(3), "b", float("nan"))], "date date, id string, price double")
    got = {(r["date"], r["id"]): r["ret"] for r in simple_returns(p).collect()}
    assert got[D(1), "a"] == 0 and got[D(2), "a"] == pytest.approx(0.1) and got[D(1), "b"] == 1.5 and got[D(2), "b"] == -0.75 and got[D(3), "b"] == 0 and len(got) == 6


def test_tilts_concentration_and_coverage(spark):
    f, r = small(spark)
    a = aligned_panel(bucket_factor(f, 2), r)
    g = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, grp int")
    share = backtest.group_shares(g, a)
    assert rows(share) == sorted([(1, 0.5), (2, 0.25), (-1, 0.25)], key=str)
    t = backtest.group_tilts(backtest.bucket_weights(a, 1), positions(a), g, share)
    assert {r["grp"]: r["tilt"] for r in t.where((F.col("date") == D(0)) & (F.col("ntile") == 1)).collect()} == {1: 0.5, 2: -0.25, -1: -0.25}
    assert backtest.concentration(a, 1).count() == 6
    c = backtest.coverage(f.unionByName(f.limit(1).withColumn("factor", F.lit(None).cast("double"))), r.where("id <> 'd'")).first()
    assert c["missing"] == pytest.approx(100 / 13) and c["lost_in_alignment"] == pytest.approx(300 / 13) and c["lost_for_returns"] == pytest.approx(300 / 13)


def test_full_report(spark):
    f, r = small(spark)

    class P:
        freq, returns = "D", r

    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        n = Ntile(P, SectorPortal.from_groups(spark.createDataFrame([("a", 1)], "id string, grp int")))
        out = n.full_tear(f, 2, 1, show_uni=True, show_ntile_tilts=True)
    assert any("less than 100" in str(x.message) for x in w)
    assert set(out) == {"coverage", "inspection", "backtest", "ic", "turnover"}
    for part in out.values():
        for df in part.values():
            df.collect()
    assert {x["series"] for x in out["backtest"]["returns"].collect()} == {"Ntile: 1", "Ntile: 2", "universe", "1 vs 2"}
    assert set(n.ntile_ic_horizon(f, [2, 1], True)) == {"horizon", "ic_1", "ic_2"}
    n.clear()


def test_factor_checks(spark):
    f, r = small(spark)
    with pytest.raises(ValueError, match="duplicate"):
        check_factor(f.union(f), r)
    with pytest.raises(ValueError, match="no date in common"):
        check_factor(f.withColumn("date", F.date_add("date", 100)), r)
    with pytest.raises(ValueError, match='Required column "id"'):
        check_factor(f.drop("id"), r)
    assert any("1 ids" in t for t in check_factor(f, r.where("id <> 'a'")))


# ---- properties


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 6), st.integers(1, 4), st.integers(0, 10**6))
def test_weight_and_bucket_properties(spark, buckets, hp, seed):
    rng = np.random.default_rng(seed)
    data = [(D(k), i, float(rng.integers(0, 6))) for k in range(6) for i in range(9) if rng.random() < 0.8]
    f = spark.createDataFrame(data, "date date, id int, factor double")
    r = spark.createDataFrame([(D(k), i, float(rng.normal(0, 0.05))) for k in range(6) for i in range(9)], "date date, id int, ret double")
    b = bucket_factor(f, buckets)
    sizes = b.groupBy("date", "ntile").count().groupBy("date").agg((F.max("count") - F.min("count")).alias("gap")).agg(F.max("gap")).first()[0]
    assert sizes <= 1
    a = aligned_panel(b, r)
    most = backtest.bucket_weights(a, hp).groupBy("pos", "ntile").agg(F.sum("weight").alias("w")).agg(F.max("w")).first()[0]
    assert most is None or most <= 1 + 1e-9
    lo, hi = ic.daily_ic(f, r, hp).agg(F.min("ic"), F.max("ic")).first()
    assert lo is None or (-1 - 1e-9 <= lo and hi <= 1 + 1e-9)


# ---- cross-section


def test_ranks_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (1, "c", 3.0), (1, "d", 3.0), (1, "e", float("nan"))], "g int, id string, x double")
    got = {r["id"]: r["x"] for r in rank_columns(df, ["g"], ["id"]).collect()}
    assert got == {"a": 0.0, "b": None, "c": 0.25, "d": 0.25, "e": None}
    got = {r["id"]: r["x"] for r in ntile_columns(df, 5, ["g"], ["id"]).collect()}
    assert got == {"c": 1, "d": 2, "a": 3, "b": 4, "e": 5}
    with pytest.raises(ValueError):
        rank_columns(df, ["g"], ["id"], "sum")


def test_robust_scores_without_variance(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (2, 8.0)], "g int, x double")
    got = rows(robust_scores(df, ["g"]))
    assert [x for g, x in got if g == 1] == [None, None] and ([x for g, x in got if g == 2 and x is not None and abs(x) < 1e-12])


def test_corr_and_skew(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (10.0, 2.0), (float("nan"), 1.0), (None, 3.0)], "x double, y double")
    r = df.agg(corr(F.col("x"), F.col("y")).alias("c"), skew_sample(F.when(~F.isnan("x"), F.col("x"))).alias("s")).first()
    assert r["c"] is None and r["s"] == pytest.approx(pd.Series([1.0, 2.0, 10.0]).skew())


def test_finite_filter_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, None), (5, 2.0)], "k int, x double")
    with pytest.raises(ValueError, match="Max loss exceeded"):
        finite_filter(df, 0.1)
    kept, info = finite_filter(df, 0.9)
    assert kept.count() == 2 and info == {"rows": 5, "nan": 2, "inf": 1, "share": 0.6}
    assert finite_filter(df.limit(0), 0.1)[1]["rows"] == 0
    twice = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "k int, seq int")
    with pytest.warns(UserWarning, match="0.333 duplicates, 1 rows"):
        assert rows(handle_duplicates(twice, "Warning", "k", drop=True, subset=["k"])) == [(1, 3), (2, 9)]


def test_dense_grid(spark):
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    d = spark.createDataFrame([(D(0),), (D(5),), (None,)], "date date")
    assert rows(dense_grid(ids, d)) == [("a", D(0), 1), ("a", D(5), 2), ("b", D(0), 1), ("b", D(5), 2)]
    assert dense_grid(ids.limit(0), d).count() == 0


# ---- dates


def test_periods(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 3),)], "d date")
    got = df.select(*[dates.to_period("d", f).alias(f) for f in "DBWMQA"], *[dates.period_end("d", f).alias("e" + f) for f in "WMQA"]).first()
    assert [str(x) for x in got] == ["2024-02-03", "2024-02-05", "2024-01-29", "2024-02-01", "2024-01-01", "2024-01-01", "2024-02-04", "2024-02-29", "2024-03-31", "2024-12-31"]
    assert [dates.annualization(f) for f in ("D", "W", "M", "Q", "Y", "A", "ME", "W-SUN", "QE-DEC", "YE-DEC")] == [252, 52, 12, 4, 1, 1, 12, 52, 4, 1]
    with pytest.raises(ValueError):
        dates.annualization("X")


def test_exchange_calendar(spark):
    got = [r[0] for r in dates.trading_days(spark, "2012-10-25", "2012-11-02").orderBy("date").collect()]
    assert [d.day for d in got] == [25, 26, 31, 1, 2]
    assert dates.trading_days(spark, "2010-01-04", "2010-01-12").count() == 7
    assert dates._easter(2024) == dt.date(2024, 3, 31) and dt.date(2024, 3, 29) in dates.us_exchange_holidays(2024)
    assert dates.trading_days(spark, "2010-01-05", "2010-01-04").count() == 0
    assert dates.trading_days(spark, "2010-01-01", "2010-01-10", "full").count() == 10


def test_date_config(spark):
    df = spark.createDataFrame([("20240102", "a", 1.0), ("20240115", "a", None), ("20240120", "a", float("nan")), ("20240203", "a", 3.0), (None, "a", 4.0)], "date string, k string, v double")
    c = dates.DateConfig("M", date_format="%Y%m%d", resample=True, grouper_keys=["k"])
    assert rows(c.configure_dates(df, "date")) == [(dt.date(2024, 1, 1), "a", 1.0), (dt.date(2024, 2, 1), "a", 3.0)]
    assert c.copy(resample=False, target_data_type="timestamp").configure_dates(df, "date").count() == 5
    for bad in (dict(freq="X"), dict(freq="D", target_data_type="x")):
        with pytest.raises(ValueError):
            dates.DateConfig(**bad)
    with pytest.raises(ValueError, match="date_format"):
        dates.DateConfig("M").configure_dates(df, "date")
    two = df.withColumn("d2", F.col("date"))
    with pytest.raises(ValueError, match="resample_key"):
        dates.DateConfig("M", date_format="%Y%m%d", resample=True).configure_dates(two, ["date", "d2"])


# ---- builder, links, ranks, holdings


def test_builder_adjusts_and_chains(spark):
    t = spark.createDataFrame([(D(0), 1, -10.0, 2.0, 3.0, 4.0), (D(1), 1, 8.0, 0.0, 3.0, 1.0), (D(1), 2, 8.0, 2.0, None, 1.0)], "date date, permno int, prc double, cfacpr double, shrout double, cfacshr double")
    q = Query(spark, {"crsp.sd": t})
    x = q.query_timeseries_table("crsp.sd", ["prc", "shrout", "prc"], [1], "permno", "2010", "2011")
    assert x.fields == ["date", "permno", "prc", "shrout"] and rows(x.df) == [(D(0), 1, 5.0, 12.0), (D(1), 1, None, 3.0)]
    assert x.dropna("prc").df.count() == 1 and x.where("prc > 3").where("shrout > 20 OR prc < 6").df.count() == 1
    assert x.shift("prc", 1).fields[-1] == "prc_lag_1" and x.rename({"permno": "id"}).id == "id"
    assert x.shift_all(1).df.where("prc = 5.0").first()["date"] == D(1)
    assert x.add_to_select("prc * 2", "twice").df.where("twice = 10.0").count() == 1
    assert [r["prc"] for r in x.order_by("prc").df.collect()] == [5.0, None]
    with pytest.raises(ValueError):
        adjusted("prc", "unknown")
    with pytest.raises(ValueError, match="not known"):
        q.query_timeseries_table("crsp.sd", ["prc"], "NO_SUCH", "permno")


@pytest.mark.parametrize("count", [0, 1, 1000, 1001])
def test_id_lists_of_any_length_and_type(spark, count):
    base = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.date_add(F.lit(D(0)), F.col("id").cast("int")).alias("date"), F.col("id").cast("string").alias("s"))
    base = base.withColumns({"ts": F.col("date").cast("timestamp_ntz"), "n": F.col("k").cast("decimal(12,2)"), "x": F.col("k") / 2})
    q = Query(spark, {"t": base})
    lists = {
        "k": list(range(count)), "date": [D(i) for i in range(count)], "s": [str(i) for i in range(count)], "ts": [dt.datetime.combine(D(i), dt.time()) for i in range(count)],
        "n": list(range(count)), "x": [i / 2 for i in range(count)],
    }
    for by, ids in lists.items():
        got = q.query_no_date_table("t", ["k"], [*ids, None, *ids[:1]], by).df
        assert sorted(r["k"] for r in got.collect()) == list(range(count)), by
    assert q.query_no_date_table("t", ["k"], [str(i) for i in range(count)], "k").df.count() == count


def test_calendar_makes_nan_null(spark):
    t = spark.createDataFrame([(JAN[0], 1, float("nan")), (JAN[1], 1, 2.0)], "date date, id int, x double")
    got = Query(spark, {"t": t}).query_timeseries_table("t", ["x"], "*", "id", str(JAN[0]), str(JAN[1]), adjust=False).set_calendar("NYSE").df
    assert rows(got) == sorted([(JAN[0], 1, None), (JAN[1], 1, 2.0)], key=str)


def test_builder_calendar_resample_and_fill(spark):
    t = spark.createDataFrame([(dt.date(2010, 1, 2), 1, 5.0), (dt.date(2010, 1, 6), 1, 7.0)], "date date, id int, x double")
    q = Query(spark, {"t": t}).query_timeseries_table("t", ["x"], "*", "id", "2010-01-02", "2010-01-12", adjust=False)
    assert sorted(map(tuple, q.set_calendar("NYSE").df.collect())) == [(d, 1, 7.0 if d.day == 6 else None) for d in JAN]
    assert q.set_calendar("full").df.count() == 10
    got = [r["x"] for r in q.resample("NYSE", 3).df.orderBy("date").collect()]
    assert got == [5.0, 5.0, 7.0, 7.0, 7.0, None, None]
    assert [r["x"] for r in q.resample("NYSE").df.orderBy("date").collect()][-1] == 7.0


def test_link_join_boundaries_and_clashing_names(spark):
    df = spark.createDataFrame([(D(i), 1) for i in range(4)], "date date, permno int").withColumn("gvkey", F.lit("mine"))
    link = spark.createDataFrame([(1, "g", D(1), D(2)), (1, "open", D(3), None), (None, "x", D(0), D(9))], "lpermno int, gvkey string, a date, z date")
    count = lambda how: link_join(df, link, {"permno": "lpermno"}, ["gvkey"], "a", "z", closed=how).where("gvkey_link IS NOT NULL").count()
    assert (count("both"), count("neither"), count("left"), count("right")) == (3, 0, 1, 1)


def test_linked_universe_keeps_or_drops_multiplicity(spark):
    u = spark.createDataFrame([(D(0), 1), (D(0), 2)], "date date, permno int")
    g = spark.createDataFrame([(1, "b", "01", D(-9), None, "LU"), (1, "a", None, D(-9), D(9), "LC"), (2, "c", "01", D(-9), None, "NR")], "lpermno int, gvkey string, liid string, linkdt date, linkenddt date, linktype string")
    t = spark.createDataFrame([(1, "T", "C", D(-1), D(1))], "permno int, ticker string, cusip string, sdate date, edate date")
    assert link_permno(u, g, t).count() == 3
    got = {r["permno"]: (r["gvkey"], r["id"], r["ticker"]) for r in link_permno(u, g, t, dedup="first").collect()}
    assert got == {1: ("a", "a_", "T"), 2: (None, None, None)}


def test_market_cap_ranks_look_back_only(spark):
    days = spark.createDataFrame([(D(i),) for i in range(3)], "date date")
    data = [(D(i), k, 10.0 * k + i, 1.0, 11) for i in range(4) for k in (1, 2)] + [(D(i), 3, 1.0, 100.0, 11) for i in range(3)] + [(D(i), 4, 90.0, 9.0, 12) for i in range(3)]
    r = market_cap_ranks(spark.createDataFrame(data, "date date, permno int, prc double, shrout double, shrcd int"), "permno", "prc", "shrout", days, "shrcd = 11")
    assert [(x["date"], x["permno"], x["ttm_mc"], x["ttm_mc_rank"]) for x in r.orderBy("date", "ttm_mc_rank").collect()] == [(D(1), 2, 20.0, 1), (D(1), 1, 10.0, 2), (D(2), 2, 20.5, 1), (D(2), 1, 10.5, 2)]


def test_holdings_last_until_the_next_snapshot(spark):
    h = spark.createDataFrame([(D(0), 9, "a"), (D(0), 9, "b"), (D(0), 9, "b"), (D(2), 9, "c"), (D(2), 9, None)], "date date, fund int, id string")
    days = spark.createDataFrame([(D(i),) for i in range(4)], "date date")
    assert rows(holdings_universe(h, days, "fund", "id")) == [(D(0), 9, "a"), (D(0), 9, "b"), (D(1), 9, "a"), (D(1), 9, "b"), (D(2), 9, "c"), (D(3), 9, "c")]


def test_fund_lookup(spark):
    s = spark.createDataFrame([(1, "SPY", "S"), (2, "X", "X1"), (3, "X", "X2")], "crsp_portno int, ticker string, fund_name string")
    assert fund_id(s, "SPY") == 1 and fund_id(s, portno=7) == 7
    with pytest.raises(ValueError, match="not known"):
        fund_id(s, "NO")
    with pytest.raises(ValueError, match="X1"):
        fund_id(s, "X")
    assert parse_fund_name("ETF_SPY") == {"ticker": "SPY"} and parse_fund_name("ETF_5648362") == {"portno": 5648362}
    with pytest.raises(ValueError):
        parse_fund_name("SPY")


# ---- ingest and stored results


def test_ingest_round_trip(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text("PERMNO,Date,PRC,thru\n1,20240131,1.5,E\n2,20240229,,20240301\n3,20240301,9.5,E\n")
    spec = {
        "schema": "mill_test", "table": "sd", "file_path": str(src), "where": "PERMNO < 3", "custom": {"thru": "CASE WHEN thru = 'E' THEN '29991231' ELSE thru END"},
        "rename": {"PRC": "Price"}, "alter_type": {"Date": ["timestamp", "%Y%m%d"], "thru": ["timestamp", "%Y%m%d"]}, "index": "permno",
    }
    drop_schema(spark, "mill_test")
    assert ingest(spark, [spec], partitions=2) == ["mill_test.sd"]
    t = spark.table("mill_test.sd")
    assert t.columns == ["permno", "date", "price", "thru"] and sorted((r[0], r[1].date(), r[2], r[3].year) for r in t.collect()) == [(1, dt.date(2024, 1, 31), 1.5, 2999), (2, dt.date(2024, 2, 29), None, 2024)]
    with pytest.raises(Exception):
        ingest(spark, [spec])
    ingest(spark, [spec | {"where": "PERMNO = 3"}], overwrite=True, partitions=2)
    assert spark.table("mill_test.sd").count() == 1 and table_info(spark, "mill_test.sd").count() == 4
    assert ("mill_test", "sd") in rows(db_tables(spark))
    drop_schema(spark, "mill_test")


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(D(i), i) for i in range(5)], "date date, permno int")
    name = s.universe_name("crsp", 500, 101)
    assert name == "CRSP_US_101_500" and s.universe_name("cstat", 500) == "CSTAT_US_500"
    s.write("universe", name, df, "date")
    assert rows(s.built_universe("crsp_us_101_500")) == rows(df)
    with pytest.raises(ValueError, match="does not exist"):
        s.built_universe("NO")
    s.write("fund", "ETF_7", df)
    assert s.fund_universe(7, str(D(0)), str(D(4))).count() == 3
    s.clear("universe")
    assert not s.exists("universe", name) and s.exists("fund", "ETF_7")


def test_cache_tells_queries_and_files_apart(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    at = lambda name: f"file://{tmp_path}/{name}.parquet"
    put = lambda name, first: spark.range(first, first + 5).select("id", *[(F.col("id") + i).alias(f"c{i}") for i in range(40)]).coalesce(1).write.mode("overwrite").parquet(at(name))
    put("one", 0), put("two", 100)
    one, two = (lambda: spark.read.parquet(at("one"))), (lambda: spark.read.parquet(at("two")))
    names = [f"c{i}" for i in range(38)]
    made = {
        "one": one().select("id"), "two": two().select("id"), "renamed": one().select(F.col("id").alias("k")), "wide a": one().select(*names, "c38"),
        "wide b": one().select(*names, "c39"), "filtered": one().where("id > 2").select("id"), "both": one().select("c0", "id").join(two().select("c0", "c9"), "c0", "full"),
        "nested": one().where(F.col("id") <= two().agg(F.min("id")).scalar()).select("id"), "nested one": one().where(F.col("id") <= one().agg(F.min("id")).scalar()).select("id"),
        "listed": one().where(F.col("id").isin(list(range(60)))).select("id"), "listed other": one().where(F.col("id").isin([*range(59), 77])).select("id"), "range": spark.range(4),
        "range 5": spark.range(5),
    }
    keys = {k: s.key(x) for k, x in made.items()}
    assert None not in keys.values() and len(set(keys.values())) == len(keys)
    assert s.key(one().where("id > 2").select("id")) == keys["filtered"] == s.key(one().select("id").where("id > 2"))
    for k, x in made.items():
        want = rows(x)
        assert rows(s.cached(x)) == want == rows(s.cached(x)), k
    stored = len(os.listdir(tmp_path / "store/cache"))
    assert stored == len(made)
    # changed files: another key, and the new rows
    put("one", 50)
    assert s.key(one().select("id")) != keys["one"] and rows(s.cached(one().select("id"))) == [(i,) for i in range(50, 55)]
    # an old entry is made anew; without a key nothing is stored
    assert s.cached(spark.range(4), max_age_days=0).count() == 4
    stored = len(os.listdir(tmp_path / "store/cache"))
    plus = F.udf(lambda x: x + 1, "long")
    held = two().select("id").persist()
    for x in (spark.createDataFrame([(1,)], "k int"), spark.range(3).select(plus("id")), two().select(F.expr("uuid()")), held):
        assert s.key(x) is None and s.cached(x) is x
    held.unpersist()
    assert len(os.listdir(tmp_path / "store/cache")) == stored
    s.clear("cache")
    assert not s.exists("cache", keys["two"])


def test_portals(spark):
    t = spark.createDataFrame([(d, 1, 10.0 + i, 1.0) for i, d in enumerate(JAN)], "date date, permno int, prc double, cfacpr double")
    link = spark.createDataFrame([(1, 45), (1, None), (2, None)], "permno int, gsector int")
    q = Query(spark, {"crsp.sd": t, "link.crsp_cstat_link": link})
    p = PricingPortal(q, "*", "permno", "2010-01-04", "2010-01-12")
    assert p.periods.count() == 6 and p.assets.count() == 1 and p.delta_data.first()["ret"] == pytest.approx(0.1)
    assert rows(SectorPortal(q, "*").group_information) == [(1, 45), (2, -1)]
    g = TimeVaryingGroups(spark.createDataFrame([(1, D(0), 5), (1, D(2), 6)], "id int, since date, grp int"))
    assert rows(g.at(spark.createDataFrame([(1, D(-1)), (1, D(1)), (1, D(3))], "id int, date date"))) == [(1, D(-1), None), (1, D(1), 5), (1, D(3), 6)]


def test_build_and_persist_universes(spark, tmp_path):
    from panelmill.sources.ingest import build_fund_universe, build_universe, save_ranks

    s = Store(spark, f"file://{tmp_path}/u")
    ranks = spark.createDataFrame([(D(i), k, k) for i in range(3) for k in (1, 2, 3)], "date date, permno int, ttm_mc_rank int")
    assert build_universe(s, ranks, "crsp", 2, start_date=str(D(0))).count() == 4 and s.built_universe("CRSP_US_2").count() == 4
    assert build_universe(s, ranks, "crsp", 3, 3, "2000-01-01", lambda u: u.withColumn("x", F.lit(1))).columns[-1] == "x"
    h = spark.createDataFrame([(D(0), 7, 1), (D(2), 7, 2), (D(0), 8, 3)], "date date, crsp_portno int, permno int")
    build_fund_universe(s, h, spark.createDataFrame([(D(i),) for i in range(4)], "date date"), 7)
    assert rows(s.fund_universe(7, str(D(0)), str(D(3))).select("date", "permno")) == [(D(1), 1), (D(2), 2)]
    drop_schema(spark, "mill_ranks")
    assert spark.table(save_ranks(spark, ranks, "mill_ranks", "mc")).count() == 9
    drop_schema(spark, "mill_ranks")


def test_pivot_and_clean_factor(spark):
    from panelmill.operators.panel import clean_factor, price_pivot

    df = spark.createDataFrame([("20240102", "a", 1.0), ("20240102", "a", 3.0), ("20240102", "b", float("nan")), ("20240103", "b", 4.0)], "date string, symbol string, x double")
    assert rows(price_pivot(df, "x", ["a", "b"], date_format="%Y%m%d")) == [(dt.date(2024, 1, 2), 2.0, None), (dt.date(2024, 1, 3), None, 4.0)]
    with pytest.warns(UserWarning, match="0.25 duplicates, 1 rows"):
        got = clean_factor(df, "x", max_loss=0.5, date_format="%Y%m%d")
    assert rows(got) == [(dt.date(2024, 1, 2), "a", 1.0), (dt.date(2024, 1, 3), "b", 4.0)]
    with pytest.raises(ValueError, match="date_format"):
        price_pivot(df, "x", ["a"])


# ---- session, connection, checks


def test_written_tables_go_with_their_owner(spark):
    from panelmill.session import Tables, scratch, table_path, written

    there = lambda df: [os.path.exists(p.removeprefix("file://")) for p in df.inputFiles()]
    outside = written(spark.range(3), "test")
    with scratch(spark):
        inside = written(spark.range(3), "test")
        with Tables(spark) as own:
            kept = written(spark.range(3), "test")
        assert inside.count() == 3
    assert not any(there(inside)) and all(there(outside)) and all(there(kept))
    own.clear()
    assert not any(there(kept)) and table_path(spark, "x") != table_path(spark, "x")


def test_shared_folder_is_required_off_one_machine(spark):
    from types import SimpleNamespace

    from panelmill.session import shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(far)


def test_broadcast_only_up_to_a_counted_size(spark):
    from panelmill.session import fetched, small

    df = spark.range(10).select(F.col("id").alias("k"), F.date_add(F.lit(D(0)), F.col("id").cast("int")).alias("date"))
    for make in (small, fetched):
        hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
        assert hinted(make(df, 10)) and not hinted(make(df, 9))
        assert rows(make(df, 10)) == rows(df) == rows(make(df, 9)) and make(df, 10).schema == df.schema
        assert make(df.limit(0), 10).count() == 0


def test_connection(spark):
    from panelmill.sources.ingest import Connection

    c, before = Connection(spark), spark.conf.get("spark.sql.shuffle.partitions")
    c.set_threads(3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and c.execute("SELECT :a + 1 AS b", {"a": 1}).first()["b"] == 2
    spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError):
        c.set_threads(0)
    c.close()
    with pytest.raises(ValueError, match="closed"):
        c.execute("SELECT 1")
    assert spark.range(1).count() == 1


@pytest.mark.parametrize("freq,step,ok", [("M", 1, True), ("M", 3, False), ("Q", 3, True), ("Q", 1, False), ("A", 12, True), ("Y", 12, True), ("D", 1, False), ("W", 1, False)])
def test_factor_and_returns_of_one_frequency(spark, freq, step, ok):
    days = [dt.date(2010 + m // 12, m % 12 + 1, 1) for m in range(0, 48, step)]
    f = spark.createDataFrame([(d, "a", 1.0) for d in days], "date date, id string, factor double")
    r = f.select("date", "id", F.col("factor").alias("ret"))
    if ok:
        check_factor(f, r, freq=freq)
    else:
        with pytest.raises(ValueError, match="frequency"):
            check_factor(f, r, freq=freq)
    check_factor(f.limit(2), r, freq="D")  # two dates say nothing


def test_resampling_many_rows_without_grouper_warns(spark):
    c = dates.DateConfig("M", resample=True)
    x = spark.range(10_001).select(F.date_add(F.lit(D(0)), (F.col("id") % 50).cast("int")).alias("date"), "id")
    with pytest.warns(UserWarning, match="without grouper_keys"):
        c.configure_dates(x, "date")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        c.configure_dates(x.limit(10_000), "date")
        c.copy(grouper_keys=["id"]).configure_dates(x, "date")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 25), st.integers(1, 6), st.integers(1, 7), st.integers(1, 9), st.booleans())
def test_fold_rows_follow_from_positions(spark, n, eval_days, refit, start, roll):
    from panelmill.operators.walkforward import fold_count, fold_rows

    panel = spark.range(n).select((F.col("id")).cast("int").alias("pos"), F.date_add(F.lit(D(0)), F.col("id").cast("int")).alias("date"))
    k = fold_count(n, eval_days, refit, start)
    train, ask = fold_rows(panel, k, eval_days, refit, start, start if roll else None)
    want_train, want_ask = [], []
    for i in range(k):
        te = i * refit + start - 1
        want_train += [(i, p) for p in range(te - start + 1 if roll else 0, te + 1)]
        want_ask += [(i, p) for p in range(te + eval_days + 1, min(te + eval_days + refit, n - 1) + 1)]
    assert sorted(map(tuple, train.select("fold", "pos").collect())) == sorted(want_train)
    assert sorted(map(tuple, ask.select("fold", "pos").collect())) == sorted(want_ask)


def test_horizons_in_one_pass_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    f = spark.createDataFrame([(D(k), i, float(rng.normal())) for k in range(12) for i in range(9) if rng.random() < 0.9], "date date, id int, factor double")
    r = spark.createDataFrame([(D(k), i, float(rng.normal(0, 0.05))) for k in range(14) for i in range(9)], "date date, id int, ret double")
    got = {x["horizon"]: tuple(x)[1:] for x in ic.ic_horizon(f, r, [3, 1, 3]).collect()}
    assert got == {f"{h}D": tuple(ic.ic_summary(ic.daily_ic(f, r, h), h).first())[1:] for h in (1, 3)}
    with pytest.raises(ValueError):
        ic.ic_horizon(f, r, [])


def test_effective_dates_keep_the_old_date_and_link(spark):
    x = spark.createDataFrame([(dt.date(2020, 12, 31), "g", 5.0), (dt.date(2021, 3, 1), "h", 6.0)], "date date, gvkey string, v double")
    link = spark.createDataFrame(
        [("g", 1, dt.date(2021, 6, 29), dt.date(2021, 7, 1), "LU", "P"), ("g", 2, dt.date(2021, 6, 30), dt.date(2022, 1, 1), "LC", "C"), ("g", 3, dt.date(2020, 1, 1), dt.date(2022, 1, 1), "LU", "J"),
         ("g", 4, dt.date(2020, 1, 1), dt.date(2022, 1, 1), "NR", "P")], "gvkey string, lpermno int, linkdt date, linkenddt date, linktype string, linkprim string",
    )
    q = Query(spark)._with(x, id="gvkey")
    assert q.add_date_to_fa_ff().fields == ["date", "og_cstat_date", "gvkey", "v"]
    day = lambda y: dt.date(y, 6, 30)
    got = q.add_date_to_fa_ff(link).df
    assert got.columns == ["date", "og_cstat_date", "gvkey", "v", "permno"]
    assert rows(got) == sorted([(day(2021), dt.date(2020, 12, 31), "g", 5.0, 1), (day(2022), dt.date(2021, 3, 1), "h", 6.0, None)], key=str)
    assert {r["permno"] for r in q.add_date_to_fa_ff(link, only_keep_primary=False).df.collect()} == {1, 3, None}


def test_reports_survive_the_next_report_until_cleared(spark):
    f, r = small(spark)
    n = Ntile(type("P", (), {"freq": "D", "returns": r}))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        first = n.ntile_inspection_tear(f, 2)["inspection"]["count"]
        n.ntile_turnover_tear(f, 2, 1)
    assert first.count() == 3 and n._held.paths
    n.clear()
    assert not n._held.paths


def test_simple_returns_against_a_dense_grid(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(12):
        for k in sorted(rng.choice(30, int(rng.integers(1, 25)), replace=False).tolist()):
            u = rng.random()
            data.append((D(k), i, None if u < 0.1 else float("nan") if u < 0.15 else float("inf") if u < 0.2 else 0.0 if u < 0.22 else float(rng.lognormal(0, 0.6))))
    data += [(D(3), 99, None), (None, 1, 1.0), (D(50), None, 1.0)]
    days = sorted({d for d, i, _ in data if d is not None and i is not None})
    want = {}
    for i in {i for d, i, _ in data if d is not None and i is not None}:
        mine, last, before = {d: p for d, j, p in data if j == i}, None, None
        for n, d in enumerate(days):
            p = mine.get(d)
            before, last = last, p if p is not None and np.isfinite(p) else last
            if n:
                r = last / before - 1 if last is not None and before else 0.0
                want[d, i] = (min(1.5, max(-0.75, r)), n + 1)
    got = simple_returns(spark.createDataFrame(data, "date date, id int, price double"))
    rows_ = got.collect()
    assert len(rows_) == len(want)
    wrong = [(r, want.get((r["date"], r["id"]))) for r in rows_ if (pytest.approx(r["ret"]), r["pos"]) != want.get((r["date"], r["id"]))]
    assert not wrong, (len(wrong), wrong[:4])
    assert simple_returns(spark.createDataFrame([], "date date, id int, price double")).count() == 0


def test_monthly_portal_takes_the_last_price_of_a_month(spark):
    t = spark.createDataFrame([(dt.date(2010, m, k), 1, 10.0 * m + k, 1.0) for m in (1, 2, 3) for k in (4, 20, 11)], "date date, permno int, prc double, cfacpr double")
    p = PricingPortal(Query(spark, {"crsp.sd": t}), "*", "permno", "2010-01-01", "2010-12-31", freq="M", calendar=None)
    assert rows(p.prices) == sorted([(dt.date(2010, m, 1), 1, 10.0 * m + 20) for m in (1, 2, 3)], key=str)
    assert [r["ret"] for r in p.returns.orderBy("date").collect()] == pytest.approx([40 / 30 - 1, 50 / 40 - 1])
