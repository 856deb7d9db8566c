"""Operators of the general problems on small frames: defined results for nulls, ties, copies, empty input, clashing names."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators.asof import as_known_at, change_histories
from panelmill.operators.impute import fill_by_matching, stand_ins, with_lone_readings
from panelmill.operators.regular import grid_positions, to_grid
from panelmill.operators.rolling import trailing_totals
from panelmill.operators.spikes import flag_readings, robust_components
from panelmill.operators.standing import standing_rows
from panelmill.plans.problems import SPIKE_FIELDS
from panelmill.session import written

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- standing rows


def test_standing_rows_latest_copies_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, D(0), 1.0, T(0)), (1, D(0), 2.0, T(5)), (1, D(0), 2.0, T(5)), (2, D(0), None, T(9)), (2, D(0), 7.0, T(1)), (None, D(0), 1.0, T(0)), (3, D(1), 4.0, None)],
        "k int, date date, v double, loaded_at timestamp_ntz",
    )
    assert rows(standing_rows(df, ["k", "date"], ["v"]).select("k", "v").fillna(-1)) == [(1, 2.0), (2, -1.0), (3, 4.0)]
    assert standing_rows(df.limit(0), ["k", "date"], ["v"]).count() == 0


def test_standing_rows_take_one_whole_row_of_a_tie(spark):
    data = [(1, D(0), 5.0, 11, T(3)), (1, D(0), 5.0, None, T(3)), (1, D(0), None, 99, T(3)), (1, D(0), 9.0, 1, T(2)), (2, D(0), 1.0, 7, T(0)), (2, D(0), float("nan"), 3, T(0))]
    data += [(k, D(0), float(v), 100 - v, T(1)) for k in range(3, 40) for v in range(5)]
    want = None
    for seed in range(10):
        rng = np.random.default_rng(seed)
        df = spark.createDataFrame([data[i] for i in rng.permutation(len(data))], "k int, date date, v double, code int, loaded_at timestamp_ntz").repartition(5)
        got = sorted((r["k"], str(r["v"]), r["code"]) for r in standing_rows(df, ["k", "date"], ["v", "code"]).collect())
        want = want or got
        assert got == want
    assert got[:1] == [(1, "5.0", 11)] and (2, "nan", 3) in got and (7, "4.0", 96) in got


# ---- trailing totals


def brute_totals(data, n):
    out = {}
    for k in {r[0] for r in data}:
        mine = {r[1]: r[2] for r in data if r[0] == k}
        for i in range((max(mine) - min(mine)).days + 1):
            day = min(mine) + dt.timedelta(i)
            vals = [v for d, v in mine.items() if day - dt.timedelta(n - 1) <= d <= day and v is not None and np.isfinite(v)]
            out[k, day] = sum(vals), len(vals)
    return out


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = []
    for k in (1, 2, 3):
        for i in sorted(rng.choice(120, 40, replace=False).tolist()):
            v = float(rng.integers(1, 100))
            data.append((k, D(i), None if v < 10 else float("nan") if v < 15 else float("inf") if v < 18 else v))
    df = spark.createDataFrame(data, "k int, date date, v double").withColumn("_d", F.lit("clash"))
    got = {(r["k"], r["date"]): r for r in trailing_totals(df, "k", "date", "v", (7, 30)).collect()}
    for n in (7, 30):
        want = brute_totals(data, n)
        assert set(want) == set(got)
        for key, (total, count) in want.items():
            assert got[key][f"total_{n}d"] == pytest.approx(total) and got[key][f"days_{n}d"] == count and got[key][f"avg_{n}d"] == pytest.approx(total / n)


@pytest.mark.parametrize("bucket", [1, 7, 15, 40])
def test_trailing_totals_do_not_depend_on_the_bucket(spark, bucket):
    df = spark.createDataFrame([(1, D(i * i % 90), float(i)) for i in range(9)], "k int, date date, v double").groupBy("k", "date").agg(F.sum("v").alias("v"))
    want = rows(trailing_totals(df, "k", "date", "v"))
    assert rows(trailing_totals(df, "k", "date", "v", bucket_days=bucket)) == want


def test_trailing_totals_empty_and_null_keys(spark):
    df = spark.createDataFrame([(None, D(0), 1.0), (1, None, 1.0)], "k int, date date, v double")
    assert trailing_totals(df, "k", "date", "v").count() == 0


# ---- attributes as known at event time


LINK = "p int, a date, z date, g string, h string"


def brute_known(links, p, day):
    ok = [x for x in links if x[0] == p and x[1] is not None and x[3] is not None and x[1] <= day and (x[2] is None or day <= x[2])]
    ok = [x for x in ok if x[2] is None or x[2] >= x[1]]
    if not ok:
        return None, None
    ok.sort(key=lambda x: (-(x[1] - dt.date(1970, 1, 1)).days, x[3], x[4] is None, x[4] or ""))
    return ok[0][3], ok[0][4]


def test_known_at_event_time_against_brute_force(spark):
    rng = np.random.default_rng(5)
    links = []
    for p in range(1, 8):
        for _ in range(int(rng.integers(0, 9))):
            a = int(rng.integers(0, 60))
            z = None if rng.random() < 0.2 else D(a + int(rng.integers(-3, 40)))
            links.append((p, D(a), z, f"g{rng.integers(0, 4)}", None if rng.random() < 0.3 else f"h{rng.integers(0, 3)}"))
    links += links[:3] + [(None, D(0), None, "g", "h"), (1, None, None, "g", "h"), (1, D(0), None, None, "h")]
    events = [(p, D(i)) for p in range(1, 10) for i in range(0, 100, 3)]
    e = spark.createDataFrame([*events, *events[:5], (None, D(0)), (1, None)], "p int, date date").withColumn("g", F.lit("clash"))
    h = change_histories(spark.createDataFrame(links, LINK), "p", "a", "z", ["g", "h"], "g")
    got = {(r["p"], r["date"]): (r["g"], r["h"]) for r in as_known_at(e, "p", "date", h, ["g", "h"]).collect()}
    assert got == {x: brute_known(links, *x) for x in events}


def test_histories_are_independent_per_attribute(spark):
    links = [(1, D(0), D(9), "g1", "h1"), (1, D(10), D(19), "g1", "h2"), (1, D(20), None, "g2", "h2")]
    h = change_histories(spark.createDataFrame(links, LINK), "p", "a", "z", ["g", "h"], "g")
    days = {a: sorted(r["since"] for r in h.where(F.col("attribute") == a).where("value is not null").collect()) for a in ("g", "h")}
    at = [(D(n) - dt.date(1970, 1, 1)).days for n in (0, 10, 20)]
    assert days == {"g": [at[0], at[2]], "h": [at[0], at[1]]}


def test_known_at_with_empty_sides(spark):
    none = spark.createDataFrame([], LINK)
    h = change_histories(none, "p", "a", "z", ["g"], "g")
    e = spark.createDataFrame([(1, D(0))], "p int, date date")
    assert rows(as_known_at(e, "p", "date", h, ["g"])) == [(1, D(0), None)]
    assert as_known_at(e.limit(0), "p", "date", h, ["g"]).count() == 0


# ---- regular grid


def cal(spark, days):
    return spark.createDataFrame([(D(i),) for i in days], "day date")


def test_grid_positions_skip_nulls_and_copies(spark):
    c = spark.createDataFrame([(D(0),), (D(3),), (D(3),), (None,)], "day date")
    base = (D(0) - dt.date(1970, 1, 1)).days
    assert rows(grid_positions(c, "day")) == [(base, 1, True), (base + 1, 1, False), (base + 2, 1, False), (base + 3, 2, True)]


def test_grid_marks_missing_and_distributes_increments(spark):
    # grid days 0 1 2 5 6 7; readings on 0, on 3 (off the grid) and on 7; the value on 6 can't be used
    df = spark.createDataFrame([("a", D(0), 10.0), ("a", D(3), 16.0), ("a", D(6), None), ("a", D(7), 20.0)], "s string, date date, v double").withColumn("level", F.lit("clash"))
    got = to_grid(df, ["s"], "date", "v", F.col("v").isNotNull(), cal(spark, [0, 1, 2, 5, 6, 7]), "day").orderBy("date").collect()
    assert [(r["date"], r["status"], r["filled"]) for r in got] == [
        (D(0), "delivered", False), (D(1), "missing", True), (D(2), "missing", True), (D(5), "missing", True), (D(6), "unusable", True), (D(7), "delivered", False),
    ]
    assert [r["level"] for r in got] == pytest.approx([10, 12, 14, 18, 19, 20])
    assert [r["increment"] for r in got][1:] == pytest.approx([2, 2, 4, 1, 1])


def test_grid_counter_resets_and_total_is_kept(spark):
    df = spark.createDataFrame([(1, D(0), 100.0), (1, D(2), 130.0), (1, D(4), 10.0), (1, D(6), 14.0)], "s int, date date, v double")
    got = to_grid(df, ["s"], "date", "v", F.col("v").isNotNull(), cal(spark, range(10)), "day", counter=True).orderBy("date").collect()
    assert [r["level"] for r in got] == pytest.approx([100, 115, 130, 135, 140, 142, 144])
    assert [r["reset"] for r in got] == [False, False, False, False, True, False, False]
    assert sum(r["increment"] for r in got[1:]) == pytest.approx(44)


def test_grid_uncovered_single_and_empty(spark):
    df = spark.createDataFrame([("a", D(0), None), ("a", D(2), 5.0), ("a", D(4), None), ("b", D(3), 1.0), (None, D(1), 1.0), ("c", None, 1.0)], "s string, date date, v double")
    args = (["s"], "date", "v", F.col("v").isNotNull(), cal(spark, range(6)), "day")
    got = to_grid(df, *args).orderBy("s", "date").collect()
    assert [(r["s"], r["level"], r["filled"]) for r in got] == [("a", None, False), ("a", None, False), ("a", 5.0, False), ("a", None, False), ("a", None, False), ("b", 1.0, False)]
    assert to_grid(df.limit(0), *args).count() == 0


# ---- spikes


def flags(spark, series, fields=SPIKE_FIELDS):
    data = [(k, D(i), *v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "permno int, date date, prc double, cfacpr double").withColumn("value", F.lit("clash"))
    return {(r["permno"], (r["date"] - D(0)).days, r["field"]): r["reason"] for r in flag_readings(df, "permno", "date", fields).collect()}


def walk(n, seed, scale=0.01, level=50.0):
    return (level * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, scale, n)))).tolist()


def test_spikes_runs_ranges_and_what_is_none(spark):
    a = walk(120, 1)
    b = [x if i < 60 else x / 2 for i, x in enumerate(walk(120, 2))]  # a lasting split
    a[20] *= 2
    a[50:53] = [x * 1.5 for x in a[50:53]]
    a[70] = -a[70]  # a sign is no case
    a[80] = 0.0
    a[81] = float("inf")
    a[90:97] = [a[90]] * 7
    a[100] = float("nan")
    fa = [1.0] * 120
    fa[30] = 2.0
    fa[40] = -1.0
    fb = [1.0] * 60 + [2.0] * 60
    fb[100] = None
    got = flags(spark, {1: list(zip(a, fa)), 2: list(zip(b, fb))})
    want = {(1, 20, "prc"): "spike", (1, 80, "prc"): "impossible", (1, 81, "prc"): "impossible", (1, 30, "cfacpr"): "spike", (1, 40, "cfacpr"): "impossible"}
    want |= {(1, i, "prc"): "spike" for i in (50, 51, 52)} | {(1, i, "prc"): "stuck" for i in range(91, 97)}
    assert got == want


def test_spike_batches_split_sources_anywhere(spark):
    series = {}
    for k in range(300):
        a = walk(60, k, level=5.0 + k)
        a[k % 50 + 5] *= 3
        series[k] = [(x, 1.0) for x in a]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    try:
        got = flags(spark, series)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, k % 50 + 5, "prc"): "spike" for k in range(300)}


def test_spikes_short_empty_and_missing_sources(spark):
    assert flags(spark, {1: [(None, None)] * 5, 2: [(1.0, 1.0)], 3: [(float("nan"), 0.0), (2.0, 1.0)]}) == {(3, 0, "cfacpr"): "impossible"}
    df = spark.createDataFrame([], "permno int, date date, prc double, cfacpr double")
    assert flag_readings(df, "permno", "date", SPIKE_FIELDS).count() == 0


def test_robust_components_find_a_lone_spike_in_a_flat_matrix():
    x = np.zeros((2, 5, 10))
    x[1] += np.arange(5)[:, None] * 0.3
    x[:, 2, 3] += 1.0
    sparse = robust_components(x, np.ones(x.shape, bool), 0.05)
    assert sparse[:, 2, 3].all() and sparse.sum() == 2


# ---- filling by matching


FIELDS = ["prccd", "ajexdi"]


def cstat(spark, data):
    return spark.createDataFrame(data, "gvkey string, iid string, date date, prccd double, ajexdi double").withColumn("value", F.lit("clash"))


def filled(df):
    return {(r["gvkey"], r["iid"], (r["date"] - D(0)).days, r["field"]): r for r in fill_by_matching(df, "gvkey", "iid", "date", FIELDS).collect()}


def test_fill_from_security_company_and_day(spark):
    data = []
    for i in range(10):
        data.append(("c1", "01", D(i), None if i == 4 else 100.0 + i, 2.0 if i != 6 else -1.0))
        data.append(("c1", "02", D(i), float("nan"), 3.0))
        data.append(("c2", "01", D(i), 7.0 + 0.01 * i, float("nan")))
    got = filled(cstat(spark, data))
    assert len(got) == 60
    r = got["c1", "01", 4, "prccd"]
    assert r["filled"] and r["donor_level"] == "security" and r["value"] in (103.0, 105.0) and r["donor_company"] == "c1" and r["donor_date"] in (D(3), D(5))
    assert got["c1", "01", 6, "ajexdi"]["value"] == 2.0 and got["c1", "01", 6, "ajexdi"]["delivered"] == -1.0
    r = got["c1", "02", 3, "prccd"]
    assert r["donor_level"] == "company" and r["value"] == 103.0 and r["donor_issue"] == "01"
    r = got["c1", "02", 4, "prccd"]
    assert r["donor_level"] == "company" and r["value"] in (103.0, 105.0)
    r = got["c2", "01", 5, "ajexdi"]
    assert r["donor_level"] == "day" and r["value"] in (2.0, 3.0) and r["donor_date"] == D(5)
    assert not got["c2", "01", 5, "prccd"]["filled"] and all(r["value"] is not None for r in got.values())


def test_fill_copies_observed_values_only(spark):
    rng = np.random.default_rng(2)
    data = [(f"c{k}", "01", D(i), None if rng.random() < 0.3 else float(rng.integers(10, 90)) / 7, 1.0) for k in range(5) for i in range(30)]
    got = filled(cstat(spark, data))
    seen = {(r[0], r[2], r[3]) for r in data if r[3] is not None}
    for r in got.values():
        if r["filled"]:
            assert (r["donor_company"], r["donor_date"], r["value"]) in seen
        else:
            assert r["donor_company"] is None and r["value"] == r["delivered"]


def test_stand_ins_need_votes(spark):
    data = []
    for k in range(4):
        for i in range(20):
            v = 20.0 + k + i / 10
            if i == 7 + k:
                v = 9999.99
            data.append((f"s{k}", "1", D(i), "prccd", v))
            data.append((f"s{k}", "1", D(i), "ajexdi", 1.0 if i < 10 else 12.0))  # a lasting change of level
    data.append(("s9", "1", D(0), "prccd", 5.0))
    cells = spark.createDataFrame(data, "gvkey string, iid string, date date, field string, value double")
    lone = written(with_lone_readings(cells, ["gvkey", "iid"], "date"), "test")
    assert rows(stand_ins(lone, ["gvkey", "iid"])) == [("prccd", 9999.99)]


def test_fill_nothing_usable_and_empty(spark):
    got = filled(cstat(spark, [("c", "1", D(0), None, None), (None, "1", D(0), 1.0, 1.0)]))
    assert len(got) == 2 and all(r["value"] is None and not r["filled"] and r["unusable"] for r in got.values())
    assert filled(cstat(spark, [("c", "1", D(0), None, None)]).limit(0)) == {}
