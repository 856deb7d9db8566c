"""Queries of the general problems over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.numeric import is_finite
from panelmill.operators.asof import as_known_at, change_histories
from panelmill.operators.impute import fill_by_matching
from panelmill.operators.regular import to_grid
from panelmill.operators.rolling import trailing_totals
from panelmill.operators.spikes import flag_readings
from panelmill.operators.standing import standing_rows, standing_sql
from panelmill.session import read

CSTAT_FIELDS = ["prccd", "ajexdi", "cshoc"]
SPIKE_FIELDS = {
    "prc": {"signed": True, "ratio": 1000.0, "floor": 0.02, "run": 6},
    "cfacpr": {"signed": False, "ratio": 50.0, "floor": 0.1, "run": 0},
}


def _cstat(spark: SparkSession, d: str, fields: list[str]) -> DataFrame:
    return standing_rows(read(spark, d, "cstat_sd"), ["gvkey", "iid", "date"], fields)


def _id() -> Column:
    return F.concat("gvkey", F.lit("_"), "iid").alias("id")


def _day() -> Column:
    return F.date_format("date", "yyyy-MM-dd").alias("date")


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """All cells of the standing rows with the filled value, the marks and the donor."""
    out = fill_by_matching(_cstat(spark, d, CSTAT_FIELDS), "gvkey", "iid", "date", CSTAT_FIELDS)
    return out.select(
        _id(), _day(), "field", "delivered", "value", "filled", "unusable",
        F.concat("donor_company", F.lit("_"), "donor_issue").alias("donor_id"),
        F.date_format("donor_date", "yyyy-MM-dd").alias("donor_date"), "donor_level",
    )


def p1_fill(spark: SparkSession, d: str) -> DataFrame:
    return p1_cells(spark, d).drop("unusable")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells without a usable value, filled or, where the field has no usable value at all, not."""
    return p1_cells(spark, d).where("unusable").select("id", "date", "field")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = standing_rows(read(spark, d, "crsp_sd"), ["permno", "date"], list(SPIKE_FIELDS))
    return flag_readings(rows, "permno", "date", SPIKE_FIELDS).select("permno", _day(), "field", "reason", "value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flags(spark, d).select("permno", "date", "field").distinct()


def _prices_on_grid(spark: SparkSession, d: str) -> DataFrame:
    usable = is_finite("prccd") & (F.col("prccd") > 0)
    return to_grid(_cstat(spark, d, ["prccd"]), ["gvkey", "iid"], "date", "prccd", usable, read(spark, d, "trading_cal"), "trading_days")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """One prccd row for every trading day of every security's span. A price is a level: its increments carry their sign."""
    g = _prices_on_grid(spark, d)
    return g.select(_id(), _day(), F.col("level").alias("prccd"), "increment", "status", "filled", "uncovered")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The days without a row: cells that got their share of the increments around them, or that came out marked as uncovered."""
    g = p3_grid(spark, d).where(F.when(F.col("status") == "missing", F.col("filled") | F.col("uncovered")))
    return g.select("id", "date")


def p3_counter(spark: SparkSession, d: str) -> DataFrame:
    """A cumulative counter on the same grid: the volume since the beginning of the month of each crsp_sd security.

    It is built from the delivered volumes, falls back at the turn of a month and has gaps where days are missing; out come
    total and increment for every trading day, gaps filled in proportion.
    """
    rows = standing_rows(read(spark, d, "crsp_sd"), ["permno", "date"], ["vol"])
    use = is_finite("vol") & (F.col("vol") >= 0)
    month = W.partitionBy("permno", F.trunc("date", "month")).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("permno", "date", F.when(use, F.sum(F.when(use, F.col("vol"))).over(month)).alias("so_far"))
    g = to_grid(rows, ["permno"], "date", "so_far", F.col("so_far").isNotNull(), read(spark, d, "trading_cal"), "trading_days", counter=True)
    return g.select("permno", _day(), F.col("level").alias("total"), F.col("increment").alias("vol"), "status", "reset", "filled", "uncovered")


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = standing_rows(read(spark, d, "crsp_sd"), ["permno", "date"], ["prc", "shrout"])
    ok = is_finite("prc") & is_finite("shrout")
    daily = rows.select("permno", "date", F.when(ok, F.abs("prc") * F.col("shrout")).alias("mv"))
    return trailing_totals(daily, "permno", "date", "mv", (7, 30))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    return p4_totals(spark, d).select(
        "permno", _day(),
        *[F.round(f"total_{n}d", 4).alias(f"total_{n}d") for n in (7, 30)],
        *[F.round(F.round(f"total_{n}d", 4) / F.lit(float(n)), 6).alias(f"avg_{n}d") for n in (7, 30)],
        "days_7d", "days_30d",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_totals(spark, d).where(F.col("total_7d") < 0.1 * F.col("total_30d")).select("permno", _day())


LINK_ATTRIBUTES = ["gvkey", "liid", "linkprim", "gsector"]


def _links(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("linktype").isin("LU", "LC") & F.col("lpermno").isNotNull() & F.col("gvkey").isNotNull() & F.col("linkdt").isNotNull()
    return read(spark, d, "crsp_cstat_link").where(ok & (F.col("linkenddt").isNull() | (F.col("linkenddt") >= F.col("linkdt"))))


def _known(spark: SparkSession, d: str, attributes: list[str]) -> DataFrame:
    links = _links(spark, d)
    h = change_histories(links, "lpermno", "linkdt", "linkenddt", attributes, tie="gvkey")
    events = read(spark, d, "crsp_sd").select("permno", "date")
    return as_known_at(events, "permno", "date", h.withColumnRenamed("lpermno", "permno"), attributes, {a: links.schema[a].dataType for a in attributes})


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d, LINK_ATTRIBUTES).select("permno", _day(), *LINK_ATTRIBUTES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    latest = _links(spark, d).groupBy(F.col("lpermno").alias("permno")).agg(
        F.min_by("gvkey", F.struct(-F.unix_date("linkdt"), F.col("gvkey"))).alias("_latest")
    )
    known = _known(spark, d, ["gvkey"]).where(F.col("gvkey").isNotNull()).join(latest, "permno")
    return known.where(F.col("gvkey") != F.col("_latest")).select("permno", _day(), "gvkey")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_fill, p2_found, p2_flags, p3_found, p3_grid, p3_counter, p4_found, p4_rolling, p5_found, p5_attributes)}


_CSTAT = standing_sql("cstat_sd", "gvkey, iid, date", ["prccd"], "st")
_CRSP = standing_sql("crsp_sd", "permno, date", ["prc", "shrout"], "st")


def _grid_sql(table: str, keys: list[str], value: str, counter: bool) -> str:
    """CTEs up to `lv`: keys, day, level, own row and reset on every trading day between first and last row, from (keys, date, value null if not usable)."""
    k = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    of = lambda a: ", ".join(f"{a}.{c}" for c in keys)
    steps = f"sum(CASE WHEN before IS NULL OR v < before THEN v ELSE v - before END) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""us AS (SELECT {k}, date, {value} AS v, lag({value}) OVER (PARTITION BY {k} ORDER BY date) AS before FROM {table} WHERE {value} IS NOT NULL),
 pt AS (SELECT {k}, date, {steps if counter else "v"} AS l, {"coalesce(v < before, false)" if counter else "false"} AS reset FROM us),
 sp AS (SELECT {k}, min(date) AS lo, max(date) AS hi FROM {table} GROUP BY {k}),
 gd AS (SELECT {of("sp")}, c.trading_days AS d FROM sp JOIN trading_cal c ON c.trading_days BETWEEN sp.lo AND sp.hi),
 ga AS (SELECT gd.*, a.date AS ad, a.l AS al, a.reset AS ar FROM gd ASOF LEFT JOIN pt a ON {same("a", "gd")} AND a.date <= gd.d),
 gb AS (SELECT ga.*, b.date AS bd, b.l AS bl FROM ga ASOF LEFT JOIN pt b ON {same("b", "ga")} AND b.date >= ga.d),
 lv AS (SELECT {of("gb")}, gb.d, CASE WHEN ad = d THEN al WHEN ad IS NOT NULL AND bd IS NOT NULL THEN al + (bl - al) * (CAST(d - ad AS DOUBLE) / (bd - ad)) END AS level,
  CASE WHEN ad = d THEN 'delivered' WHEN o.date IS NOT NULL THEN 'unusable' ELSE 'missing' END AS status, coalesce(ad = d AND ar, false) AS reset
  FROM gb LEFT JOIN {table} o ON {same("o", "gb")} AND o.date = gb.d)"""


_GRID_MARKS = "status, level IS NOT NULL AND status <> 'delivered' AS filled, level IS NULL AS uncovered"
_ROLL = f"""WITH {_CRSP}, m AS (SELECT permno, date, CASE WHEN isfinite(prc) AND isfinite(shrout) THEN abs(prc) * shrout END AS mv FROM st),
 cal AS (SELECT permno, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS d FROM m GROUP BY permno),
 t AS (SELECT cal.permno, cal.d,
  coalesce(sum(CASE WHEN m.date > cal.d - 7 THEN mv END), 0) AS total_7d, coalesce(sum(mv), 0) AS total_30d,
  count(CASE WHEN m.date > cal.d - 7 THEN mv END) AS days_7d, count(mv) AS days_30d
  FROM cal LEFT JOIN m ON m.permno = cal.permno AND m.date BETWEEN cal.d - 29 AND cal.d GROUP BY 1, 2)"""
_LINK = """l AS (SELECT DISTINCT lpermno AS permno, gvkey, liid, linkprim, gsector, linkdt, coalesce(linkenddt, DATE '9999-12-30') AS e FROM crsp_cstat_link
 WHERE linktype IN ('LU', 'LC') AND lpermno IS NOT NULL AND gvkey IS NOT NULL AND linkdt IS NOT NULL AND coalesce(linkenddt, DATE '9999-12-30') >= linkdt),
 ev AS (SELECT DISTINCT permno, date FROM crsp_sd WHERE permno IS NOT NULL AND date IS NOT NULL),
 hit AS (SELECT ev.permno, ev.date, l.gvkey, l.liid, l.linkprim, l.gsector, row_number() OVER (PARTITION BY ev.permno, ev.date
  ORDER BY l.linkdt DESC NULLS LAST, l.gvkey, l.gvkey, l.liid NULLS LAST, l.linkprim NULLS LAST, CAST(l.gsector AS VARCHAR) NULLS LAST) AS rn
  FROM ev LEFT JOIN l ON l.permno = ev.permno AND ev.date BETWEEN l.linkdt AND l.e)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH {_CSTAT}, s AS (SELECT gvkey, iid, min(date) AS lo, max(date) AS hi FROM st GROUP BY 1, 2)
 SELECT s.gvkey || '_' || s.iid AS id, strftime(c.trading_days, '%Y-%m-%d') AS date
 FROM s JOIN trading_cal c ON c.trading_days BETWEEN s.lo AND s.hi
 LEFT JOIN st ON st.gvkey = s.gvkey AND st.iid = s.iid AND st.date = c.trading_days WHERE st.date IS NULL""",
        "p3_grid": f"""WITH {_CSTAT}, rd AS (SELECT gvkey, iid, date, CASE WHEN isfinite(prccd) AND prccd > 0 THEN prccd END AS v0 FROM st), {_grid_sql("rd", ["gvkey", "iid"], "v0", False)}
 SELECT gvkey || '_' || iid AS id, strftime(d, '%Y-%m-%d') AS date, level AS prccd, level - lag(level) OVER (PARTITION BY gvkey, iid ORDER BY d) AS increment, {_GRID_MARKS} FROM lv""",
        "p3_counter": f"""WITH {standing_sql("crsp_sd", "permno, date", ["vol"], "st")}, rd AS (SELECT permno, date, CASE WHEN ok THEN sum(CASE WHEN ok THEN vol END) OVER (PARTITION BY permno, date_trunc('month', date)
  ORDER BY date ROWS UNBOUNDED PRECEDING) END AS v0 FROM (SELECT permno, date, vol, isfinite(vol) AND vol >= 0 AS ok FROM st)), {_grid_sql("rd", ["permno"], "v0", True)}
 SELECT permno, strftime(d, '%Y-%m-%d') AS date, level AS total, level - lag(level) OVER (PARTITION BY permno ORDER BY d) AS vol, reset, {_GRID_MARKS} FROM lv""",
        "p4_found": f"{_ROLL} SELECT permno, strftime(d, '%Y-%m-%d') AS date FROM t WHERE total_7d < 0.1 * total_30d",
        "p4_rolling": f"""{_ROLL} SELECT permno, strftime(d, '%Y-%m-%d') AS date, round(total_7d, 4) AS total_7d, round(round(total_7d, 4) / CAST(7 AS DOUBLE), 6) AS avg_7d,
 round(total_30d, 4) AS total_30d, round(round(total_30d, 4) / CAST(30 AS DOUBLE), 6) AS avg_30d, days_7d, days_30d FROM t""",
        "p5_found": f"""WITH {_LINK}, latest AS (SELECT permno, gvkey, row_number() OVER (PARTITION BY permno ORDER BY linkdt DESC, gvkey) AS rn FROM l)
 SELECT hit.permno, strftime(hit.date, '%Y-%m-%d') AS date, hit.gvkey FROM hit JOIN latest ON latest.permno = hit.permno AND latest.rn = 1
 WHERE hit.rn = 1 AND hit.gvkey IS NOT NULL AND hit.gvkey <> latest.gvkey""",
        "p5_attributes": f"""WITH {_LINK} SELECT permno, strftime(date, '%Y-%m-%d') AS date, gvkey, liid, linkprim, gsector FROM hit WHERE rn = 1""",
    }
