"""Long panels (date, id, value): validation, date positions and dense grids without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.numeric import finite, is_finite


def positions(dates: DataFrame, date: str = "date") -> DataFrame:
    """(date, pos): the distinct dates numbered from 1. Numbers the date table, never the fact rows."""
    return dates.where(F.col(date).isNotNull()).select(F.col(date)).distinct().withColumn("pos", F.row_number().over(W.orderBy(date)))


def date_array(dates: DataFrame, date: str = "date") -> Column:
    """All distinct dates as one sorted array, as a scalar subquery; bounded by the days of the panel."""
    return dates.agg(F.array_sort(F.collect_set(date))).scalar()


def dense_grid(ids: DataFrame, dates: DataFrame, id: str = "id", date: str = "date") -> DataFrame:
    """(id, date, pos) for every id and date: each id row is exploded over the date array. No join."""
    every = ids.where(F.col(id).isNotNull()).select(id).distinct()
    return every.select(id, F.posexplode(date_array(dates, date)).alias("_p", date)).select(id, date, (F.col("_p") + 1).alias("pos"))


def check_columns(needed: list[str], df: DataFrame) -> DataFrame:
    """df cut to the needed columns; the first one missing is named in the error."""
    for c in needed:
        if c not in df.columns:
            raise ValueError(f'Required column "{c}" is not present')
    return df.select(*needed)


def finite_filter(df: DataFrame, max_loss: float, columns: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Rows whose numeric cells are all finite, and the counts; an error if more than max_loss is lost.

    The share is bad cells over rows, as each bad cell costs its row at most. One aggregate job.
    """
    cols = columns or [c for c, k in df.dtypes if k in ("double", "float")]
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    inf = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) == F.lit(float("inf")))
    r = df.agg(F.count("*").alias("rows"), *[F.count_if(bad(c)).alias(f"n_{i}") for i, c in enumerate(cols)], *[F.count_if(inf(c)).alias(f"i_{i}") for i, c in enumerate(cols)]).first()
    nan, infs, rows = sum(r[f"n_{i}"] for i in range(len(cols))), sum(r[f"i_{i}"] for i in range(len(cols))), r["rows"]
    share = (nan + infs) / rows if rows else 0.0
    if share > max_loss:
        raise ValueError(f"Max loss exceeded: {share:.3f} of the rows are nan or inf, {max_loss} are allowed")
    keep = df
    for c in cols:
        keep = keep.where(is_finite(c))
    return keep, {"rows": rows, "nan": nan, "inf": infs, "share": share}


def handle_duplicates(df: DataFrame, out_type: str, name: str, drop: bool = False, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Count rows whose key repeats; warn or raise; optionally keep the first by `order` (the key's other columns by default).

    out_type 'Warning' or 'ValueError'. The share is repeated rows over all rows.
    """
    import warnings

    keys = subset or df.columns
    r = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).first()
    repeated = r["rows"] - r["keys"]
    if repeated:
        text = f"The column {name} is {round(repeated / r['rows'], 3)} duplicates, {repeated} rows\n"
        if out_type == "ValueError":
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    if not drop:
        return df
    by = order or [c for c in df.columns if c not in keys] or keys
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")


def clean_panel(df: DataFrame, value: str, date: str = "date", id: str = "id", name: str | None = None) -> DataFrame:
    """(date, id, value) with NaN and infinities as null; rows with a null date or id dropped."""
    return df.where(F.col(date).isNotNull() & F.col(id).isNotNull()).select(
        F.col(date).cast("date").alias("date"), F.col(id).alias("id"), finite(F.col(value).cast("double")).alias(name or value)
    )


def factor_facts(factor: DataFrame, returns: DataFrame) -> dict[str, int]:
    """Figures of a factor panel against returns: rows, most rows of a (date, id), periods, ids without returns, periods with returns,
    and per frequency the periods that are the first day of one. Aggregates over all rows; dates and ids are compared as sets."""
    from panelmill.functions.dates import to_period

    key = factor.groupBy("date", "id").agg(F.count("*").alias("n"))
    top = key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    dates = factor.select("date").distinct()
    starts = dates.agg(F.count("date").alias("periods"), *[F.count_if(to_period("date", f) == F.col("date")).alias(f"starts_{f}") for f in "WMQA"]).first()
    ids = returns.select("id").distinct()
    unpriced = factor.select("id").distinct().join(ids, "id", "left_anti").count()
    common = dates.join(returns.select("date").distinct(), "date", "left_semi").count()
    return {"rows": top["rows"], "most_rows_of_a_key": top["most"], **starts.asDict(), "ids_without_returns": unpriced, "periods_with_returns": common}


def check_factor(factor: DataFrame, returns: DataFrame, least_periods: int = 100, freq: str | None = None) -> list[str]:
    """Validate a factor panel against returns; raises on errors, returns the warnings.

    freq: the frequency of the returns (D, W, M, Q, A or Y). Periods are held by their first day, so a factor of another frequency
    shows: one with days that begin no such period is finer; one with three dates or more that all begin a longer
    period is coarser.
    """
    for c in ("date", "id", "factor"):
        if c not in factor.columns:
            raise ValueError(f'Required column "{c}" is not present')
    x = factor_facts(factor, returns)
    if not x["rows"]:
        raise ValueError("The factor is empty")
    if x["most_rows_of_a_key"] > 1:
        raise ValueError("The factor has duplicate (date, id) rows")
    if x["periods_with_returns"] == 0:
        raise ValueError("Factor and returns have no date in common")
    if freq:
        own = {"Y": "A"}.get(freq[0], freq[0])
        finer = own in "WMQA" and x[f"starts_{own}"] < x["periods"]
        longer = {"D": "WMQA", "B": "WMQA", "M": "QA", "Q": "A"}.get(own, "")
        coarser = x["periods"] > 2 and any(x[f"starts_{f}"] == x["periods"] for f in longer)
        if finer or coarser:
            raise ValueError(f"Factor and returns are not of the same frequency ({freq})")
    out = [f"{x['ids_without_returns']} ids of the factor have no returns"] if x["ids_without_returns"] else []
    return out + ([f"The factor has {x['periods']} periods, less than {least_periods}"] if x["periods"] < least_periods else [])


def price_pivot(df: DataFrame, value: str, ids: list, id: str = "symbol", date_format: str = "") -> DataFrame:
    """One row per date and one column per id with the mean of the values (copies of a key are averaged).

    The ids are given, so the pivot needs no extra pass to find them. String dates need date_format (strptime).
    """
    check_columns(["date", id, value], df)
    return _dated(df, date_format).groupBy("date").pivot(id, ids).agg(F.avg(F.nanvl(F.col(value).cast("double"), F.lit(None))))


def clean_factor(df: DataFrame, value: str, id: str = "symbol", max_loss: float = 0.1, date_format: str = "") -> DataFrame:
    """(date, id, value): one row per key (the least value of copies), then only finite values; an error if more
    than max_loss of the rows is lost."""
    x = _dated(check_columns(["date", id, value], df), date_format)
    x = handle_duplicates(x, "Warning", value, drop=True, subset=["date", id], order=[value])
    return finite_filter(x.withColumn(value, F.col(value).cast("double")), max_loss, [value])[0]


def _dated(df: DataFrame, date_format: str) -> DataFrame:
    from panelmill.functions.dates import strptime_pattern

    if dict(df.dtypes)["date"] == "string":
        if not date_format:
            raise ValueError("date_format must be given for date columns of type string")
        return df.withColumn("date", F.to_date("date", strptime_pattern(date_format)))
    return df.withColumn("date", F.col("date").cast("date"))
