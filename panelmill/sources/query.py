"""A fluent, immutable query builder over DataFrames: every call returns a new lazy query."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.dates import to_period, trading_days
from panelmill.operators.panel import dense_grid

#: Price and share adjustment per table (fixed values): fields -> (adjustor, operation, absolute value).
ADJUSTMENTS: dict[str, dict[str, tuple[str, str, bool]]] = {
    "cstat.sd": dict.fromkeys(["prccd", "prcod", "prchd", "prcld", "eps"], ("ajexdi", "/", False)) | dict.fromkeys(["cshoc", "cshtrd"], ("ajexdi", "*", False)),
    "crsp.sd": dict.fromkeys(["prc", "openprc", "askhi", "bidlo", "bid", "ask"], ("cfacpr", "/", True)) | dict.fromkeys(["vol", "shrout"], ("cfacshr", "*", False)),
    "crsp.sm": dict.fromkeys(["prc", "altprc", "askhi", "bidlo", "bid", "ask"], ("cfacpr", "/", True)) | dict.fromkeys(["vol", "shrout"], ("cfacshr", "*", False)),
    "cstat.sm": dict.fromkeys(["prccm", "prchm", "prclm"], ("ajexm", "/", False)) | dict.fromkeys(["cshom", "cshtrm"], ("ajexm", "*", False)),
    "cstat.funda": {},
    "wrds.firm_ratios": {},
    "ibes.summary_price_target": {},
}
ADJUSTMENTS |= {"sd": ADJUSTMENTS["cstat.sd"], "main.sd": ADJUSTMENTS["cstat.sd"]}
#: Literal id lists up to this length become a predicate, longer ones a joined table.
MAX_IN_LIST = 1000


def adjusted(field: str, table: str):
    """The adjusted column of a field; fields without a rule stay as they are. Unknown tables are an error."""
    rules = ADJUSTMENTS.get(table.lower())
    if rules is None:
        raise ValueError(f"Table {table!r} has no adjustment rules")
    if field.lower() not in rules:
        return F.col(field)
    by, op, absolute = rules[field.lower()]
    out = F.try_divide(F.col(field), F.col(by)) if op == "/" else F.col(field) * F.col(by)
    return (F.abs(out) if absolute else out).alias(field)


@dataclass(frozen=True)
class Query:
    """A lazy query: a DataFrame plus its id column, dates and frequency.

    tables maps 'schema.table' to DataFrames; a name that is not in it is read from the catalog.
    """

    spark: SparkSession
    tables: dict | None = None
    universes: dict | None = None
    freq: str = "D"
    df: DataFrame | None = None
    id: str | None = None
    start: str | None = None
    end: str | None = None

    def _table(self, name: str) -> DataFrame:
        if self.tables and name in self.tables:
            return self.tables[name]
        return self.spark.table(name)

    def _with(self, df: DataFrame, **k) -> Query:
        return replace(self, df=df, **k)

    @property
    def fields(self) -> list[str]:
        return self.df.columns

    def explain(self) -> None:
        self.df.explain("formatted")

    # ---- scans -----------------------------------------------------------------------------------------------

    def _assets(self, df: DataFrame, assets, search_by: str, start: str | None, end: str | None) -> DataFrame:
        """df cut to the assets: '*' keeps all, a universe's name those ever in it in the range, else a list of ids."""
        if isinstance(assets, str):
            if assets == "*":
                return df
            u = (self.universes or {}).get(assets)
            if u is None:
                raise ValueError(f"Universe {assets!r} is not known")
            members = self._between(u, start, end).select(search_by).distinct()
            return df.join(members, search_by, "left_semi")
        if isinstance(assets, DataFrame):
            return df.join(assets.select(search_by).distinct(), search_by, "left_semi")
        ids = list(dict.fromkeys(assets)) if isinstance(assets, Iterable) else [assets]
        ids = [a for a in ids if a is not None]
        # either way an id is taken in the column's own type, so that the length of the list changes nothing but the plan
        kind = df.schema[search_by].dataType
        if len(ids) <= MAX_IN_LIST:
            return df.where(F.col(search_by).isin([F.lit(a).cast(kind) for a in ids])) if ids else df.where(F.lit(False))
        listed = self.spark.createDataFrame([(str(a),) for a in ids], "a string").select(F.col("a").cast(kind).alias(search_by))
        return df.join(listed, search_by, "left_semi")

    @staticmethod
    def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
        if start is not None:
            df = df.where(F.col("date") >= F.to_date(F.lit(_full_date(start))))
        if end is not None:
            df = df.where(F.col("date") <= F.to_date(F.lit(_full_date(end))))
        return df

    def query_timeseries_table(self, table: str, fields: list[str], assets, search_by: str, start_date: str = "1900", end_date: str = "3000", adjust: bool = True) -> Query:
        """date, id and fields of a table within the dates, prices and shares adjusted; filters reach the scan."""
        src = self._between(self._table(table), start_date, end_date)
        src = self._assets(src, assets, search_by, start_date, end_date)
        cols = list(dict.fromkeys(["date", search_by, *fields]))
        picked = [adjusted(c, table) if adjust and c in fields else F.col(c) for c in cols]
        return self._with(src.select(*picked), id=search_by, start=start_date, end=end_date)

    def query_static_table(self, table: str, fields: list[str], assets, search_by: str, start_date: str = "1900", end_date: str = "3000") -> Query:
        """One row per variation of the fields with its first and last date; separate spells of one value merge."""
        src = self._assets(self._between(self._table(table), start_date, end_date), assets, search_by, start_date, end_date)
        cols = list(dict.fromkeys([search_by, *fields]))
        return self._with(src.groupBy(*cols).agg(F.min("date").alias("min_date"), F.max("date").alias("max_date")), id=search_by, start=start_date, end=end_date)

    def query_universe_table(self, table: str, fields: list[str], start_date: str, end_date: str, index: str | None = None, keep_date_col: bool = True) -> Query:
        """A universe within the dates, both included."""
        u = (self.universes or {}).get(table)
        src = self._between(u if u is not None else self._table(table), start_date, end_date)
        cols = list(dict.fromkeys([*(["date"] if keep_date_col else []), *fields]))
        return self._with(src.select(*cols), id=index, start=start_date, end=end_date)

    def query_no_date_table(self, table: str, fields: list[str], assets, search_by: str, start_date: str | None = None, end_date: str | None = None) -> Query:
        """A table without dates; the dates only limit which members of a named universe are taken."""
        src = self._assets(self._table(table), assets, search_by, start_date, end_date)
        return self._with(src.select(*dict.fromkeys([search_by, *fields])), id=search_by, start=start_date, end=end_date)

    # ---- columns and rows ------------------------------------------------------------------------------------

    def distinct(self) -> Query:
        return self._with(self.df.distinct())

    def set_freq(self, freq: str) -> Query:
        """Dates become the first day of their period."""
        return self._with(self.df.withColumn("date", to_period("date", freq)), freq=freq)

    def add_to_select(self, column: str, add_field: str | None = None) -> Query:
        """A computed column from an SQL expression, named add_field or by the expression."""
        return self._with(self.df.withColumn(add_field, F.expr(column)) if add_field else self.df.select("*", F.expr(column)))

    def rename(self, mapping: dict[str, str]) -> Query:
        return self._with(self.df.withColumnsRenamed(mapping), id=mapping.get(self.id, self.id))

    def where(self, condition) -> Query:
        return self._with(self.df.where(condition))

    def dropna(self, column: str) -> Query:
        """Without the rows where the column is null or NaN."""
        return self._with(self.df.dropna(subset=[column]))

    def order_by(self, column: str, way: str = "ASC") -> Query:
        """Nulls come last both ways."""
        if way.upper() not in ("ASC", "DESC"):
            raise ValueError("way must be ASC or DESC")
        c = F.col(column)
        return self._with(self.df.orderBy(c.asc_nulls_last() if way.upper() == "ASC" else c.desc_nulls_last()))

    def to_temp(self, name: str) -> Query:
        self.df.createOrReplaceTempView(name)
        return self

    # ---- time ------------------------------------------------------------------------------------------------

    def calendar_days(self, calendar="NYSE") -> DataFrame:
        """(date) of a calendar within the query's range."""
        if isinstance(calendar, DataFrame):
            return self._between(calendar.select("date").distinct(), self.start, self.end)
        days = trading_days(self.spark, _full_date(self.start), _full_date(self.end), calendar)
        return days.where(F.col("date") < F.to_date(F.lit(_full_date(self.end)))) if calendar.lower() == "full" else days

    def set_calendar(self, calendar="NYSE") -> Query:
        """One row per id and calendar day of the query's range, null where there was none; other days fall away. NaN is null.

        'full' is every day, the end excluded. A DataFrame with a date column is taken as the calendar.
        """
        grid = dense_grid(self.df, self.calendar_days(calendar), id=self.id).drop("pos")
        kinds = dict(self.df.dtypes)
        seen = [F.nanvl(F.col(c), F.lit(None)).alias(c) if kinds[c] in ("double", "float") and c != self.id else F.col(c) for c in self.df.columns]
        return self._with(grid.join(self.df, ["date", self.id], "left").select(*seen))

    def shift(self, column: str, days: int, new_name: str | None = None) -> Query:
        """The column `days` rows earlier per id."""
        w = W.partitionBy(self.id).orderBy("date")
        return self._with(self.df.withColumn(new_name or f"{column}_lag_{days}", F.lag(column, days).over(w)))

    def shift_all(self, days: int) -> Query:
        """Every column but the id and the date `days` rows earlier; one window serves all."""
        w = W.partitionBy(self.id).orderBy("date")
        return self._with(self.df.withColumns({c: F.lag(c, days).over(w) for c in self.df.columns if c not in (self.id, "date")}))

    def forward_fill(self, limit_days: int | None = None) -> Query:
        """Every field's last value per id, not older than limit_days (None: without limit)."""
        return self._with(forward_fill(self.df, self.id, [c for c in self.df.columns if c not in (self.id, "date")], limit_days))

    def resample(self, calendar="NYSE", fill_limit: int | None = None) -> Query:
        """The values known on each day of a calendar: per day and field the last value within fill_limit days.

        Equal to filling every calendar day and then cutting to the calendar, without the 365-day grid: the
        calendar's rows and the data are ordered in one window per id.
        """
        q = self.set_calendar(calendar)
        fields = [c for c in self.df.columns if c not in (self.id, "date")]
        both = q.df.select("date", self.id).withColumn("_on", F.lit(True)).join(self.df, ["date", self.id], "full")
        filled = forward_fill(both, self.id, fields, fill_limit)
        return self._with(filled.where("_on").select(*self.df.columns))

    # ---- joins -----------------------------------------------------------------------------------------------

    def join(self, other: Query | DataFrame, on: dict[str, str], join_type: str = "INNER") -> Query:
        """Join on {mine: theirs}; their key columns and columns I have already are not repeated."""
        o = other.df if isinstance(other, Query) else other
        theirs = o.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(on.values())], *[c for c in o.columns if c not in on.values() and c not in self.df.columns])
        cond = None
        for i, a in enumerate(on):
            c = self.df[a] == theirs[f"_k{i}"]
            cond = c if cond is None else cond & c
        how = join_type.lower().replace(" outer", "").replace("full", "full").replace(" ", "_")
        return self._with(self.df.join(theirs, cond, how).drop(*[f"_k{i}" for i in range(len(on))]))

    def add_linker_table(self, link: DataFrame, join_on: dict[str, str], link_columns: list[str], link_start_col: str | None = None, link_end_col: str | None = None, extra_filter: str = "", closed: str = "neither") -> Query:
        """Left join to a link table whose rows hold between two dates; by default both ends are excluded."""
        return self._with(link_join(self.df, link, join_on, link_columns, link_start_col, link_end_col, extra_filter, closed))

    def reset_universe(self, assets, search_by: str | None = None, reindex: bool = True) -> Query:
        by = search_by or self.id
        return self._with(self._assets(self.df, assets, by, self.start, self.end), id=by if reindex else self.id)

    def add_date_to_fa_ff(self, link: DataFrame | None = None, only_keep_primary: bool = True, link_cols: list[str] | None = None) -> Query:
        """Annual statements take effect on 30 June of the next year; their own date stays as og_cstat_date. Optionally with the
        permno linked on the effective date: lpermno of link_cols comes out as permno."""
        d = F.last_day(F.add_months(F.trunc("og_cstat_date", "year"), 17))
        q = self._with(self.df.withColumnRenamed("date", "og_cstat_date").withColumn("date", d).select("date", "og_cstat_date", *[c for c in self.df.columns if c != "date"]))
        if link is None:
            return q
        kinds = "linktype IN ('LU', 'LC')" + (" AND linkprim IN ('P', 'C')" if only_keep_primary else "")
        return q.add_linker_table(link, {"gvkey": "gvkey"}, link_cols or ["lpermno"], "linkdt", "linkenddt", kinds).rename({"lpermno": "permno"})

    def join_funda_to_table_ff(self, funda: Query | DataFrame, on: dict[str, str], tolerance_days: int = 390, join_type: str = "INNER") -> Query:
        """Each row with the latest annual values in effect on its date and not older than tolerance_days.

        An as-of join by ordering both sides in one window per key, not a daily resample of the annual table.
        """
        f = funda.df if isinstance(funda, Query) else funda
        keys = list(on)
        vals = [c for c in f.columns if c not in (*on.values(), "date")]
        right = f.select(*[F.col(b).alias(a) for a, b in on.items()], "date", F.struct(F.col("date").alias("d"), *vals).alias("_f"), F.lit(0).alias("_mine"))
        left = self.df.withColumn("_mine", F.lit(1))
        w = W.partitionBy(*keys).orderBy("date", "_mine")
        x = left.unionByName(right, allowMissingColumns=True).withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where("_mine = 1")
        fresh = F.datediff("date", F.col("_f.d")) <= tolerance_days
        if join_type.upper() == "INNER":
            x = x.where(fresh)
        return self._with(x.select(*self.df.columns, *[F.when(fresh, F.col(f"_f.{c}")).alias(c) for c in vals if c not in self.df.columns]))


def _full_date(text) -> str:
    t = str(text)[:10]
    return t + {4: "-01-01", 7: "-01"}.get(len(t), "")


def forward_fill(df: DataFrame, id: str, fields: list[str], limit_days: int | None) -> DataFrame:
    """Fields filled with the id's last value within limit_days calendar days; NaN counts as missing."""
    kinds = dict(df.dtypes)
    w = W.partitionBy(id).orderBy("_day").rangeBetween(W.unboundedPreceding if limit_days is None else -limit_days, 0)
    x = df.withColumn("_day", F.unix_date(F.col("date").cast("date")))
    seen = lambda c: F.nanvl(F.col(c), F.lit(None)) if kinds[c] in ("double", "float") else F.col(c)
    return x.withColumns({c: F.last(seen(c), ignorenulls=True).over(w) for c in fields}).drop("_day")


def link_join(df: DataFrame, link: DataFrame, join_on: dict[str, str], link_columns: list[str], start: str | None, end: str | None, extra_filter: str = "", closed: str = "both", date: str = "date") -> DataFrame:
    """df LEFT JOIN link on equal keys and link validity; a null end is open when both ends are included.

    closed: 'both', 'neither', 'left', 'right'. Overlapping link rows give several rows, as in SQL. The equi keys
    shuffle or broadcast as Catalyst's statistics decide; the dates are a residual condition.
    """
    if closed not in ("both", "neither", "left", "right"):
        raise ValueError("closed must be both, neither, left or right")
    src = link.where(extra_filter) if extra_filter else link
    picked = src.select(
        *[F.col(b).alias(f"_k{i}") for i, b in enumerate(join_on.values())], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(link_columns)],
        *([F.col(start).alias("_ls")] if start else []), *([F.col(end).alias("_le")] if end else []),
    )
    cond = F.lit(True)
    for i, a in enumerate(join_on):
        cond = cond & (df[a] == picked[f"_k{i}"])
    if start:
        cond = cond & ((df[date] >= picked["_ls"]) if closed in ("both", "left") else (df[date] > picked["_ls"]))
    if end:
        inside = (df[date] <= picked["_le"]) if closed in ("both", "right") else (df[date] < picked["_le"])
        cond = cond & (picked["_le"].isNull() | inside if closed == "both" else inside)
    out = df.join(picked, cond, "left")
    taken = [c.split(" as ")[-1] for c in link_columns]
    return out.select(*df.columns, *[F.col(f"_c{i}").alias(c if c not in df.columns else f"{c}_link") for i, c in enumerate(taken)])
