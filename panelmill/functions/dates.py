"""Frequencies, period truncation, a rule-based exchange calendar and date configuration."""

from __future__ import annotations

import datetime as dt
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Annualisation per frequency; both spellings of the yearly one are taken. Fixed values.
PERIODS = {"D": ("Daily", 252), "W": ("Weekly", 52), "M": ("Monthly", 12), "Q": ("Quarterly", 4), "Y": ("Yearly", 1), "A": ("Yearly", 1)}
FREQUENCIES = ("D", "B", "W", "M", "Q", "A")
#: Resampling more rows than this without a grouper is most likely an oversight.
MANY_ROWS = 10_000


def annualization(freq: str) -> int:
    """Periods a year; pandas spellings such as 'ME' or 'W-SUN' are read by their first letter."""
    key = freq.split("-")[0]
    key = key[0] if len(key) > 1 and key[0] in PERIODS and key[1:] in ("E", "S") else key
    if key not in PERIODS:
        raise ValueError(f"Unknown frequency {freq!r}")
    return PERIODS[key][1]


def period_name(freq: str) -> str:
    annualization(freq)
    return PERIODS[freq[0]][0]


def to_period(c: Column | str, freq: str) -> Column:
    """The first day of the period a date lies in. 'B' rolls Saturdays and Sundays forward to Monday."""
    d = (F.col(c) if isinstance(c, str) else c).cast("date")
    if freq == "D":
        return d
    if freq == "B":
        day = F.dayofweek(d)
        return F.date_add(d, F.when(day == 7, 2).when(day == 1, 1).otherwise(0))
    unit = {"W": "week", "M": "month", "Q": "quarter", "A": "year", "Y": "year"}.get(freq)
    if unit is None:
        raise ValueError(f"Frequency {freq!r} is not one of {', '.join(FREQUENCIES)}")
    return F.trunc(d, unit)


def period_end(c: Column | str, freq: str) -> Column:
    """The last day of the period a date lies in; a coarse period becomes its end when it is refined."""
    start = to_period(c, freq)
    if freq in ("D", "B"):
        return start
    if freq == "W":
        return F.date_add(start, 6)
    months = {"M": 1, "Q": 3, "A": 12, "Y": 12}[freq]
    return F.date_add(F.add_months(start, months), -1)


def period_before(c: Column, freq: str) -> Column:
    """The period before, as its first day."""
    if freq in ("D", "B"):
        return F.date_add(c, -1)
    if freq == "W":
        return F.date_add(c, -7)
    return F.add_months(c, {"M": -1, "Q": -3, "A": -12, "Y": -12}[freq])


def strptime_pattern(fmt: str) -> str:
    """A strptime format as a Spark pattern."""
    names = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}
    out, k = "", 0
    while k < len(fmt):
        two = fmt[k : k + 2]
        if two in names:
            out, k = out + names[two], k + 2
        elif fmt[k] == "%":
            raise ValueError(f"Format {two!r} is not supported")
        else:
            out, k = out + (f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]), k + 1
    return out


def _easter(year: int) -> dt.date:
    """Western Easter Sunday by the Gregorian computus."""
    golden, century = year % 19, year // 100
    skipped = century - century // 4 - (8 * century + 13) // 25
    epact = (skipped + 19 * golden + 15) % 30
    epact -= epact // 28 * (1 - 29 // (epact + 1) * ((21 - golden) // 11))
    weekday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    day = epact - weekday
    month = 3 + (day + 40) // 44
    return dt.date(year, month, day + 28 - 31 * (month // 4))


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


#: Unscheduled full-day closings since 1970, as a plain table (fixed values).
SPECIAL_CLOSINGS = (
    "1972-12-28", "1973-01-25", "1977-07-14", "1985-09-27", "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14",
    "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)


def us_exchange_holidays(year: int) -> set[dt.date]:
    """Full-day US exchange holidays of a year from 1970 on, by the public rules; before, the same rules apply as an approximation."""

    def seen(d: dt.date, saturday: bool = True) -> dt.date | None:
        if d.weekday() == 5:
            return d - dt.timedelta(1) if saturday else None
        return d + dt.timedelta(1) if d.weekday() == 6 else d

    days = {
        seen(dt.date(year, 1, 1), saturday=False),
        _nth(year, 2, 0, 3) if year >= 1971 else seen(dt.date(year, 2, 22)),
        _easter(year) - dt.timedelta(2),
        _nth(year, 5, 0, -1) if year >= 1971 else seen(dt.date(year, 5, 30)),
        seen(dt.date(year, 7, 4)),
        _nth(year, 9, 0, 1),
        _nth(year, 11, 3, 4),
        seen(dt.date(year, 12, 25)),
    }
    if year >= 1998:
        days.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        days.add(seen(dt.date(year, 6, 19)))
    if year <= 1980 and year % 4 == 0:
        days.add(_nth(year, 11, 0, 1) + dt.timedelta(1))
    days |= {d for d in map(dt.date.fromisoformat, SPECIAL_CLOSINGS) if d.year == year}
    return {d for d in days if d}


def trading_days(spark: SparkSession, start: str, end: str, calendar: str = "NYSE", column: str = "date") -> DataFrame:
    """Exchange days in [start, end]; 'full' gives every calendar day. Generated by sequence(), no library."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(column))
    if dt.date.fromisoformat(start[:10]) > dt.date.fromisoformat(end[:10]):
        days = days.limit(0)
    if calendar.lower() == "full":
        return days
    if calendar.upper() not in ("NYSE", "NASDAQ", "XNYS"):
        raise ValueError(f"Calendar {calendar!r} is not known")
    closed = sorted(h for y in range(int(start[:4]), int(end[:4]) + 1) for h in us_exchange_holidays(y))
    days = days.where(~F.dayofweek(column).isin(1, 7))
    return days.where(~F.col(column).isin([h for h in closed])) if closed else days


@dataclass(frozen=True)
class DateConfig:
    """How date columns become periods: frequency, target type, optional down-sampling to the last non-null value.

    freq one of D, B, W, M, Q, A; target_data_type 'period' (first day of the period) or 'timestamp'.
    """

    freq: str
    target_data_type: str = "period"
    resample: bool = False
    resample_key: str | None = None
    grouper_keys: list[str] = field(default_factory=list)
    date_format: str | None = None

    def __post_init__(self):
        if self.freq not in FREQUENCIES:
            raise ValueError(f"freq must be one of {', '.join(FREQUENCIES)}, not {self.freq!r}")
        if self.target_data_type not in ("timestamp", "period"):
            raise ValueError(f"target_data_type must be timestamp or period, not {self.target_data_type!r}")

    def copy(self, **overrides) -> DateConfig:
        return replace(self, **overrides)

    def configure_dates(self, df: DataFrame, date_columns: str | list[str]) -> DataFrame:
        """Convert the columns; with resample, keep per (grouper_keys, period) each column's last non-null value.

        Strings need date_format. NaN counts as missing. Empty input stays empty; rows with a null date keep it,
        and are dropped by resampling.
        """
        dates = [date_columns] if isinstance(date_columns, str) else list(date_columns)
        missing = [c for c in dates if c not in df.columns]
        if missing:
            raise ValueError(f'Required column "{missing[0]}" is not present')
        if self.resample and len(dates) > 1 and self.resample_key is None:
            raise ValueError("resample_key must be given when there is more than one date column")
        key = self.resample_key or dates[0]
        if self.resample and key not in dates:
            raise ValueError(f"resample_key {key!r} is not one of the date columns")
        kinds = dict(df.dtypes)
        if any(kinds[c] == "string" for c in dates) and self.date_format is None:
            raise ValueError("date_format must be given for date columns of type string")

        def parsed(c: str) -> Column:
            return F.to_date(F.col(c), strptime_pattern(self.date_format)) if kinds[c] == "string" else F.col(c).cast("date")

        out = df.withColumns({c: to_period(parsed(c), self.freq) for c in dates} | ({"_order": parsed(key)} if self.resample else {}))
        if self.resample:
            if not self.grouper_keys and df.limit(MANY_ROWS + 1).count() > MANY_ROWS:
                warnings.warn(f"More than {MANY_ROWS} rows are resampled without grouper_keys: one row per period stays", stacklevel=2)
            rest = [c for c in df.columns if c not in (*self.grouper_keys, key)]
            good = lambda c: F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
            aggs = [F.max_by(F.col(c), F.when(good(c), F.col("_order"))).alias(c) for c in rest]
            by = [*self.grouper_keys, key]
            out = out.where(F.col(key).isNotNull()).groupBy(*by)
            out = (out.agg(*aggs) if aggs else out.agg(F.count("*").alias("_n")).drop("_n")).select(*df.columns)
        if self.target_data_type == "timestamp":
            out = out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates})
        return out
