"""Filling missing values by predictive mean matching within security, company and day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.numeric import is_finite
from panelmill.session import fetched, small, written


def _long(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field (the place of the field in the list: a number is cheaper to move than a name), value."""
    cells = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).cast("double").alias("value")) for i, f in enumerate(fields)])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.field", "_c.value")


def _beside(what: str, value: str, keys: list[str], order: list[str]) -> Column:
    """The value of the row before (lag) or after (lead) that has one. Both ways take one sort, where a frame from the row
    to the end of its partition would be evaluated anew for every row."""
    name = lambda c: f"`{c}`"
    return F.expr(f"{what}({name(value)}, 1) IGNORE NULLS OVER (PARTITION BY {', '.join(map(name, keys))} ORDER BY {', '.join(map(name, order))})")


def with_lone_readings(cells: DataFrame, keys: list[str], date: str, jump: float = 3.0) -> DataFrame:
    """cells (keys, date, field, value) with _y, the logarithm of a positive and finite value, and _alone: (before, after), its
    usable neighbours, where it lies `jump` times above or below both; else null."""
    x = cells.withColumn("_y", F.when(_positive("value"), F.log("value")))
    x = x.withColumn("_seen", F.when(F.col("_y").isNotNull(), F.struct("value", "_y")))
    x = x.withColumns({"_before": _beside("lag", "_seen", [*keys, "field"], [date]), "_after": _beside("lead", "_seen", [*keys, "field"], [date])})
    far = lambda c: F.abs(F.col("_y") - F.col(f"{c}._y")) > math.log(jump)
    pair = F.struct(F.col("_before.value").alias("before"), F.col("_after.value").alias("after"))
    return x.withColumn("_alone", F.when(far("_before") & far("_after"), pair)).select(*keys, date, "field", "value", "_y", "_alone")


def _positive(c: str) -> Column:
    return F.coalesce(is_finite(c) & (F.col(c) > 0), F.lit(False))


def stand_ins(cells: DataFrame, keys: list[str], share: float = 0.2, least: int = 2) -> DataFrame:
    """(field, value) of the positive numbers that are used as stand-ins for a missing value.

    A security votes for a value where it stands alone (with_lone_readings). A value is a stand-in if at least `least`
    securities vote for it (one, if it is written in nines only or is a power of ten) and they are at least `share` of the
    securities that have it. Genuine values either last for more than a reading or are one security's own. In a second
    count, places between values of the first count give no vote, unless for nines: a genuine reading among stand-ins
    stands alone as well.

    cells: as from with_lone_readings, written. All counts are over all rows. The readings that stand alone are few;
    only their values are looked up in all cells again.
    """
    alone = cells.where("_alone IS NOT NULL").select(*keys, "field", "value", F.col("_alone.before").alias("_before"), F.col("_alone.after").alias("_after"))
    alone = written(alone, "alone")

    def votes(df: DataFrame) -> DataFrame:
        return df.select(*keys, "field", "value").distinct().groupBy("field", "value").agg(F.count("*").alias("_votes"))

    digits = F.regexp_replace(F.format_string("%.6f", F.col("value")), r"\.?0+$", "")
    nines = digits.rlike(r"^9{2,}0*(\.9+)?$")
    typical = nines | digits.rlike(r"^10*$") | digits.rlike(r"^0\.0*1$")
    enough = (F.col("_votes") >= F.when(typical, 1).otherwise(least)) & (F.col("_votes") >= share * F.col("_has"))
    first = votes(alone)
    has = cells.where("_y IS NOT NULL").join(small(first.select("field", "value")), ["field", "value"], "left_semi").select(*keys, "field", "value").distinct()
    first = written(first.join(has.groupBy("field", "value").agg(F.count("*").alias("_has")), ["field", "value"]).where(enough), "voted")
    clear = alone
    for side in ("_before", "_after"):
        clear = clear.join(small(first.select("field", F.col("value").alias(side))), ["field", side], "left_anti")
    second = first.select("field", "value", "_has").join(votes(clear), ["field", "value"], "left")
    return second.where(nines | enough).select("field", "value")


def _fit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Level _m at time _t and slope _b of _y over the days _d per group (slope 0 where the group has one day)."""
    t = F.col("_d").cast("double")
    return rows.groupBy(*by).agg(F.avg("_y").alias("_m"), F.avg(t).alias("_t"), F.coalesce(F.try_divide(F.covar_pop("_y", t), F.var_pop(t)), F.lit(0.0)).alias("_b"))


def _nearest(place: str, donor: str, keys: list[str], date: str) -> Column:
    """The donor with the nearest prediction: range search to both sides in the order of the predictions."""
    down, up = (_beside(w, donor, keys, [place, date]) for w in ("lag", "lead"))
    gap = lambda c: F.abs(c["p"] - F.col(place))
    return F.when(up.isNull() | (gap(down) <= gap(up)), down).otherwise(up)


def fill_by_matching(
    df: DataFrame, company: str, issue: str, date: str, fields: list[str]
) -> DataFrame:
    """Every cell of `fields` with its value, filled where it had none that can be used, and the donor it came from.

    df: at most one row per (company, issue, date). A cell is unusable if null, NaN, infinite, not positive, or
    a stand-in number (see stand_ins). Its value is copied from an observed cell: predictions come from a
    log-linear fit over time per group plus the day's mean residual over all securities, and the donor is the
    observed cell of the same group with the nearest prediction (a tie goes to the lower prediction, then the
    earlier day). Groups are tried in turn: the security, its company, all securities of the day, and, on a day
    without any usable value, those of the nearest such day. Only a field with no usable value at all stays null.

    Result: company, issue, date, field, delivered, value, filled (value is copied), unusable, donor_company,
    donor_issue, donor_date, donor_level ('security', 'company', 'day'). Rows with null keys are dropped; extra
    columns are not kept; an empty input gives an empty result.

    Scale: two exchanges by (security, field), for the lone readings and for the range search, each written to the shared
    folder as several steps read it; a security's cells are bounded by its days. Fits and days are partial aggregates.
    Only the companies and days that cells without a donor in their security ask for are read for these: the company
    step reduces donors to one per company and day, the day step to one per day, both with partial aggregates, so
    neither a large company nor a large day ends in one task.
    """
    keys = [company, issue]
    base = df.dropna(subset=[company, issue, date]).withColumn("_d", F.unix_date(date))
    cells = written(with_lone_readings(_long(base, [*keys, "_d"], fields), keys, "_d"), "cells")
    found = written(stand_ins(cells, keys), "stand-ins").withColumn("_in", F.lit(True))
    x = cells.select(*keys, "_d", "field", "value", "_y").join(small(found), ["field", "value"], "left")
    x = x.withColumn("_ok", F.col("_y").isNotNull() & F.col("_in").isNull()).withColumn("_y", F.when(F.col("_ok"), F.col("_y"))).drop("_in")
    # the security's own fit: level and slope over time of the logarithm
    fits = written(_fit(x.where("_ok"), [*keys, "field"]), "fits")
    x = x.join(small(fits), [*keys, "field"], "left").withColumn("_trend", F.col("_m") + F.col("_b") * (F.col("_d") - F.col("_t"))).drop("_m", "_b", "_t")
    # the day's common move over all securities: one row per day and field
    day = fetched(x.where("_ok").groupBy("field", "_d").agg(F.avg(F.col("_y") - F.col("_trend")).alias("_move"), F.avg("_y").alias("_mean")))
    p = x.join(day.select("field", "_d", "_move"), ["field", "_d"], "left").withColumn("_pred", F.col("_trend") + F.coalesce("_move", F.lit(0.0)))
    donor = F.struct(F.col("_pred").alias("p"), F.col("value").alias("v"), F.col("_d").alias("d"))
    p = p.select(*keys, "_d", "field", "value", "_ok", "_pred", F.when(F.col("_ok"), donor).alias("_donor"))
    p = p.withColumn("_s", F.when(~F.col("_ok") & F.col("_pred").isNotNull(), _nearest("_pred", "_donor", [*keys, "field"], "_d")))
    p = written(p.select(*keys, "_d", "field", "value", "_ok", F.col("_s.v").alias("_sv"), F.col("_s.d").alias("_sd")), "matched")
    # cells whose security has no usable value of the field: company, then day
    rest = written(p.where(~F.col("_ok") & F.col("_sv").isNull()).select(*keys, "_d", "field"), "open")
    usable = p.where("_ok").select(*keys, "_d", "field", "value", F.log("value").alias("_y"))
    rest = written(rest.join(_from_company(rest, usable, company, issue), [company, "field", "_d"], "left"), "rest")
    rest = rest.join(_from_day(rest.where("_c IS NULL"), usable, day, company, issue), ["field", "_d"], "left").select(
        *keys, "_d", "field", F.coalesce("_c", "_n").alias("_other"), F.when(F.col("_c").isNotNull(), "company").when(F.col("_n").isNotNull(), "day").alias("_lv")
    )
    out = p.join(small(written(rest, "others")), [*keys, "_d", "field"], "left")
    names = F.array(*[F.lit(f) for f in fields])
    own, other = F.col("_sv").isNotNull(), F.col("_other")
    return out.select(
        *keys,
        F.date_from_unix_date("_d").alias(date),
        names[F.col("field")].alias("field"),
        F.col("value").alias("delivered"),
        F.when(F.col("_ok"), F.col("value")).otherwise(F.coalesce("_sv", other["v"])).alias("value"),
        (~F.col("_ok") & (own | other.isNotNull())).alias("filled"),
        (~F.col("_ok")).alias("unusable"),
        F.when(own, F.col(company)).otherwise(other["c"]).alias("donor_company"),
        F.when(own, F.col(issue)).otherwise(other["i"]).alias("donor_issue"),
        F.date_from_unix_date(F.coalesce("_sd", other["d"])).alias("donor_date"),
        F.when(own, "security").otherwise(F.col("_lv")).alias("donor_level"),
    )


def _from_company(rest: DataFrame, usable: DataFrame, company: str, issue: str) -> DataFrame:
    """(company, field, _d, _c): the donor of the company for each day it is asked for, by the company's own fit.

    Donors are one per company and day, of the least issue. Only companies with an open cell are read.
    """
    need = rest.select(company, "field", "_d").distinct()
    asked = usable.join(small(need.select(company, "field").distinct()), [company, "field"], "left_semi")
    one = F.struct(F.col("value").alias("v"), F.col(company).alias("c"), F.col(issue).alias("i"), F.col("_d").alias("d"))
    own = asked.groupBy(company, "field", "_d").agg(F.min_by(one, issue).alias("_o"), F.avg("_y").alias("_y"))
    both = need.join(own, [company, "field", "_d"], "full").join(_fit(own, [company, "field"]), [company, "field"])
    both = both.withColumn("_pred", F.col("_m") + F.col("_b") * (F.col("_d") - F.col("_t")))
    donor = F.struct(F.col("_pred").alias("p"), *[F.col(f"_o.{c}").alias(c) for c in "vcid"])
    both = both.withColumn("_donor", F.when(F.col("_o").isNotNull(), donor))
    both = both.withColumn("_c", F.coalesce(F.col("_donor"), _nearest("_pred", "_donor", [company, "field"], "_d")))
    return both.select(company, "field", "_d", "_c")


def _from_day(rest: DataFrame, usable: DataFrame, day: DataFrame, company: str, issue: str) -> DataFrame:
    """(field, _d, _n): of all securities' cells of the day, or of the nearest day with a usable one, that next to the day's mean.

    Which day serves an asked day follows from the day table alone, a row a day; only serving days are read.
    """
    both = rest.select("field", "_d").distinct().join(day.select("field", "_d", "_mean"), ["field", "_d"], "full").withColumn("_own", F.when(F.col("_mean").isNotNull(), F.struct("_d", "_mean")))
    down, up = (_beside(w, "_own", ["field"], ["_d"]) for w in ("lag", "lead"))
    both = both.withColumns({"_down": F.coalesce("_own", down), "_up": F.coalesce("_own", up)})
    lower = F.col("_up").isNull() | (F.col("_d") - F.col("_down._d") <= F.col("_up._d") - F.col("_d"))
    serves = both.withColumn("_by", F.when(lower, F.col("_down")).otherwise(F.col("_up"))).where("_by IS NOT NULL")
    asked = rest.select("field", "_d").distinct().join(serves, ["field", "_d"]).select("field", "_d", F.col("_by._d").alias("_at"), F.col("_by._mean").alias("_mean"))
    asked = written(asked, "asked")
    cells = usable.withColumnRenamed("_d", "_at").join(small(asked.select("field", "_at", "_mean").distinct()), ["field", "_at"])
    cells = cells.withColumn("_gap", F.abs(F.col("_y") - F.col("_mean")))
    # the least gap is a number, which a hash aggregate can hold; whole donors are compared only where they share it
    least = fetched(cells.groupBy("field", "_at").agg(F.min("_gap").alias("_gap")))
    one = F.struct(F.col("_y").alias("p"), F.col("value").alias("v"), F.col(company).alias("c"), F.col(issue).alias("i"), F.col("_at").alias("d"))
    near = cells.join(least, ["field", "_at", "_gap"]).groupBy("field", "_at").agg(F.min_by(one, F.struct(company, issue)).alias("_n"))
    return asked.join(near, ["field", "_at"]).select("field", "_d", "_n")
