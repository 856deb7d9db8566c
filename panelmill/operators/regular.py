"""Irregular readings onto a regular grid of trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.session import small

def grid_positions(calendar: DataFrame, day: str) -> DataFrame:
    """(day INT, pos INT, on_grid BOOLEAN) for every calendar day from the first grid day to the last.

    pos numbers the grid days from 1; a day between two grid days has the position of the earlier one. Null and
    repeated grid days count once at most. The windows run in one task over the grid days alone, which are
    bounded by the length of the calendar, not by the readings.
    """
    days = calendar.where(F.col(day).isNotNull()).select(F.unix_date(day).alias("_d")).distinct()
    w = W.orderBy("_d")
    return days.select(
        F.col("_d").alias("_g"),
        F.row_number().over(w).alias("pos"),
        F.coalesce(F.lead("_d").over(w) - 1, F.col("_d")).alias("_until"),
    ).select(F.explode(F.sequence("_g", "_until")).alias("day"), "pos", "_g").select("day", "pos", (F.col("day") == F.col("_g")).alias("on_grid"))


def to_grid(
    readings: DataFrame,
    source: list[str],
    day: str,
    value: str,
    usable: Column,
    calendar: DataFrame,
    calendar_day: str,
    counter: bool = False,
) -> DataFrame:
    """One row per source and grid day between the source's first and last reading.

    readings: at most one row per (source, day); day may lie off the grid. `usable` says which values count.
    Consecutive usable readings are differenced; each increment is distributed over the grid cells (the time
    from one grid day to the next) in proportion to their overlap with the time between the two readings, and
    the level of a cell is the running total. With counter=True a fall is a reset: the increment is then the
    reading itself and the level goes on rising. With counter=False (prices, levels) increments carry their
    sign and the level is the reading, so an unfilled cell gets the overlap-weighted value between neighbours.

    Result: source columns, grid day, level, increment (null in a source's first cell), status ('delivered',
    'unusable': a row without usable value, 'missing': no row), reset (the counter fell since the previous
    reading), filled (no usable reading of its own, but increments were distributed to it) and uncovered (no two
    usable readings around it: before the first or after the last, level is null). A cell without a row is filled
    or uncovered, never neither. Readings with a null source or day, or off the calendar's range, are dropped;
    empty input gives an empty result.

    One shuffle by source; its rows are bounded by the days of its span.
    """
    grid = small(grid_positions(calendar, calendar_day))  # a row a day
    r = (
        readings.where(F.col(day).isNotNull())
        .dropna(subset=source)
        .select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(source)], F.unix_date(day).alias("_d"), F.when(usable, F.col(value).cast("double")).alias("_v"))
    )
    keys = [f"_s{i}" for i in range(len(source))]
    r = r.join(grid.select(F.col("day").alias("_d"), "pos", "on_grid"), "_d")
    w = W.partitionBy(*keys).orderBy("_d")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    # by the falling order: a frame to the end of the partition would be evaluated anew for every row
    after = W.partitionBy(*keys).orderBy(F.desc("_d")).rowsBetween(W.unboundedPreceding, -1)
    prev = F.last("_v", ignorenulls=True).over(before)
    fell = F.col("_v").isNotNull() & prev.isNotNull() & (F.col("_v") < prev)
    r = r.withColumn("_reset", F.coalesce(fell, F.lit(False)) if counter else F.lit(False))
    if counter:
        inc = F.when(F.col("_v").isNotNull(), F.when(prev.isNull() | F.col("_reset"), F.col("_v")).otherwise(F.col("_v") - prev))
        r = r.withColumn("_inc", inc).withColumn("_level", F.when(F.col("_v").isNotNull(), F.sum("_inc").over(upto)))
    else:
        r = r.withColumn("_level", F.col("_v"))
    point = F.when(F.col("_level").isNotNull(), F.struct(F.col("_d").alias("d"), F.col("_level").alias("l")))
    r = (
        r.withColumn("_p", point)
        .withColumn("_from", F.last("_p", ignorenulls=True).over(upto))
        .withColumn("_to", F.last("_p", ignorenulls=True).over(after))
        .withColumn("_next", F.lead(F.struct("pos", "on_grid")).over(w))
    )
    first = F.col("pos") + F.when(F.col("on_grid"), 0).otherwise(1)
    last = F.coalesce(F.col("_next.pos") - F.when(F.col("_next.on_grid"), 1).otherwise(0), F.col("pos"))
    cells = r.where(first <= last).withColumn("_cell", F.explode(F.sequence(first, last)))
    days = grid.where("on_grid").select(F.col("pos").alias("_cell"), F.col("day").alias("_t"))
    own = F.col("on_grid") & (F.col("_cell") == F.col("pos"))
    share = (F.col("_t") - F.col("_from.d")) / (F.col("_to.d") - F.col("_from.d"))
    level = F.when(F.col("_from.d") == F.col("_t"), F.col("_from.l")).otherwise(F.col("_from.l") + (F.col("_to.l") - F.col("_from.l")) * share)
    cells = (
        cells.join(days, "_cell")
        .withColumn("_lv", level)
        .withColumn("_status", F.when(own & F.col("_v").isNotNull(), "delivered").when(own, "unusable").otherwise("missing"))
    )
    wc = W.partitionBy(*keys).orderBy("_t")
    return cells.select(
        *[F.col(f"_s{i}").alias(c) for i, c in enumerate(source)],
        F.date_from_unix_date("_t").alias(day),
        F.col("_lv").alias("level"),
        (F.col("_lv") - F.lag("_lv").over(wc)).alias("increment"),
        F.col("_status").alias("status"),
        (F.col("_reset") & own).alias("reset"),
        (F.col("_lv").isNotNull() & (F.col("_status") != "delivered")).alias("filled"),
        F.col("_lv").isNull().alias("uncovered"),
    )
