"""Cross-sectional windows: buckets, ranks, robust scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.functions.numeric import finite
from panelmill.session import fetched


def _columns(df: DataFrame, partition_by: list[str], exclude: list[str] | None) -> list[str]:
    return [c for c in df.columns if c not in (*partition_by, *(exclude or []))]


#: A date with more rows than this is ranked in parts, each in a task of its own.
PART = 1_000_000


def split_row_numbers(df: DataFrame, by: str, value: str, tie: str, parts: int, hot: DataFrame) -> DataFrame:
    """df with _rn, the row number per `by` in the order of falling value, then tie, where the groups of `hot` are numbered in parts.

    The parts of a hot group lie between approximate quantiles of its values, taken once and held as literal rows: which
    part a row is in follows from its value alone, so equal values stay together, and a row's number is that within its
    part plus the rows of the parts before. Results are the same as those of one sort. value must not be null.
    """
    at = F.percentile_approx(value, [k / parts for k in range(1, parts)], 10_000)
    cuts = fetched(df.join(hot.select(by), by, "left_semi").groupBy(by).agg(at.alias("_cuts")))
    x = df.join(cuts, by, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c > F.col(value))))).drop("_cuts")
    sizes = x.where(F.col("_part").isNotNull()).join(hot.select(by), by, "left_semi").groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")
    offsets = fetched(sizes.select(by, "_part", before.alias("_before")))
    x = x.join(offsets, [by, "_part"], "left")
    own = F.row_number().over(W.partitionBy(by, "_part").orderBy(F.desc(value), tie))
    return x.withColumn("_rn", own + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def bucket_factor(factor: DataFrame, buckets: int, part: int = PART) -> DataFrame:
    """(date, id, factor, ntile): per date, bucket 1 holds the highest factors. Null, NaN and infinite factors are
    left out first; ties go by id, so buckets are the same on every run.

    A date of more than `part` rows is split over tasks by its values (split_row_numbers); rows per date are counted
    first, unless the plan's size says that no date can have so many."""
    f = factor.select("date", "id", finite(F.col("factor").cast("double")).alias("factor")).where("factor IS NOT NULL AND date IS NOT NULL AND id IS NOT NULL")
    whole = lambda: f.withColumn("ntile", F.ntile(buckets).over(W.partitionBy("date").orderBy(F.desc("factor"), "id")))
    if int(str(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 8 * part:
        return whole()
    sizes = f.groupBy("date").agg(F.count("*").alias("_all"))
    hot = sizes.where(F.col("_all") > part)
    most = hot.agg(F.max("_all")).first()[0]
    if most is None:
        return whole()
    x = split_row_numbers(f, "date", "factor", "id", min(-(-most // part), 1000), fetched(hot)).join(fetched(sizes), "date")
    # the first (rows mod buckets) buckets have a row more
    low, more, at = F.expr(f"_all div {buckets}"), F.col("_all") % buckets, F.col("_rn") - 1
    longer = more * (low + 1)
    n = F.when(at < longer, F.floor(at / (low + 1))).otherwise(F.floor((at - longer) / F.greatest(low, F.lit(1))) + more) + 1
    return x.select("date", "id", "factor", n.cast("int").alias("ntile"))


def ntile_columns(df: DataFrame, buckets: int, partition_by: list[str], exclude: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """Every other column as its bucket within the partition, highest first. Nulls are kept and come last.

    All columns share one exchange on the partition key and sort once each."""
    out = {}
    for c in _columns(df, partition_by, exclude):
        x = F.nanvl(F.col(c), F.lit(None)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        out[c] = F.ntile(buckets).over(W.partitionBy(*partition_by).orderBy(x.desc_nulls_last(), *(tie or exclude or [])))
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


RANKS = {"percent_rank": F.percent_rank, "rank": F.rank, "dense_rank": F.dense_rank, "cume_dist": F.cume_dist, "row_number": F.row_number}


def rank_columns(df: DataFrame, partition_by: list[str], exclude: list[str] | None = None, rank_type: str = "percent_rank") -> DataFrame:
    """Every other column as its rank, ascending; a null stays null but counts in the denominator. NaN is null."""
    if rank_type not in RANKS:
        raise ValueError(f"rank_type must be one of {', '.join(RANKS)}")
    out = {}
    for c in _columns(df, partition_by, exclude):
        x = F.nanvl(F.col(c), F.lit(None)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        tie = (exclude or []) if rank_type == "row_number" else []
        out[c] = F.when(x.isNotNull(), RANKS[rank_type]().over(W.partitionBy(*partition_by).orderBy(x.asc_nulls_last(), *tie)))
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def robust_scores(df: DataFrame, partition_by: list[str], exclude: list[str] | None = None) -> DataFrame:
    """(x - median) / sample deviation per partition for every other column; null without variance. NaN is null."""
    w = W.partitionBy(*partition_by)

    def score(c: str) -> Column:
        x = finite(F.col(c).cast("double"))
        return F.try_divide(x - F.median(x).over(w), F.stddev_samp(x).over(w))

    return df.select(*[score(c).alias(c) if c not in partition_by and c not in (exclude or []) else F.col(c) for c in df.columns])
