"""Standing rows: of all deliveries of one key the latest one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standing_rows(df: DataFrame, keys: list[str], values: list[str], loaded_at: str = "loaded_at") -> DataFrame:
    """One row per key with the values of the delivery with the greatest loaded_at.

    One order decides over whole rows: loaded_at, then the values in the order they are listed, the greatest first,
    with null below every value and NaN above. So rows that tie on loaded_at but differ give the same row on every
    run, and the values of two rows are never mixed. A null loaded_at is older than any other. Rows with a null in
    a key are no observations and are dropped. An empty input gives an empty result; other columns of the input are
    neither kept nor read.

    The greatest row is a partial aggregate, so copies of one key collapse before the shuffle and a key with a
    third of all rows sends one row per map task.
    """
    row = F.struct(F.col(loaded_at).alias("_at"), *[F.col(v).alias(f"_{i}") for i, v in enumerate(values)])
    best = df.dropna(subset=keys).groupBy(*keys).agg(F.max(row).alias("_row"))
    return best.select(*keys, *[F.col(f"_row._{i}").alias(v) for i, v in enumerate(values)])


def standing_sql(table: str, keys: str, values: list[str], name: str, more: str = "") -> str:
    """The standing rows as SQL, with the one order of the operator over whole rows."""
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ["loaded_at", *values])
    there = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"{name} AS (SELECT *{more} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {table} WHERE {there}) WHERE rn = 1)"
