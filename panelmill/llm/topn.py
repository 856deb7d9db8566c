"""Top N items of every group by statistics-guided skipping over clustered parquet files."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from panelmill.session import let_workers_import, table_path

#: Bytes of one row group of the clustered table, the unit that can be skipped; rows are read in batches of so many.
ROW_GROUP_BYTES, BATCH = 64 * 1024 * 1024, 1 << 16


def write_clustered(df: DataFrame, group: str, item: str, score: str, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write one row per (group, item) with its greatest score, clustered by group and falling score.

    Null groups, items and scores and NaN scores don't compete and are dropped. Copies collapse in a partial
    aggregate; the range partitioning is on (group, score, item), so a group with a third of all rows is split
    over a third of the files.
    """
    ok = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull()
    if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)):
        ok = ok & ~F.isnan(score)
    best = df.where(ok).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(F.max(score).alias("s"))
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    (
        best.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .parquet(path)
    )


def _open(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(at))


def row_group_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row per row group: file, number, least and greatest group (as text), least and greatest score (in its own type), rows.

    Footers are read by the executors; the driver only lists files. What a footer does not tell is null.
    """
    table = spark.read.parquet(path)
    files, kind = sorted(table.inputFiles()), table.schema["s"].dataType
    schema = T.StructType(
        [T.StructField(c, T.StringType() if c in ("path", "g_lo", "g_hi") else T.LongType() if c in ("rg", "n") else kind) for c in ("path", "rg", "g_lo", "g_hi", "s_lo", "s_hi", "n")]
    )
    paths = spark.createDataFrame([(p,) for p in files], "path string")
    paths = paths.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)), "path")

    def footers(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for p in pdf["path"]:
                m = _open(p).metadata
                at = {m.schema.column(k).name: k for k in range(m.num_columns)}
                for r in range(m.num_row_groups):
                    rg = m.row_group(r)
                    g, s = rg.column(at["g"]).statistics, rg.column(at["s"]).statistics
                    has = g is not None and g.has_min_max and s is not None and s.has_min_max
                    out.append((p, r, str(g.min) if has else None, str(g.max) if has else None, s.min if has else None, s.max if has else None, rg.num_rows))
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(schema.names, zip(*out) if out else [()] * 7)})

    return paths.mapInPandas(footers, schema)


def _scan(pf, groups: list[int], maxima: list, only: list | None = None, n: int = 1, counts: list[int] | None = None) -> dict:
    """Best items per group over the row groups of one file, read in falling order of their maxima.

    A row group is skipped if its maximum lies strictly below the n-th score of every group it contains; one without a
    known maximum (None) is read. Which groups it contains is read from the group column alone, unless `only` says
    that it holds one group. Rows are read in batches, so a large row group is never in memory as a whole, and a
    row group of one group is left after its first n rows, as they are sorted.
    """
    best: dict = {}
    for k, (rg, top) in enumerate(zip(groups, maxima)):
        alone = bool(only and only[k])
        if top is not None:
            inside = set()
            for b in pf.iter_batches(BATCH, row_groups=[rg], columns=["g"]):
                inside.update(b["g"].slice(0, 1 if alone else None).unique().to_pylist())
                if alone:
                    break
            if all(len(best.get(g, ())) >= n and best[g][0][0] > top for g in inside):
                continue
        if counts is not None:
            counts[0] += 1
        taken: dict = {}  # rows of the group so far, of this row group
        for b in pf.iter_batches(BATCH, row_groups=[rg], columns=["g", "i", "s"]):
            codes = b["g"].dictionary_encode().indices.to_numpy()
            start = np.r_[0, np.nonzero(codes[1:] != codes[:-1])[0] + 1]
            place = np.arange(len(codes)) - np.repeat(start, np.diff(np.r_[start, len(codes)]))
            first = b.take(pa.array(np.nonzero(place < n)[0]))
            for g, i, s in zip(first["g"].to_pylist(), first["i"].to_pylist(), first["s"].to_pylist()):
                if taken.get(g, 0) >= n:
                    continue
                taken[g] = taken.get(g, 0) + 1
                h, entry = best.setdefault(g, []), (s, _Last(i))
                if len(h) < n:
                    heappush(h, entry)
                elif h[0] < entry:
                    heapreplace(h, entry)
            if alone and taken and min(taken.values()) >= n:
                break
    return best


class _Last:
    """Orders items the other way round: among equal scores the smaller item ranks higher."""

    __slots__ = ("item",)

    def __init__(self, item):
        self.item = item

    def __lt__(self, other):
        return self.item > other.item

    def __eq__(self, other):
        return self.item == other.item


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """The n items with the greatest score of every group: rows (group, item, score, place).

    An item counts once per group, with its greatest score; equal scores go to the smaller item. Null groups,
    items and scores and NaN scores don't compete; infinite scores do. Groups with fewer items list all they
    have; an empty input gives an empty result. Extra columns are not kept. The score keeps its type, in the clustered
    table, its statistics and the result, so large integers and decimals are compared exactly.

    The clustered table is written once to the shared folder. From its footers follows, per group, a score that
    at least n items reach (the least score of a row group that holds that group alone and n rows or more): row
    groups of that group alone that lie strictly below it are never opened. The others are read file by file in
    falling order of their maxima, skipping those strictly below every contained group's current n-th score.
    What is left per file and group is n rows at most; a window with group limit makes the final cut.
    """
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType for c in (group, item)}
    path = table_path(spark, "clustered")
    write_clustered(df, group, item, score, path, row_group_bytes)
    schema = T.StructType([T.StructField("g", kinds[group]), T.StructField("i", kinds[item]), T.StructField("s", df.schema[score].dataType)])
    stats = row_group_stats(spark, path)
    alone = F.coalesce(F.col("g_lo") == F.col("g_hi"), F.lit(False)) & F.col("s_lo").isNotNull()
    bound = stats.where(alone & (F.col("n") >= n)).groupBy(F.col("g_lo").alias("_g")).agg(F.max("s_lo").alias("_bound"))
    plan = stats.withColumn("only", alone).join(bound, F.col("only") & (F.col("g_lo") == F.col("_g")), "left").where(F.col("_bound").isNull() | (F.col("s_hi") >= F.col("_bound")))
    plan = plan.select("path", "rg", F.col("s_hi").alias("top"), "only").repartition("path").sortWithinPartitions("path", F.col("top").desc_nulls_first(), "rg")
    let_workers_import(spark)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in it:
            for r in batch.to_pylist():
                if r["path"] != now:
                    yield from _result(now, held)
                    now, held = r["path"], []
                held.append((r["rg"], r["top"], r["only"]))
        yield from _result(now, held)

    def _result(p: str | None, held: list) -> Iterator[pa.RecordBatch]:
        best = _scan(_open(p), *map(list, zip(*held)), n=n) if held else {}
        rows = [{"g": g, "i": x.item, "s": s} for g, h in best.items() for s, x in h]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    found = plan.mapInArrow(read, schema)
    w = W.partitionBy("g").orderBy(F.col("s").desc(), "i")
    ranked = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "place")
