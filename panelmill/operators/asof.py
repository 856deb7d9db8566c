"""Attributes as known at event time, from independent change histories per attribute."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from panelmill.session import let_workers_import

OPEN_END = "9999-12-30"


def _sweep(links: list[tuple], attrs: int, entity, out: list[tuple]) -> None:
    """links of one entity, sorted by start: (start day, end day, rank key, values). Emit each attribute's changes."""
    points = sorted({x[0] for x in links} | {x[1] + 1 for x in links})
    heap: list[tuple] = []
    i, last = 0, [None] * attrs
    seen = [False] * attrs
    for p in points:
        while i < len(links) and links[i][0] == p:
            s, e, key, vals = links[i]
            heappush(heap, (-s, key, i, e, vals))
            i += 1
        while heap and heap[0][3] < p:
            heappop(heap)
        now = heap[0][4] if heap else (None,) * attrs
        for k in range(attrs):
            if not seen[k] or now[k] != last[k]:
                out.append((entity, k, p, now[k]))
                last[k], seen[k] = now[k], True


def change_histories(
    intervals: DataFrame, entity: str, start: str, end: str, attributes: list[str], tie: str
) -> DataFrame:
    """One change history per attribute: rows (entity, attribute, since, value), value null where nothing is valid.

    Of several intervals valid on a day the one with the greatest start wins, then the smallest `tie`, then the
    smallest values. Both ends belong to the interval; a null end is open. Rows with a null entity, start or
    tie, and intervals that end before they begin, are no intervals and are dropped. Values come out as strings.

    Equal intervals are merged by a map-side aggregate first, so an entity that holds a third of all rows by
    repetition shrinks before the shuffle. The sweep then streams over sorted partitions, holding one entity's
    distinct intervals at a time; only changes leave it, per attribute, so an update of one attribute makes no
    new version of the others.
    """
    schema = T.StructType(
        [
            T.StructField(entity, intervals.schema[entity].dataType),
            T.StructField("attribute", T.StringType()),
            T.StructField("since", T.IntegerType()),
            T.StructField("value", T.StringType()),
        ]
    )
    names = list(attributes)
    clean = (
        intervals.where(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(tie).isNotNull())
        .select(
            F.col(entity).alias("_e"),
            F.unix_date(start).alias("_s"),
            F.unix_date(F.coalesce(F.col(end), F.lit(OPEN_END).cast("date"))).alias("_t"),
            F.col(tie).cast("string").alias("_k"),
            *[F.col(a).cast("string").alias(f"_v{i}") for i, a in enumerate(names)],
        )
        .where("_t >= _s")
        .distinct()
        .repartition("_e")
        .sortWithinPartitions("_e", "_s", "_k", *[F.col(f"_v{i}").asc_nulls_last() for i in range(len(names))])
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, links = None, []
        for pdf in batches:
            out: list[tuple] = []
            vals = [[None if v is None or v != v else v for v in pdf[f"_v{i}"].tolist()] for i in range(len(names))]
            rows = zip(pdf["_e"].tolist(), pdf["_s"].tolist(), pdf["_t"].tolist(), pdf["_k"].tolist(), zip(*vals))
            for e, s, t, k, v in rows:
                if e != now:
                    if links:
                        _sweep(links, len(names), now, out)
                    now, links = e, []
                links.append((s, t, k, v))
            if out:
                yield _frame(out)
        if links:
            out = []
            _sweep(links, len(names), now, out)
            yield _frame(out)

    def _frame(out: list[tuple]) -> pd.DataFrame:
        e, k, p, v = zip(*out)
        return pd.DataFrame({entity: e, "attribute": [names[i] for i in k], "since": p, "value": v})

    let_workers_import(intervals.sparkSession)
    return clean.mapInPandas(run, schema)


def as_known_at(events: DataFrame, entity: str, date: str, histories: DataFrame, attributes: list[str], types: dict[str, T.DataType] | None = None) -> DataFrame:
    """Each distinct (entity, date) of events with every attribute's value last known on that date.

    The attributes are matched separately, each against its own history, and pivoted back; a change dated after
    the event is never used. An event before an attribute's first change, in a hole, or with an entity without
    history gets null. Events with a null entity or date are dropped. Extra columns of events are not kept, so
    they can't clash with attribute names. Histories hold all values as text; an attribute named in `types` comes out
    in its own type again.

    One shuffle by entity serves the matching window and the pivot. The rows of one entity are bounded by its
    days and changes, as equal events collapse map-side before the shuffle.
    """
    e = (
        events.where(F.col(entity).isNotNull() & F.col(date).isNotNull())
        .select(F.col(entity).alias("_e"), F.unix_date(date).alias("_d"))
        .distinct()
        .select("_e", F.explode(F.array(*[F.lit(a) for a in attributes])).alias("_a"), "_d", F.lit(1).alias("_event"), F.lit(None).cast("struct<v:string>").alias("_s"))
    )
    h = histories.where(F.col("attribute").isin(*attributes)).select(
        F.col(entity).cast(events.schema[entity].dataType).alias("_e"),
        F.col("attribute").alias("_a"),
        F.col("since").alias("_d"),
        F.lit(0).alias("_event"),
        F.struct(F.col("value").alias("v")).alias("_s"),
    )
    w = W.partitionBy("_e", "_a").orderBy("_d", "_event")
    known = (
        e.unionByName(h)
        .repartition("_e")
        .withColumn("_known", F.last("_s", ignorenulls=True).over(w))
        .where("_event = 1")
    )
    out = known.groupBy("_e", "_d").agg(*[F.max(F.when(F.col("_a") == a, F.col("_known.v"))).alias(a) for a in attributes])
    kinds = types or {}
    values = [F.col(a).cast(kinds[a]).alias(a) if a in kinds else F.col(a) for a in attributes]
    return out.select(F.col("_e").alias(entity), F.date_from_unix_date("_d").alias(date), *values)
