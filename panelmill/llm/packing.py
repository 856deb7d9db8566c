"""Filling containers of fixed capacity by exact-complement hashing over the histogram of lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelmill.session import MAX_BROADCAST_ROWS

#: Items of one length are ranked in independent parts of about so many.
PART = 200_000


class _Sums:
    """Which lengths are available, how many of each, and in how many ways two of them make each sum."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64)
        self.top = len(counts) - 1
        self.there = self.n > 0
        size = 1 << (2 * len(counts)).bit_length()
        spectrum = np.fft.rfft(self.there.astype(float), size)
        ordered = np.rint(np.fft.irfft(spectrum * spectrum, size)).astype(np.int64)[: 2 * len(counts)]
        double = np.zeros_like(ordered)
        double[: 2 * self.top + 1 : 2] = self.there  # a length with itself needs two items
        self.pairs = (ordered - double) // 2
        twice = np.nonzero(self.n > 1)[0]
        self.pairs[2 * twice] += 1

    def take(self, length: int, many: int) -> None:
        """Use items up; a length that runs out leaves the index of pair sums."""
        before = self.n[length]
        self.n[length] = left = before - many
        if before > 1 >= left:
            self.pairs[2 * length] -= 1
        if before and not left:
            self.there[length] = False
            self.pairs[length : length + self.top + 1] -= self.there

    def pair(self, total: int, free: np.ndarray | None = None) -> tuple[int, int] | None:
        """Two available lengths with this sum, the most uneven ones: the longest item is the hardest to place.

        free: how many of each length may be used, if not all."""
        if total < 2 or total >= len(self.pairs) or self.pairs[total] <= 0:
            return None
        free = self.n if free is None else free
        lo, hi = max(1, total - self.top), total // 2
        ok = (free[lo : hi + 1] > 0) & (free[total - hi : total - lo + 1][::-1] > 0)
        if total % 2 == 0 and free[hi] < 2:
            ok[hi - lo] = False
        at = np.nonzero(ok)[0]
        return (total - lo - int(at[0]), lo + int(at[0])) if len(at) else None


class _Open:
    """Started containers by the gap they have left: per gap a list of [how many, lengths]."""

    def __init__(self, capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        self.held: dict[int, list[list]] = {}

    def put(self, gap: int, many: int, lengths: tuple) -> None:
        self.count[gap] += many
        self.held.setdefault(gap, []).append([many, lengths])

    def take(self, gap: int, most: int) -> tuple[int, tuple]:
        """Up to `most` alike containers with this gap."""
        kinds = self.held[gap]
        many, lengths = kinds[-1]
        used = min(many, most)
        if used == many:
            kinds.pop()
        else:
            kinds[-1][0] -= used
        self.count[gap] -= used
        return used, lengths


def _first(where: np.ndarray) -> int | None:
    k = int(where.argmax()) if len(where) else 0
    return k if len(where) and where[k] else None


def _complements(counts: np.ndarray, capacity: int, most: int) -> list[tuple[int, tuple]]:
    stock, started = _Sums(counts), _Open(capacity)
    for length in np.nonzero(counts)[0][::-1].tolist():
        while left := int(stock.n[length]):
            combination = None
            if started.count[length]:
                combination = (length, (length,))
            # an item that fills a started gap by itself is kept for that
            free = lambda x: int(stock.n[x] - started.count[x])
            # one more item: a gap of this length and another that is there
            if combination is None and most > 1:
                more = min(stock.top, capacity - length)
                gaps = started.count[length + 1 : capacity + 1] > 0
                ok = gaps[:more] & (stock.n[1 : more + 1] > started.count[1 : more + 1])
                if length <= more and free(length) < 2:
                    ok[length - 1] = False
                x = _first(ok[::-1])  # the longest first
                if x is not None:
                    x = more - x
                    combination = (length + x, (length, x))
            # two more items: a gap of this length and a sum of two that are there
            if combination is None and most > 2:
                more = min(len(stock.pairs) - 1, capacity - length)
                sums = np.nonzero(gaps[:more] & (stock.pairs[1 : more + 1] > 0))[0] + 1
                spare = stock.n - started.count[: stock.top + 1] if len(sums) else stock.n
                for total in sums[::-1].tolist():
                    two = stock.pair(total, spare)
                    # the length itself is spoken for once
                    if two and free(length) > two.count(length):
                        combination = (length + total, (length, *two))
                        break
            if combination:
                gap, items = combination
                need = {x: items.count(x) for x in items}
                there = free if len(items) > 1 else (lambda x: int(stock.n[x]))
                many, lengths = started.take(gap, min(there(x) // k for x, k in need.items()))
                for x, k in need.items():
                    stock.take(x, k * many)
                started.put(0, many, lengths + items)
                continue
            # no combination fills a gap exactly: the smallest gap the item fits in, as often as it goes in, else a new container
            at = _first(started.count[length:] > 0)
            gap = capacity if at is None else length + at
            each = min(gap // length, left)
            many, lengths = (left // each, ()) if at is None else started.take(gap, left // each)
            stock.take(length, each * many)
            started.put(gap - each * length, many, lengths + (length,) * each)
    return [(many, lengths) for kinds in started.held.values() for many, lengths in kinds]


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Containers as (how many alike, lengths in each), which use up all items of the histogram.

    counts[k] is the number of items of length k, 0 < k <= capacity. Lengths are served from the longest to the shortest, so
    big items find their place before small ones are spent. For the items of a length, combinations of one, two or
    three items (the length, and none, one or two that are still available) that fill the gap of a started container
    exactly are looked up: gaps are indexed by size, single lengths by availability, pair sums by an index that is
    kept as lengths run out, triples by the length plus that index. Alike containers are filled as often as the
    counts allow. What no combination fills goes into the smallest gap it fits in, or into a new container.

    Where that leaves more containers than the sum of lengths needs, combinations of one item alone are tried as well, and
    the fewest containers win: with these the rule is best-fit decreasing, so the result is never worse than that.
    Steps follow the number of distinct lengths, not of items, each a few vector operations over the capacity.
    """
    counts = np.asarray(counts)
    size = lambda made: sum(many for many, _ in made)
    made = _complements(counts, capacity, 3)
    if size(made) * capacity >= int(counts @ np.arange(len(counts))) + capacity:
        made = min(made, _complements(counts, capacity, 1), key=size)
    return made


def pack(items: DataFrame, key: str, size: str, specs: list[tuple[int, int]]) -> DataFrame:
    """Assign every item to containers of each capacity: rows (spec_id, key, piece, start, n_tokens, container).

    items: one row per key, size >= 0 (null counts as 0). specs: (spec_id, capacity), a handful. An item longer
    than the capacity, and only such an item, is split: full pieces fill containers of their own and the rest is
    packed like an item. Items of size 0 take no space and are spread over the containers (container 0 if there
    is no other). Containers are numbered from 0 per spec without holes.

    Scale: only the histogram of lengths, at most `capacity` rows per spec, comes to the driver; the packing is found on it.
    Items get their rank within their length from counts per (length, part) and a window on (length, part), with a
    part for every 200,000 items of the length, so a length with a third of all items is ranked in many tasks. The
    slots of a length (its containers, in the order of ranks) are an array, in which a rank finds its place by binary
    search; they are at most a few per distinct length.
    """
    spark = items.sparkSession
    sized = items.select(F.col(key).alias("_k"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    # the few specs are fixed by the caller: an array literal, no join
    each = F.array(*[F.struct(F.lit(int(a)).alias("spec_id"), F.lit(int(b)).cast("long").alias("cap")) for a, b in specs])
    x = sized.withColumn("_x", F.explode(each)).select(
        "_k",
        "_n",
        F.col("_x.spec_id").alias("spec_id"),
        F.col("_x.cap").alias("_cap"),
    )
    x = x.withColumn("_full", F.when(F.col("_n") > F.col("_cap"), F.expr("_n div _cap")).otherwise(F.lit(0).cast("long"))).withColumn(
        "_len", F.col("_n") - F.col("_full") * F.col("_cap")
    )
    hist = x.groupBy("spec_id", "_len").agg(F.count("*").alias("c"), F.sum("_full").alias("f")).toPandas()
    slots, first_free = [], {}
    for sid, cap in specs:
        h = hist[hist.spec_id == sid]
        counts = np.zeros(cap + 1, np.int64)
        counts[h["_len"].to_numpy(int)] = h["c"].to_numpy(int)
        counts[0] = 0
        at, rank = 0, np.zeros(cap + 1, np.int64)
        for many, lengths in pack_histogram(counts, cap):
            for length in lengths:
                slots.append((sid, length, int(rank[length]), at))
                rank[length] += many
            at += many
        first_free[sid] = (at, int(h["f"].sum()))
    # ranks within (spec, length): offset of the part plus place in it; the lengths are at most capacity rows a spec
    parts = pd.DataFrame({"spec_id": hist["spec_id"], "_len": hist["_len"], "_parts": hist["c"] // PART + 1})
    x = x.join(_side(spark, parts, "spec_id int, _len long, _parts long"), ["spec_id", "_len"])
    x = x.withColumn("_part", F.pmod(F.xxhash64("_k"), F.col("_parts"))).drop("_parts")
    per_part = x.groupBy("spec_id", "_len", "_part").agg(F.count("*").alias("_c"), F.sum("_full").alias("_f"))
    offset = per_part.withColumn("_o", F.sum("_c").over(W.partitionBy("spec_id", "_len").orderBy("_part")) - F.col("_c")).withColumn(
        "_fo", F.sum("_f").over(W.partitionBy("spec_id").orderBy("_len", "_part")) - F.col("_f")
    )
    place = W.partitionBy("spec_id", "_len", "_part").orderBy("_k")
    ranked = x.join(offset.select("spec_id", "_len", "_part", "_o", "_fo"), ["spec_id", "_len", "_part"]).select(
        "_k", "_n", "spec_id", "_cap", "_full", "_len",
        (F.row_number().over(place) - 1 + F.col("_o")).alias("_rank"),
        (F.sum("_full").over(place.rowsBetween(W.unboundedPreceding, -1))).alias("_before"),
        "_fo",
    )
    of_length: dict = {}
    for sid, length, start, container in slots:
        starts, containers = of_length.setdefault((sid, length), ([], []))
        starts.append(start)
        containers.append(container)
    table = pd.DataFrame([(*k, *v) for k, v in of_length.items()], columns=["spec_id", "_len", "r0", "at"])
    longest = max(map(len, table["r0"]), default=1)
    slot = _slot_of(F.col("_rank"), F.col("r0"), longest)
    normal = (
        ranked.where("_len > 0")
        .join(_side(spark, table, "spec_id int, _len long, r0 array<long>, at array<long>", len(slots)), ["spec_id", "_len"])
        .withColumn("_slot", slot)
        .select(
            "spec_id", F.col("_k").alias(key), F.col("_full").alias("piece"), (F.col("_full") * F.col("_cap")).alias("start"),
            F.col("_len").alias("n_tokens"), (F.element_at("at", F.col("_slot")) + F.col("_rank") - F.element_at("r0", F.col("_slot"))).alias("container"),
        )
    )
    free = F.element_at(F.map_from_arrays(F.array(*[F.lit(int(s)) for s in first_free]), F.array(*[F.lit(int(v[0])) for v in first_free.values()])), F.col("spec_id"))
    total = F.element_at(F.map_from_arrays(F.array(*[F.lit(int(s)) for s in first_free]), F.array(*[F.lit(int(sum(v))) for v in first_free.values()])), F.col("spec_id"))
    full = (
        ranked.where("_full > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
        .select(
            "spec_id", F.col("_k").alias(key), "piece", (F.col("piece") * F.col("_cap")).alias("start"), F.col("_cap").alias("n_tokens"),
            (free + F.col("_fo") + F.coalesce("_before", F.lit(0).cast("long")) + F.col("piece")).alias("container"),
        )
    )
    zero = x.where("_n = 0").select(
        "spec_id", F.col("_k").alias(key), F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64("_k"), F.greatest(total, F.lit(1)).cast("long")).alias("container"),
    )
    return normal.unionByName(full).unionByName(zero)


def _side(spark: SparkSession, pdf: pd.DataFrame, schema: str, size: int = 0) -> DataFrame:
    """A table made on the driver, whose size is known there, as a join side."""
    df = spark.createDataFrame(pdf, schema) if len(pdf) else spark.createDataFrame([], schema)
    return F.broadcast(df) if max(size, len(pdf)) <= MAX_BROADCAST_ROWS else df


def _slot_of(rank: Column, starts: Column, longest: int) -> Column:
    """The place (from 1) of the last start that is not above the rank: binary search by falling powers of two."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(longest, 1).bit_length()))])
    further = lambda at, step: (at + step <= F.size(starts)) & (F.get(starts, at + step - 1) <= rank)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
