"""Mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Hash uniforms are summed in so many cells per source to calibrate the rates.
CELLS = 4096


def _uniform(key: str, seed: int) -> Column:
    """A uniform number in [0, 1) from the key alone: the same on every run and executor."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: float, upto: int) -> np.ndarray:
    """P(X <= k) for k = 0 .. upto - 1; from logarithms, so that no rate is too large."""
    k = np.arange(upto)
    log_factorial = np.r_[0.0, np.cumsum(np.log(np.arange(1, upto)))] if upto else np.zeros(0)
    if rate <= 0:
        return np.ones(upto)
    return np.minimum(np.cumsum(np.exp(k * math.log(rate) - rate - log_factorial)), 1.0)


def _thresholds(cells: np.ndarray, cap: int, target: float) -> list[float]:
    """CDF values at which the replication count steps up, for the rate whose capped counts reach `target` tokens.

    cells: tokens per cell of the hash uniform. A document with uniform u is used once per value below u, so the
    total falls out of the tokens above each value; the rate is found by bisection.
    """
    whole = cells.sum()
    if target >= cap * whole:
        return [-1.0] * cap  # every document as often as allowed
    above = np.r_[whole - np.r_[0.0, np.cumsum(cells)]]
    edges = np.linspace(0, 1, len(cells) + 1)
    reached = lambda rate: sum(np.interp(c, edges, above) for c in poisson_cdf(rate, cap))
    lo, hi = 0.0, 1.0
    while reached(hi) < target:  # ends: with the rate all values fall to 0, and all documents count `cap` times
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if reached(mid) < target else (lo, mid)
    return poisson_cdf(hi, cap).tolist()


def mix(
    docs: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, float, int]], total: float | None = None, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): documents replicated so that each source holds its target share of all size units.

    docs: one row per key; size >= 0, null counts as 0 (such documents take no part, as do documents of sources
    without target or with a null source). targets: (source, share, max_repeats); a source with no documents
    can't be reached and is reported with share 0, the others keep their proportions. total: size of the
    mixture; by default the largest that no source limits, which uses the scarcest source max_repeats times. A larger
    total can't be had in these shares: the mixture is then the largest one, with a warning, and the report tells both.

    mixture: key, source, size, copy (1..max_repeats), shuffle_key, globally sorted by shuffle_key. report:
    source, target_share, reached_share, documents, copies, tokens, asked_tokens (the source's share of the total asked
    for), total_asked, total_reached, max_repeats, most_copies.

    The count of a document is the inverse of the Poisson distribution at its hash uniform, capped; the rate of
    each source is calibrated on its own hash uniforms (4096 sums per source reach the driver, for the sources
    of the targets only), so that the shares come out within a few documents and not only on average.
    """
    spark = docs.sparkSession
    caps = {s: int(m) for s, _, m in targets}
    x = docs.select(
        F.col(key).alias("_k"), F.col(source).alias("_s"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_n"), _uniform(key, seed).alias("_u")
    ).where((F.col("_n") > 0) & F.col("_s").isin(list(caps)))
    cell = F.least(F.floor(F.col("_u") * CELLS), F.lit(CELLS - 1)).cast("int")
    sums = x.groupBy("_s", cell.alias("_c")).agg(F.sum("_n").alias("n")).collect()  # <= targets * 4096 rows
    cells = {s: np.zeros(CELLS) for s in caps}
    for r in sums:
        cells[r["_s"]][r["_c"]] = r["n"]
    there = [(s, w, m) for s, w, m in targets if cells[s].sum() > 0 and w > 0 and m > 0]
    weight = sum(w for _, w, _ in there)
    most = min((m * cells[s].sum() * weight / w for s, w, m in there), default=0.0)
    asked = float(most if total is None else total)
    goal = min(asked, most)
    if goal < asked:
        warnings.warn(f"A total of {asked:.0f} was asked for, {goal:.0f} is the most that keeps the shares", stacklevel=2)
    steps = [(s, m, _thresholds(cells[s], m, goal * w / weight)) for s, w, m in there]
    table = spark.createDataFrame(steps, "_ts string, _cap int, _cdf array<double>")
    used = (
        x.join(table, F.col("_s") == F.col("_ts"))
        .withColumn("_times", F.size(F.filter("_cdf", lambda c: c < F.col("_u"))))
        .where("_times > 0")
    )
    mixture = (
        used.select(F.col("_k").alias(key), F.col("_s").alias(source), F.col("_n").alias(size), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"))
        .withColumn("shuffle_key", F.xxhash64(F.col(key), F.col("copy"), F.lit(seed + 1)))
        .orderBy("shuffle_key", key, "copy")
    )
    per = used.groupBy("_s").agg(
        F.count("*").alias("documents"), F.sum("_times").alias("copies"), F.sum(F.col("_n") * F.col("_times")).alias("tokens"), F.max("_times").alias("most_copies")
    )
    share = {s: w / weight for s, w, _ in there}
    want = [(s, float(w), int(m), asked * share.get(s, 0.0)) for s, w, m in targets]
    want = spark.createDataFrame(want, "source string, target_share double, max_repeats int, asked_tokens double")
    report = (
        want.join(per, F.col("source") == F.col("_s"), "left")
        .withColumn("_all", F.sum("tokens").over(W.partitionBy(F.lit(1))))  # one row per target
        .select(
            "source", "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("_all").cast("double")), F.lit(0.0)).alias("reached_share"),
            *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("documents", "copies", "tokens")], "asked_tokens",
            F.lit(asked).alias("total_asked"), F.coalesce(F.col("_all"), F.lit(0)).cast("long").alias("total_reached"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
    return mixture, report
