"""Implausible readings: robust principal components per source, constant runs and ranges beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelmill.session import let_workers_import

MAD = 1.4826


def robust_components(x: np.ndarray, seen: np.ndarray, floor: float, rounds: int = 8) -> np.ndarray:
    """Split each matrix of a stack x (sources, rows, columns) into low rank plus sparse; return where it is sparse.

    Alternating projections: a rank-one fit of what is left after the sparse part, then everything beyond 2.5
    robust deviations of the residuals goes into the sparse part. Entries not seen and sparse entries take the
    fitted value. The start is each row's median as a constant profile: from an unguarded least-squares start a
    lone spike in a flat matrix would itself be the first component. A constant matrix is rank one with an
    empty sparse part.
    """
    n, rows, cols = x.shape
    v = np.full((n, cols, 1), 1 / np.sqrt(cols))
    count = np.maximum(seen.sum((1, 2)), 1)
    per_row = np.sort(np.where(seen, x, np.inf), axis=2)
    mid = np.take_along_axis(per_row, np.maximum(seen.sum(2, keepdims=True) - 1, 0) // 2, axis=2)
    low = np.broadcast_to(np.where(np.isfinite(mid), mid, 0.0), x.shape)
    sparse = np.zeros_like(seen)
    for k in range(rounds):
        if k:
            m = np.where(seen & ~sparse, x, low)
            for _ in range(2):
                u = m @ v
                v = m.transpose(0, 2, 1) @ u
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.where(size > 1e-12, v / np.maximum(size, 1e-12), 1 / np.sqrt(cols))
            low = (m @ v) @ v.transpose(0, 2, 1)
        res = np.abs(np.where(seen, x - low, 0.0))
        flat = np.sort(np.where(seen, res, np.inf).reshape(n, -1), axis=1)
        med = flat[np.arange(n), np.minimum(count // 2, rows * cols - 1)]
        med = np.where(np.isfinite(med), med, 0.0)
        sparse = res > np.maximum(2.5 * MAD * med, floor)[:, None, None]
    return sparse


def _excursions(y: np.ndarray, cand: np.ndarray, longest: int, far: float, floor: float) -> np.ndarray:
    """Which readings of the log series y lie in an excursion of at most `longest` readings, holding a candidate,
    that leaves both neighbours by `far` usual moves and comes back to within a third of its height."""
    n = len(y)
    hit = np.zeros(n, bool)
    if n < 3 or not cand.any():
        return hit
    usual = MAD * np.median(np.abs(np.diff(y)))
    least = max(far * usual, floor)
    for length in range(1, longest + 1):
        if n < length + 2:
            break
        starts = np.arange(1, n - length)
        a, b = y[starts - 1], y[starts + length]
        run = np.stack([y[starts + j] for j in range(length)])
        up, down = run.min(0) - np.maximum(a, b), np.minimum(a, b) - run.max(0)
        dev = np.maximum(up, down)
        some = np.any([cand[starts + j] for j in range(length)], axis=0)
        ok = some & (dev >= least) & (dev > 3 * np.abs(a - b))
        for j in range(length):
            hit[starts[ok] + j] = True
    return hit


def flag_readings(
    df: DataFrame,
    source: str,
    date: str,
    fields: dict[str, dict],
    block: int = 10,
    far: float = 9.0,
    longest: int = 3,
) -> DataFrame:
    """Rows (source, date, field, reason, value) of the readings that can't be right for their source.

    df: at most one row per (source, date). fields: per field `signed` (the sign of a reading carries another
    meaning and is ignored), `ratio` (a reading that many times above or below the source's median is
    impossible), `floor` (least log deviation of a spike) and `run` (that many successive equal readings are
    stuck; all but the first are flagged; 0: no such test).

    Reasons: 'impossible' (zero, infinite, negative unless signed, beyond ratio), 'spike' (an excursion of at
    most `longest` readings that returns) and 'stuck'. Missing readings (null, NaN) are skipped, not flagged; a
    reading flagged as impossible is left out of the other tests. Lasting changes of level are not flagged.
    Sources with fewer than three usable readings get only the range test. Null sources or dates are dropped.

    Each source's usable log readings, in order, form a profile matrix of `block` columns per row, centred on the
    source's median. Robust principal components put sudden departures into the sparse part; these candidates
    are then checked for returning. Sources stream through sorted partitions in batches of Arrow columns; one
    source has at most one reading a day, so a source's array is bounded by its days.
    """
    names = list(fields)
    schema = T.StructType(
        [
            T.StructField(source, df.schema[source].dataType),
            T.StructField(date, df.schema[date].dataType),
            T.StructField("field", T.StringType()),
            T.StructField("reason", T.StringType()),
            T.StructField("value", T.DoubleType()),
        ]
    )
    cols = df.dropna(subset=[source, date]).select(source, date, *[df[f].cast("double").alias(f) for f in names])
    part = cols.repartition(source).sortWithinPartitions(source, date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 60_000:
                t = pa.concat_tables(held)
                key = t[source].to_numpy(zero_copy_only=False)
                cut = int(np.nonzero(key != key[-1])[0][-1]) + 1 if (key != key[-1]).any() else 0
                if cut:
                    yield from _flag(t.slice(0, cut), source, date, names, fields, block, far, longest)
                held, rows = [t.slice(cut)], t.num_rows - cut
        if held and rows:
            yield from _flag(pa.concat_tables(held), source, date, names, fields, block, far, longest)

    let_workers_import(df.sparkSession)
    return part.mapInArrow(run, schema)


def _flag(t: pa.Table, source: str, date: str, names: list, fields: dict, block: int, far: float, longest: int) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    key = t[source].to_numpy(zero_copy_only=False)
    start = np.r_[0, np.nonzero(key[1:] != key[:-1])[0] + 1, len(key)]
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    at_all, field_all, reason_all, value_all = [], [], [], []

    def add(at, name, reason, vals):
        if len(at):
            at_all.append(at)
            field_all.extend([name] * len(at))
            reason_all.extend([reason] * len(at))
            value_all.append(vals)

    for name in names:
        o = fields[name]
        raw = t[name].to_numpy(zero_copy_only=False).astype(float)
        there = ~np.isnan(raw)
        size = np.abs(raw) if o["signed"] else raw
        bad = there & ((size <= 0) | np.isinf(size))
        good = np.nonzero(there & ~bad)[0]
        logs = np.log(size[good])
        med = pd.Series(logs).groupby(owner[good]).median()
        centre = np.zeros(len(start) - 1)
        centre[med.index.to_numpy()] = med.to_numpy()
        y = logs - centre[owner[good]]
        wild = np.abs(y) > np.log(o["ratio"])
        bad[good[wild]] = True
        add(np.nonzero(bad)[0], name, "impossible", raw[bad])
        good, y = good[~wild], y[~wild]
        if not len(good):
            continue
        own = owner[good]
        first = np.r_[0, np.nonzero(own[1:] != own[:-1])[0] + 1]
        length = np.diff(np.r_[first, len(own)])
        # constant runs, by the readings themselves
        if o["run"]:
            s = size[good]
            new = np.r_[True, (s[1:] != s[:-1]) | (own[1:] != own[:-1])]
            head = np.nonzero(new)[0]
            runs = np.diff(np.r_[head, len(s)])
            stuck = np.repeat(runs >= o["run"], runs) & ~new
            add(good[stuck], name, "stuck", raw[good[stuck]])
        # profile matrices of the sources whose readings vary, all of one call stacked
        vary = np.nonzero((length >= 3) & (np.maximum.reduceat(y, first) > np.minimum.reduceat(y, first)))[0]
        for some in np.array_split(vary, max(1, len(vary) // 256)):
            if not len(some):
                continue
            deep = int(-(-length[some].max() // block))
            x = np.zeros((len(some), deep, block))
            seen = np.zeros(x.shape, bool)
            at = np.zeros(x.shape, int)
            for i, k in enumerate(some):
                n = length[k]
                # the last row overlaps the one before rather than being short, where a spike could be its majority
                begin = np.minimum(np.arange(0, n, block), max(n - block, 0))
                place = begin[:, None] + np.arange(block)
                seen[i, : len(begin)] = place < n
                at[i, : len(begin)] = np.minimum(place, n - 1)
                x[i, : len(begin)] = y[first[k] + at[i, : len(begin)]]
            found = robust_components(x, seen, o["floor"] / 2)
            sparse = np.zeros((len(some), int(length[some].max())), bool)
            which, *cell = np.nonzero(found)
            sparse[which, at[(which, *cell)]] = True
            for i, k in enumerate(some):
                if sparse[i].any():
                    lo, n = first[k], length[k]
                    hit = _excursions(y[lo : lo + n], sparse[i, :n], longest, far, o["floor"])
                    add(good[lo : lo + n][hit], name, "spike", raw[good[lo : lo + n][hit]])
    if at_all:
        at = pa.array(np.concatenate(at_all))
        yield pa.RecordBatch.from_arrays(
            [t[source].combine_chunks().take(at), t[date].combine_chunks().take(at), pa.array(field_all, pa.string()), pa.array(reason_all, pa.string()), pa.array(np.concatenate(value_all), pa.float64())],
            names=[source, date, "field", "reason", "value"],
        )
