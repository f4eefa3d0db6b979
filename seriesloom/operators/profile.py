"""Matrix profile: the distance of every window to its nearest other window of the same series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.series import Layout, by_size, measure, over_groups
from ..spec import SeriesSpec
from .embed import filled_windows

#: Window starts in a block.
BLOCK = 8192


def _unit_windows(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """z-normalised windows scaled to unit length, and which windows are constant."""
    w = np.lib.stride_tricks.sliding_window_view(values, m)
    dev = w - w.mean(1, keepdims=True)
    size = np.sqrt((dev * dev).sum(1))
    flat = size <= 1e-12 * np.maximum(np.abs(w).max(1), 1.0)
    return dev / np.where(flat, 1.0, size)[:, None], flat


def tile_maxima(a: np.ndarray, b: np.ndarray | None, m: int, apart: int = 0, rows: int = 256, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The highest correlation of each window of ``a`` with one of ``b``, and the other way round.

    ``b`` begins ``apart`` values after ``a``; without it ``a`` is compared with itself, half of the pairs. Window starts less
    than ceil(m/4) apart don't count. Maxima run along while small parts of the tile are multiplied, so none is ever whole.
    """
    ua, fa = _unit_windows(a, m)
    ub, fb = (ua, fa) if b is None else _unit_windows(b, m)
    zone, flat = math.ceil(m / 4), bool(fa.any() or fb.any())
    best_a = np.full(len(ua), -np.inf)
    best_b = best_a if b is None else np.full(len(ub), -np.inf)
    for s in range(0, len(ua), rows):
        e = min(s + rows, len(ua))
        for t in range(0 if b is not None else s, len(ub), columns):
            f = min(t + columns, len(ub))
            c = ua[s:e] @ ub[t:f].T
            if flat:  # half way between equal and unrelated
                c[fa[s:e]] = 0.5
                c[:, fb[t:f]] = 0.5
                c[np.ix_(fa[s:e], fb[t:f])] = 1.0
            if apart + t - (e - 1) <= zone:
                gap = apart + np.arange(t, f)[None, :] - np.arange(s, e)[:, None]
                c[np.abs(gap) <= zone] = -np.inf
            high = c.max(0)
            best_a[s:e] = np.maximum(best_a[s:e], c.max(1))
            best_b[t:f] = np.maximum(best_b[t:f], high)
    return best_a, best_b


def nearest_window(df: DataFrame, keys: list[str], pos: str, value: str, m: int, block: int = BLOCK, count: Column | None = None) -> DataFrame:
    """(keys, start, distance) for every window of ``m`` consecutive values.

    The series is cut into blocks of ``block`` window starts (each with the m-1 values that follow). Every pair of blocks
    is one tile, of which one array of maxima for each block is left; the arrays of a block are combined element by element. The
    work is quadratic in the series by definition; the memory of a task is bounded by the blocks. ``count`` is a column with the
    number of values of the series, where it is known.
    """
    home = F.floor(F.col(pos) / block)
    spots = F.array_compact(F.array(home, F.when((F.col(pos) % block < m - 1) & (home > 0), home - 1)))
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if count is None else count
    cut = df.select(*keys, F.struct(F.col(pos).alias("p"), F.col(value).alias("v")).alias("_pv"), F.explode(spots).alias("_b"), F.floor((count - 1) / block).alias("_last"))
    # An array of at most block + m - 1 values per block.
    blocks = cut.groupBy(*keys, "_b", "_last").agg(F.sort_array(F.collect_list("_pv")).alias("_pv"))
    blocks = blocks.where(F.size("_pv") >= m).withColumn("_v", F.transform("_pv", lambda s: s["v"])).drop("_pv")
    spread = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    sides = F.sort_array(F.collect_list(F.struct("_b", "_v"))).alias("_sides")
    pairs = spread.groupBy(*keys, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")).agg(sides)

    def tiles(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                i, j = row.column("_i")[0].as_py(), row.column("_j")[0].as_py()
                values = [np.asarray(side["_v"].values, float) for side in row.column("_sides")[0]]
                if len(values) < 1 + (i != j):  # the last block may be shorter than a window
                    continue
                near, far = tile_maxima(values[0], values[1] if i != j else None, m, (j - i) * block)
                found = [near, far] if i != j else [near]
                same = [row.column(k).take(pa.array([0] * len(found))) for k in keys]
                yield pa.RecordBatch.from_arrays([*same, pa.array([i, j][: len(found)], pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))], names=[*keys, "_b", "_best"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    maxima = pairs.mapInArrow(tiles, f"{types}, _b long, _best array<double>")
    best = F.reduce(F.collect_list("_best"), F.lit(None).cast("array<double>"), lambda x, y: F.when(x.isNull(), y).otherwise(F.zip_with(x, y, lambda u, v: F.greatest(u, v))))
    merged = maxima.groupBy(*keys, "_b").agg(best.alias("_best"))
    long = merged.select(*keys, "_b", F.posexplode("_best").alias("_p", "_c"))
    infinite = F.lit(float("inf"))
    distance = F.when(F.col("_c") == -infinite, infinite).otherwise(F.sqrt(2.0 * m * (1.0 - F.least(F.greatest("_c", F.lit(-1.0)), F.lit(1.0)))))
    return long.select(*keys, (F.col("_b") * block + F.col("_p")).alias("_start"), distance.alias("_dist"))


@by_size
def matrix_profile(
    df: DataFrame,
    spec: SeriesSpec,
    rows: int = 32,
    least_windows: int = 20,
    fill: str = "ffill",
    quantile: float = 0.98,
    block: int = BLOCK,
    name: str = "stumpy",
    layout: Layout | None = None,
) -> DataFrame:
    """Profile score of the window that ends at the row, its expanding z-score and the discord flag."""
    layout = layout or measure(df, spec.keys)
    base = filled_windows(df, spec, rows, least_windows, fill, layout=layout)
    place = {"_at": F.col("_pos"), "_values": F.col("_all")}
    base = over_groups(base, spec.keys, spec.order, lambda f, _w: f.withColumns(place), whole={"_all": F.count(F.lit(1))}, layout=layout)
    near = nearest_window(base, spec.keys, "_at", "_fill", rows, block, F.col("_values"))
    base = base.drop("_values")
    near = near.withColumn("_at", F.col("_start") + (rows - 1)).where(F.col("_dist") < float("inf")).drop("_start")
    joined = base.join(near, [*spec.keys, "_at"], "left")
    score = F.when(F.col("_use"), F.col("_dist"))
    joined = joined.withColumn("_sc", score)
    out = f"hist_{name}_mp_score"

    def build(frame, _w):
        n, mean, m2 = F.col("_p_n"), F.col("_p_mean"), F.col("_p_m2")
        sd = F.when((n >= 5) & (m2 > 0), F.sqrt(m2 / n))
        enough = F.col("_scored") >= least_windows
        s = F.when(enough, F.col("_sc"))
        seen = F.least(F.col("_pos") + 1, F.lit(rows))
        return frame.withColumns(
            {
                out: s,
                f"hist_{name}_mp_zscore": (s - mean) / (sd + 1e-9),
                f"hist_{name}_missing_ratio": (seen - F.col("_obs")) / seen,
                f"hist_{name}_missing_flag": F.col("_shift").isNull().cast("double"),
            }
        )

    scored = over_groups(
        joined, spec.keys, spec.order, build, moments={"_p": F.col("_sc")}, whole={"_scored": F.count("_sc")}, layout=layout
    ).drop("_shift", "_fill", "_obs", "_use", "_dist", "_sc", "_at")
    return discord_flags(scored, spec, out, f"hist_{name}_discord_flag", quantile, least_windows, layout=layout)


def prefix_order(values: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each query the value at a place in the sorted order of the first so many values.

    The ranks of the values are sorted bit by bit, highest first, into zeros and ones (a wavelet matrix, one level at a time); every
    query follows its prefix down, and whether the value it wants lies among the zeros tells the next bit of its rank.
    """
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    low, high, place, found = np.zeros(len(lengths), np.int64), lengths.astype(np.int64), places.astype(np.int64), np.zeros(len(lengths), np.int64)
    for bit in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
        ones = (ranks >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        at_low, at_high = zeros[low], zeros[high]
        right = place >= at_high - at_low
        place = place - np.where(right, at_high - at_low, 0)
        found |= right.astype(np.int64) << bit
        low, high = np.where(right, zeros[-1] + low - at_low, at_low), np.where(right, zeros[-1] + high - at_high, at_high)
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return values[order[found]]


def _walk(scores: np.ndarray, held: np.ndarray, low: int, before: int, quantile: float, least: int) -> np.ndarray:
    """Flag each score against the quantile of the ``before`` earlier ones and those it follows here; ``held`` are the values of the
    earlier ones above the ``low`` smallest."""
    flags = np.full(len(scores), np.nan)
    n = before + np.arange(len(scores))
    at = np.flatnonzero(n >= max(least, 1))
    if not len(at):
        return flags
    values, n = np.concatenate([held, scores]), n[at]
    rank = quantile * (n - 1)
    lo = rank.astype(np.int64)
    a, b = (prefix_order(values, len(held) + at, np.minimum(k, n - 1) - low) for k in (lo, lo + 1))
    flags[at] = scores[at] >= a + (b - a) * (rank - lo)
    return flags


@by_size
def discord_flags(df: DataFrame, spec: SeriesSpec, score: str, name: str, quantile: float, least: int, layout: Layout | None = None) -> DataFrame:
    """Whether a score reaches the quantile of all earlier scores of its series.

    Ordinary series answer all their rows at once from the bits of the scores' ranks. Oversized ones are cut into time blocks; a block can only
    ever ask for order statistics within one block length of its starting rank, so it receives just that slice of the
    earlier scores, found through a table of counts per (value bucket, time block).
    """
    keys, order = spec.keys, spec.order
    layout = layout or measure(df, keys)
    empty = F.lit(None).cast("double")
    seen, unseen = df.where(F.col(score).isNotNull()), df.where(F.col(score).isNull()).withColumn(name, empty)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        flags = _walk(rows.column(score).to_numpy(), np.zeros(0), 0, 0, quantile, least)
        return rows.append_column(name, pa.array(flags))

    def plain(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).applyInArrow(whole, fields)

    out = plain(seen) if layout.plain else _blocked_flags(seen, spec, score, name, quantile, least, layout, fields)
    return out.unionByName(unseen).withColumn(name, F.nanvl(F.col(name), empty))


def _blocked_flags(df: DataFrame, spec: SeriesSpec, score: str, name: str, quantile: float, least: int, layout: Layout, fields: str) -> DataFrame:
    keys, order, size = spec.keys, spec.order, max(layout.limit // 4, 1)
    placed = over_groups(df, keys, order, lambda f, _w: f.withColumns({"_n": F.col("_pos"), "_tb": F.floor(F.col("_pos") / size)}), layout=layout, fresh=True)
    placed = over_groups(placed, keys, [score, *order], lambda f, _w: f.withColumn("_vb", F.floor(F.col("_pos") / size)), layout=layout)

    # Counts per value bucket and time block, one row per pair of blocks; then what precedes each time block.
    cells = placed.groupBy(*keys, "_vb", "_tb").agg(F.count(F.lit(1)).alias("_c"))
    grid = cells.select(*keys, "_tb").distinct().join(cells.select(*keys, "_vb").distinct(), keys)
    grid = grid.join(cells, [*keys, "_vb", "_tb"], "left").fillna(0, ["_c"])
    earlier = Window.partitionBy(*keys, "_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys, "_tb").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_m", F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    grid = grid.withColumn("_below", F.coalesce(F.sum("_m").over(lower), F.lit(0)))
    start = F.col("_tb") * size
    first = F.floor(quantile * (start - 1)) - size - 1
    last = F.floor(quantile * (start + size)) + 2
    need = grid.where((F.col("_m") > 0) & (F.col("_below") <= last) & (F.col("_below") + F.col("_m") > first))
    need = need.select(*keys, "_vb", F.col("_tb").alias("_b"), "_below")
    lows = need.groupBy(*keys, "_b").agg(F.min("_below").alias("_low"))
    values = placed.select(*keys, "_vb", "_tb", F.col(score).alias("_v")).join(need.drop("_below"), [*keys, "_vb"]).where(F.col("_tb") < F.col("_b"))
    slices = values.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list("_v")).alias("_slice")).join(lows, [*keys, "_b"])

    def block(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        values_ = np.array(held["_slice"].iloc[0], float) if len(held) else np.zeros(0)
        low = int(held["_low"].iloc[0]) if len(held) else 0
        flags = _walk(rows[score].to_numpy(float), values_, low, int(rows["_n"].iloc[0]), quantile, least) if len(rows) else []
        return rows.assign(**{name: flags}).drop(columns=["_n", "_tb", "_vb"])

    names = [f"_s{i}" for i in range(len(keys))]
    slices = slices.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_b", "_slice", "_low")
    return placed.groupBy(*keys, "_tb").cogroup(slices.groupBy(*names, "_b")).applyInPandas(block, fields)
