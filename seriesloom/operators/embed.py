"""Features and embeddings of the window of values that precedes each row."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_name
from ..plans.series import Layout, by_size, measure, over_groups
from ..spec import SeriesSpec
from .anomaly import sorted_quantile
from .windows import fill_values, history_windows
from .prep import ensure_row_id


def least_observed(rows: int) -> int:
    return max(4, rows // 4)


@by_size
def filled_windows(df: DataFrame, spec: SeriesSpec, rows: int, least_windows: int, fill: str = "ffill", causal: bool = False, layout: Layout | None = None) -> DataFrame:
    """Prepare the shared input of all window packs.

    Adds ``_fill`` (the previous value, gaps filled), ``_obs`` (observed previous values in the window), and ``_use``:
    the window is complete, holds enough observations, and its series has at least ``least_windows`` such windows.
    """
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    shifted = over_groups(
        df, spec.keys, spec.order, lambda f, w: f.withColumn("_shift", F.lag(y, 1).over(w)), back=1, layout=layout
    )
    filled = fill_values(shifted, spec.with_target("_shift"), fill, causal, name="_fill", layout=layout)

    def build(frame, w):
        here = w.rowsBetween(-(rows - 1), 0)
        obs = F.count("_shift").over(here)
        return frame.withColumns({"_obs": obs, "_ok": (F.col("_pos") >= rows - 1) & (obs >= least_observed(rows))})

    marked = over_groups(filled, spec.keys, spec.order, build, back=rows, layout=layout)
    return over_groups(
        marked,
        spec.keys,
        spec.order,
        lambda f, _w: f.withColumn("_use", F.col("_ok") & (F.col("_usable") >= least_windows)),
        whole={"_usable": F.count_if("_ok")},
        layout=layout,
    ).drop("_ok")


@by_size
def window_summary(df: DataFrame, spec: SeriesSpec, rows: int = 32, least_windows: int = 20, fill: str = "ffill", name: str = "autogluon", layout: Layout | None = None) -> DataFrame:
    """Last, mean, std, min, max, median, IQR, energy, slope and missing share of the previous window."""
    layout = layout or measure(df, spec.keys)
    base = filled_windows(df, spec, rows, least_windows, fill, layout=layout)
    v = F.col("_fill")

    def build(frame, w):
        here = w.rowsBetween(-(rows - 1), 0)
        frame = frame.withColumn("_vals", F.sort_array(F.collect_list(v).over(here)))
        vals = F.col("_vals")
        raw = {
            "w_last": v,
            "w_mean": F.avg(v).over(here),
            "w_std": F.stddev_pop(v).over(here),
            "w_min": F.min(v).over(here),
            "w_max": F.max(v).over(here),
            "w_median": sorted_quantile(vals, 0.5),
            "w_iqr": sorted_quantile(vals, 0.75) - sorted_quantile(vals, 0.25),
            "w_abs_energy": F.sum(v * v).over(here),
            "w_slope": F.regr_slope(v, F.col("_pos").cast("double")).over(here),
            "w_missing_ratio": 1.0 - F.col("_obs") / F.lit(float(rows)),
        }
        return frame.withColumns({f"hist_{name}_raw_{k}": F.when(F.col("_use"), e) for k, e in raw.items()} | _missing(rows, name))

    return over_groups(base, spec.keys, spec.order, build, back=rows, layout=layout).drop("_shift", "_fill", "_obs", "_use", "_vals")


def _missing(rows: int, name: str) -> dict[str, Column]:
    seen = F.least(F.col("_pos") + 1, F.lit(rows))
    return {
        f"hist_{name}_missing_ratio": (seen - F.col("_obs")) / seen,
        f"hist_{name}_missing_flag": F.col("_shift").isNull().cast("double"),
    }


@by_size
def minimal_pack(df: DataFrame, spec: SeriesSpec, rows: int = 32, least_windows: int = 20, fill: str = "ffill", name: str = "tsfresh", layout: Layout | None = None) -> DataFrame:
    """The published minimal statistics set of the previous window."""
    layout = layout or measure(df, spec.keys)
    base = filled_windows(df, spec, rows, least_windows, fill, layout=layout)
    v = F.col("_fill")

    def build(frame, w):
        here = w.rowsBetween(-(rows - 1), 0)
        frame = frame.withColumn("_vals", F.sort_array(F.collect_list(v).over(here)))
        raw = {
            "sum_values": F.sum(v).over(here),
            "median": sorted_quantile(F.col("_vals"), 0.5),
            "mean": F.avg(v).over(here),
            "length": F.lit(float(rows)),
            "standard_deviation": F.stddev_pop(v).over(here),
            "variance": F.var_pop(v).over(here),
            "root_mean_square": F.sqrt(F.avg(v * v).over(here)),
            "maximum": F.max(v).over(here),
            "absolute_maximum": F.max(F.abs(v)).over(here),
            "minimum": F.min(v).over(here),
        }
        return frame.withColumns({f"hist_{name}_{k}": F.when(F.col("_use"), e) for k, e in raw.items()} | _missing(rows, name))

    return over_groups(base, spec.keys, spec.order, build, back=rows, layout=layout).drop("_shift", "_fill", "_obs", "_use", "_vals")


# --- statistical, temporal and spectral features of a batch of windows -----------------------------------------------


def _spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    return np.fft.rfftfreq(x.shape[1], 1.0 / fs), np.abs(np.fft.rfft(x, axis=1))


def _safe(a, b):
    return np.divide(a, b, out=np.zeros_like(np.asarray(a, float)), where=np.asarray(b) != 0)


def statistical_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    n = x.shape[1]
    mean, std, var = x.mean(1), x.std(1), x.var(1)
    med = np.median(x, axis=1)
    q75, q25 = np.percentile(x, [75, 25], axis=1)
    dev = x - mean[:, None]
    return {
        "Absolute energy": (x * x).sum(1),
        "Average power": (x * x).sum(1) / max((n - 1) / fs, 1e-12),
        "Interquartile range": q75 - q25,
        "Kurtosis": _safe((dev**4).mean(1), var**2) - 3.0,
        "Max": x.max(1),
        "Mean": mean,
        "Mean absolute deviation": np.abs(dev).mean(1),
        "Median": med,
        "Median absolute deviation": np.median(np.abs(x - med[:, None]), axis=1),
        "Min": x.min(1),
        "Peak to peak distance": x.max(1) - x.min(1),
        "Root mean square": np.sqrt((x * x).mean(1)),
        "Skewness": _safe((dev**3).mean(1), std**3),
        "Standard deviation": std,
        "Variance": var,
    }


def temporal_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    n = x.shape[1]
    t = np.arange(n) / fs
    d = np.diff(x, axis=1)
    energy = x * x
    inner = x[:, 1:-1]
    rising, falling = d[:, :-1] > 0, d[:, 1:] < 0
    tc = np.arange(n) - (n - 1) / 2.0
    return {
        "Area under the curve": (0.5 * np.abs(x[:, 1:] + x[:, :-1]) / fs).sum(1),
        "Autocorrelation": _safe(((x[:, 1:] - x.mean(1)[:, None]) * (x[:, :-1] - x.mean(1)[:, None])).sum(1), ((x - x.mean(1)[:, None]) ** 2).sum(1)),
        "Centroid": _safe((t * energy).sum(1), energy.sum(1)),
        "Mean absolute diff": np.abs(d).mean(1),
        "Mean diff": d.mean(1),
        "Median absolute diff": np.median(np.abs(d), axis=1),
        "Median diff": np.median(d, axis=1),
        "Negative turning points": (~rising & (d[:, 1:] > 0) & (d[:, :-1] < 0)).sum(1).astype(float),
        "Neighbourhood peaks": ((inner > x[:, :-2]) & (inner > x[:, 2:])).sum(1).astype(float),
        "Positive turning points": (rising & falling).sum(1).astype(float),
        "Signal distance": np.sqrt(1.0 + d * d).sum(1),
        "Slope": (x * tc).sum(1) / (tc * tc).sum(),
        "Sum absolute diff": np.abs(d).sum(1),
        "Zero crossing rate": (np.diff(np.sign(x), axis=1) != 0).sum(1).astype(float),
    }


def spectral_features(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    f, mag = _spectrum(x, fs)
    _, centred = _spectrum(x - x.mean(1)[:, None], fs)
    total = mag.sum(1)
    share = _safe(mag, total[:, None])
    centroid = (share * f).sum(1)
    off = f[None, :] - centroid[:, None]
    spread = np.sqrt((share * off**2).sum(1))
    power = centred**2
    p = _safe(power, power.sum(1)[:, None])
    logp = np.log2(p, out=np.zeros_like(p), where=p > 0)
    cum = np.cumsum(mag, axis=1)
    top = cum[:, -1:]
    k = np.arange(1, f.size)
    fc = f - f.mean()

    def first_at(part):
        return f[np.argmax(cum >= part * top, axis=1)]

    d = np.diff(mag, axis=1)
    ramp = np.linspace(0.0, 1.0, f.size)[None, :] * top
    return {
        "Fundamental frequency": f[np.argmax(centred, axis=1)],
        "Max power spectrum": power.max(1) / x.shape[1],
        "Maximum frequency": first_at(0.95),
        "Median frequency": first_at(0.5),
        "Spectral centroid": centroid,
        "Spectral decrease": _safe(((mag[:, 1:] - mag[:, :1]) / k).sum(1), mag[:, 1:].sum(1)),
        "Spectral distance": (ramp - cum).sum(1),
        "Spectral entropy": -(p * logp).sum(1) / np.log2(max(p.shape[1], 2)),
        "Spectral kurtosis": _safe((share * off**4).sum(1), spread**4),
        "Spectral positive turning points": ((d[:, :-1] > 0) & (d[:, 1:] < 0)).sum(1).astype(float),
        "Spectral roll-off": first_at(0.95),
        "Spectral roll-on": first_at(0.05),
        "Spectral skewness": _safe((share * off**3).sum(1), spread**3),
        "Spectral slope": _safe((mag * fc).sum(1), np.full(mag.shape[0], (fc * fc).sum())),
        "Spectral spread": spread,
    }


DOMAINS = {"statistical": statistical_features, "temporal": temporal_features, "spectral": spectral_features}


def domain_feature_names(domains=("statistical", "temporal", "spectral"), most: int | None = None) -> list[str]:
    probe = np.arange(8.0)[None, :]
    names = [n for d in domains if d in DOMAINS for n in DOMAINS[d](probe, 1.0)]
    return names if most is None else names[: max(1, int(most))]


@by_size
def domain_pack(df: DataFrame, spec: SeriesSpec, rows: int = 32, least_windows: int = 20, fill: str = "ffill", domains=("statistical", "temporal", "spectral"), most: int | None = None, fs: float = 1.0, name: str = "tsfel", layout: Layout | None = None) -> DataFrame:
    """Statistical, temporal and spectral features of the previous window, computed on Arrow batches of windows."""
    layout = layout or measure(df, spec.keys)
    base = filled_windows(df, spec, rows, least_windows, fill, layout=layout)
    wanted = domain_feature_names(domains, most)

    def build(frame, w):
        vals = F.collect_list("_fill").over(w.rowsBetween(-(rows - 1), 0))
        return frame.withColumns({"_vals": F.when(F.col("_use"), vals)} | _missing(rows, name))

    placed = over_groups(base, spec.keys, spec.order, build, back=rows, layout=layout)

    @F.pandas_udf("array<double>")
    def features(windows: pd.Series) -> pd.Series:
        out: list = [None] * len(windows)
        given = [i for i, v in enumerate(windows) if v is not None]
        if given:
            x = np.stack([windows.iloc[i] for i in given]).astype(float)
            table = {k: v for d in domains for k, v in DOMAINS[d](x, fs).items()}
            for i, row in zip(given, np.column_stack([table[n] for n in wanted])):
                out[i] = row
        return pd.Series(out, index=windows.index, dtype=object)

    scored = placed.withColumn("_feat", features("_vals"))
    cols = {f"hist_{name}_{feature_name(n)}": F.try_element_at("_feat", F.lit(i + 1)) for i, n in enumerate(wanted)}
    return scored.withColumns(cols).drop("_shift", "_fill", "_obs", "_use", "_vals", "_feat")


# --- embeddings --------------------------------------------------------------------------------------------------------


def prepare_windows(x: np.ndarray, fill: str = "zero", normalize: str = "zscore", least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fill and scale windows (NaN = missing). Returns the windows and which of them hold enough points."""
    if normalize not in ("zscore", "none"):
        raise ValueError(f"unsupported normalize method: {normalize}")
    seen = np.isfinite(x)
    if fill == "zero":
        values = np.where(seen, x, 0.0)
        if normalize == "zscore":
            n = np.maximum(seen.sum(1, keepdims=True), 1)
            mean = values.sum(1, keepdims=True) / n
            std = np.sqrt((np.where(seen, values - mean, 0.0) ** 2).sum(1, keepdims=True) / n)
            values = np.where(seen, (values - mean) / (std + 1e-6), 0.0)
        return values, seen.sum(1) >= least
    if fill not in ("ffill", "drop"):
        raise ValueError(f"unsupported fill method: {fill}")
    if fill == "ffill":
        frame = pd.DataFrame(x.T).ffill().bfill().fillna(0.0)
        rows = list(frame.to_numpy().T)
    else:
        rows = [r[m] for r, m in zip(x, seen)]
    out, keep = np.zeros_like(x, dtype=float), np.zeros(len(x), bool)
    for i, r in enumerate(rows):
        if r.size < least:
            continue
        keep[i] = True
        if normalize == "zscore" and r.size:
            spread = r.std()
            r = (r - r.mean()) / (spread if spread else 1.0)
        if r.size:
            out[i, -r.size :] = r
    return out, keep


def fit_width(e: np.ndarray, dim: int) -> np.ndarray:
    """Cut or zero pad vectors to ``dim`` entries."""
    return e[:, :dim] if e.shape[1] >= dim else np.pad(e, ((0, 0), (0, dim - e.shape[1])))


def harmonic_embedding(x: np.ndarray, dim: int) -> np.ndarray:
    """Level statistics and trend, then the mean products with sines and cosines of rising frequency."""
    n = x.shape[1]
    t = np.arange(n)
    tc = t - t.mean()
    level = [x.mean(1), x.std(1), x.min(1), x.max(1), np.median(x, axis=1), x[:, -1], (x * tc).sum(1) / ((tc * tc).sum() + 1e-6)]
    waves = np.arange(1, max(2, dim // 2 + 1))
    angle = 2.0 * np.pi * np.outer(waves, t) / max(n, 2)
    pairs = np.stack([x @ np.sin(angle).T / n, x @ np.cos(angle).T / n], axis=2).reshape(len(x), -1)
    return fit_width(np.column_stack([np.column_stack(level), pairs]), dim)


def projection_embedding(x: np.ndarray, dim: int, seed: int = 42) -> np.ndarray:
    """Scaled values, their Fourier parts and the gap mask, projected by a fixed-seed Gaussian matrix."""
    mask = np.isfinite(x).astype(float)
    v = np.where(mask > 0, x, 0.0)
    n = mask.sum(1, keepdims=True) + 1e-6
    dev = (v - v.sum(1, keepdims=True) / n) * mask
    z = dev / (np.sqrt((dev**2).sum(1, keepdims=True) / n) + 1e-6)
    wave = np.fft.rfft(z, axis=1)
    parts = np.concatenate([z, wave.real, wave.imag, mask], axis=1)
    matrix = np.random.RandomState(seed).normal(0.0, 1.0 / np.sqrt(parts.shape[1]), (parts.shape[1], dim))
    return parts @ matrix


def window_embeddings(
    df: DataFrame,
    spec: SeriesSpec,
    dim: int = 16,
    rows: int = 64,
    least: int = 4,
    kind: str = "harmonic",
    fill: str = "zero",
    normalize: str = "zscore",
    row_id: str | None = None,
    only: DataFrame | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """One ``embedding`` array per row with at least ``least`` observed previous values.

    ``only`` (a frame of ``loto_y_ts_row_id``) restricts the output after the windows are built, so histories stay whole.
    The array of doubles is kept until a sink asks for float columns (``explode_embedding``).
    """
    base = ensure_row_id(df, spec, row_id)
    layout = layout or measure(base, spec.keys)
    held = history_windows(base, spec, rows, "_win", layout)
    numbered = over_groups(held, spec.keys, spec.order, lambda f, _w: f.withColumn("y_idx", F.col("_pos").cast("int")), layout=layout)
    enough = F.size(F.filter("_win", lambda v: v.isNotNull())) >= least
    chosen = numbered.where(enough)
    if only is not None:
        chosen = chosen.join(only.select("loto_y_ts_row_id"), "loto_y_ts_row_id", "left_semi")

    @F.pandas_udf("array<double>")
    def encode(windows: pd.Series) -> pd.Series:
        x = np.array([np.array(w, dtype=float) for w in windows], dtype=float)
        if kind == "projection":
            return pd.Series(list(projection_embedding(x, dim)), index=windows.index)
        ready, _ = prepare_windows(x, fill, normalize, least)
        return pd.Series(list(harmonic_embedding(ready, dim)), index=windows.index)

    return chosen.select(
        "loto_y_ts_row_id", *spec.keys, spec.time_col, spec.target_col, "y_idx", encode("_win").alias("embedding")
    )


def embedding_counters(df: DataFrame, spec: SeriesSpec, rows: int = 64, least: int = 4, layout: Layout | None = None) -> DataFrame:
    """How many rows are embedded and how many are skipped for a short history."""
    held = history_windows(df, spec, rows, "_win", layout)
    n = F.size(F.filter("_win", lambda v: v.isNotNull()))
    return held.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(n >= least).alias("embedded"),
        F.count_if(n < least).alias("skipped_short"),
    )


def explode_embedding(df: DataFrame, dim: int, name: str, column: str = "embedding") -> DataFrame:
    """``hist_<name>_1..dim`` float columns for a wide sink."""
    cols = [F.get(column, F.lit(i)).cast("float").alias(f"hist_{name}_{i + 1}") for i in range(dim)]
    return df.select(*[c for c in df.columns if c != column], *cols)


def fit_dim(column: str, dim: int) -> Column:
    """Cut or zero pad an array column to ``dim`` floats."""
    v = F.col(column)
    pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(v), F.lit(0)))
    return F.slice(F.concat(v, pad), 1, dim)


def pool_vectors(df: DataFrame, keys, column: str = "embedding") -> DataFrame:
    """Mean vector per key, summed element by element so that no group is collected."""
    long = df.select(*keys, F.posexplode(column).alias("_i", "_v"))
    means = long.groupBy(*keys, "_i").agg(F.avg("_v").alias("_m"))
    packed = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda s: s["_m"]).alias(column))


def provenance(df: DataFrame, config: Mapping, model_name: str, model_version: str, dim: int) -> DataFrame:
    """Stamp every row with the settings that made it; the hash is over the sorted JSON of the settings."""
    digest = hashlib.sha256(json.dumps(dict(config), sort_keys=True, default=str).encode()).hexdigest()
    return df.withColumns(
        {
            "embedding_dim": F.lit(int(dim)),
            "model_name": F.lit(model_name),
            "model_version": F.lit(model_version),
            "config_hash": F.lit(digest),
            "created_at": F.current_timestamp(),
            "updated_at": F.current_timestamp(),
        }
    )
