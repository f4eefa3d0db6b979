"""History features of a stream from kept state: a batch reads its own rows only.

The state of a series is of fixed size: the last rows that any window reaches, the running moments, the exponentially weighted
levels, and the place in the order up to which rows were seen. Rows at or before that place are dropped, so a replay adds
nothing. With rows that arrive in order the output equals ``history_features`` over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.windows import DIFFS, EWM_SPANS, HISTORY_REACH, LAGS, MEAN_WINDOWS, RANGE_WINDOWS, STD_WINDOWS
from ..spec import SeriesSpec

NAMES = [
    *[f"hist_lag_{k}" for k in LAGS],
    *[f"hist_diff_{k}" for k in DIFFS],
    *[f"hist_roll_mean_{n}" for n in MEAN_WINDOWS],
    *[f"hist_roll_std_{n}" for n in STD_WINDOWS],
    *[f"hist_roll_{f}_{n}" for n in RANGE_WINDOWS for f in ("min", "max")],
    *[f"hist_ewm_mean_{s}" for s in EWM_SPANS],
    "hist_expanding_mean",
    "hist_expanding_std",
]


def _moments(y: np.ndarray, n: int, mean: float, m2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations before each value and after the last one; NaN values don't count."""
    known = ~np.isnan(y)
    centre = mean if n else (float(y[known][0]) if known.any() else 0.0)
    d = np.where(known, y - centre, 0.0)
    count = n + np.concatenate([[0], np.cumsum(known)])
    first, second = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    with np.errstate(invalid="ignore", divide="ignore"):
        return count, np.where(count > 0, centre + first / count, np.nan), np.where(count > 0, np.maximum(m2 + second - first * first / count, 0.0), 0.0)


def _levels(y: np.ndarray, span: int, level: float, gap: int) -> tuple[np.ndarray, float, int]:
    """The level before each value, and the last level and how many rows ago it was set."""
    a, out = 2.0 / (span + 1.0), np.full(len(y), np.nan)
    for i, v in enumerate(y.tolist()):
        out[i] = level
        gap += 1
        if v == v:
            level = v if level != level else level + a / ((1.0 - a) ** gap + a) * (v - level)
            gap = 0
    return out, level, gap


def pack(y: np.ndarray, past: np.ndarray) -> dict[str, np.ndarray]:
    """Lags, differences and rolling statistics of each value from the values before it; ``past`` are the ones before the first."""
    whole = np.concatenate([np.full(HISTORY_REACH, np.nan), past, y])
    at = HISTORY_REACH + len(past) + np.arange(len(y))
    out = {f"hist_lag_{k}": whole[at - k] for k in LAGS}
    out |= {f"hist_diff_{k}": y - whole[at - k] for k in DIFFS}

    def before(rows: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(whole, rows)[at - rows]

    out |= {f"hist_roll_mean_{n}": before(n).mean(1) for n in MEAN_WINDOWS}
    out |= {f"hist_roll_std_{n}": before(n).std(1, ddof=1) for n in STD_WINDOWS}
    for n in RANGE_WINDOWS:
        out |= {f"hist_roll_min_{n}": before(n).min(1), f"hist_roll_max_{n}": before(n).max(1)}
    return out


def history_stream(stream: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The series' key, order and target columns and the history features, of every new row.

    A task holds one series' rows of one batch: bound them by the source's rows or files a trigger.
    """
    keys, order, target = list(spec.keys), list(spec.order), spec.target_col
    rows = stream.select(*keys, *order, target)
    kinds = {f.name: f for f in rows.schema.fields}
    output = T.StructType([*(kinds[c] for c in [*keys, *order]), T.StructField(target, T.DoubleType()), *(T.StructField(n, T.DoubleType()) for n in NAMES)])
    kept = T.StructType([*(T.StructField(f"last_{i}", kinds[c].dataType) for i, c in enumerate(order)), T.StructField("past", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())])
    kept = T.StructType([*kept.fields, *(f for s in EWM_SPANS for f in (T.StructField(f"level_{s}", T.DoubleType()), T.StructField(f"gap_{s}", T.LongType())))])

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values(order, kind="stable")
        old = dict(zip(kept.names, state.get, strict=True)) if state.exists else None
        if old:
            last = tuple(pd.Timestamp(old[f"last_{i}"]) if isinstance(kinds[c].dataType, (T.TimestampType, T.TimestampNTZType)) else old[f"last_{i}"] for i, c in enumerate(order))
            new = new[[tuple(r) > last for r in new[order].itertuples(index=False, name=None)]]
        if not len(new):
            return
        y = new[target].to_numpy(dtype=float, na_value=np.nan)
        past = np.array(old["past"] if old else [], float)
        count, mean, m2 = _moments(y, old["n"] if old else 0, old["mean"] if old else 0.0, old["m2"] if old else 0.0)
        found = pack(y, past)
        held: list = []
        for s in EWM_SPANS:
            found[f"hist_ewm_mean_{s}"], level, gap = _levels(y, s, old[f"level_{s}"] if old else np.nan, old[f"gap_{s}"] if old else 0)
            held += [float(level), int(gap)]
        with np.errstate(invalid="ignore", divide="ignore"):
            found["hist_expanding_mean"] = mean[:-1]
            found["hist_expanding_std"] = np.where(count[:-1] > 1, np.sqrt(m2[:-1] / (count[:-1] - 1)), np.nan)
        ends = [v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in new[order].iloc[-1]]
        state.update((*ends, np.concatenate([past, y])[-HISTORY_REACH:].tolist(), int(count[-1]), float(mean[-1]) if count[-1] else 0.0, float(m2[-1]), *held))
        out = new[order].reset_index(drop=True)
        for i, k in enumerate(keys):
            out.insert(i, k, [key[i]] * len(out))
        out[target] = y
        for n in NAMES:
            out[n] = found[n]
        yield out

    return rows.groupBy(*keys).applyInPandasWithState(advance, output, kept, "append", "NoTimeout")
