"""Forecasting surface: a registry of per-series models, baselines, backtests and holdout evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.histories import History
from ..plans.series import BROADCAST_ROWS, Layout, attach, measure, over_groups
from ..spec import SeriesSpec
from .calendar import FREQUENCIES, future_frame
from .metrics import accuracy, step_accuracy
from .stats import adf, diebold_mariano_hac, ljung_box
from .windows import tail_split

FitPredict = Callable[[np.ndarray, int, Mapping], np.ndarray]


#: Reach of a model that sees every value.
WHOLE = (1 << 31) - 1


@dataclass(frozen=True)
class Totals:
    """How a model follows from sums over all rows of a history, so that no history is ever collected.

    Values are centred and scaled per series. ``columns(params, y, lags, age)`` gives the columns to be summed over a stretch of
    rows; ``age`` counts the rows up to the stretch's last one, ``lags[k]`` is NULL where the series has not begun. ``predict``
    takes the last ``lags(params)`` values (one at least), the sums of every stretch, and how many rows before the cutoff each ends.
    """

    lags: Callable[[Mapping], int]
    columns: Callable[[Mapping, Column, Sequence[Column], Column], list[Column]]
    predict: Callable[[np.ndarray, np.ndarray, np.ndarray, int, Mapping], np.ndarray]


@dataclass(frozen=True)
class Family:
    """How all settings of a model are answered from one ``History`` of a series.

    ``lags(params)`` and ``rates(params)`` say which products and decayed sums the history must hold for a setting.
    """

    lags: Callable[[Mapping], int]
    rates: Callable[[Mapping], Sequence[float]]
    predict: Callable[[History, int, Mapping], np.ndarray]


@dataclass(frozen=True)
class Model:
    """A forecaster that needs at most the last ``reach(params, h)`` values of a series.

    A model with ``totals`` (one setting over many cutoffs) and ``family`` (many settings at one cutoff) sees the whole history unless
    its parameter ``window`` is given.
    """

    name: str
    defaults: Mapping
    reach: Callable[[Mapping, int], int]
    predict: FitPredict
    totals: Totals | None = None
    family: Family | None = None

    def whole(self, params: Mapping) -> bool:
        return self.totals is not None and params.get("window") is None

    def validate(self, params: Mapping | None) -> dict:
        params = dict(params or {})
        unknown = [k for k in params if k not in self.defaults]
        if unknown:
            raise ValueError(f"unknown parameters for {self.name}: {unknown}")
        return {**self.defaults, **params}


_MODELS: dict[str, Model] = {}


def register_model(model: Model) -> Model:
    _MODELS[model.name] = model
    return model


def list_models() -> list[str]:
    return sorted(_MODELS)


def get_model(name: str) -> Model:
    try:
        return _MODELS[name]
    except KeyError:
        raise ValueError(f"unknown model: {name}") from None


def _window_mean(y: np.ndarray, h: int, p: Mapping) -> np.ndarray:
    return np.full(h, np.mean(y[-int(p["window"]) :]))


def _seasonal(y: np.ndarray, h: int, p: Mapping) -> np.ndarray:
    season = y[-int(p["season"]) :]
    return np.resize(season, h)


def _drift(y: np.ndarray, h: int, p: Mapping) -> np.ndarray:
    y = y[-int(p["window"]) :]
    slope = (y[-1] - y[0]) / max(len(y) - 1, 1)
    return y[-1] + slope * np.arange(1, h + 1)


def _smoothing(y: np.ndarray, h: int, p: Mapping) -> np.ndarray:
    a = float(p["alpha"])
    level = y[0]
    for v in y[1:]:
        level = (1 - a) * level + a * v
    return np.full(h, level)


def _autoregression(y: np.ndarray, h: int, p: Mapping) -> np.ndarray:
    k = int(p["order"])
    if len(y) < 2 * k + 2:
        return np.full(h, y[-1])
    rows = np.lib.stride_tricks.sliding_window_view(y, k + 1)
    x = np.column_stack([np.ones(len(rows)), rows[:, :-1]])
    beta, *_ = np.linalg.lstsq(x, rows[:, -1], rcond=None)
    held = list(y[-k:])
    for _ in range(h):
        held.append(float(beta[0] + beta[1:] @ np.array(held[-k:])))
    return np.array(held[k:])


def _smoothing_columns(p: Mapping, y: Column, lags: Sequence[Column], age: Column) -> list[Column]:
    a = float(p["alpha"])
    share = F.when(lags[1].isNull(), 1.0).otherwise(a)
    return [share * F.pow(F.lit(1.0 - a), age) * y]


def _smoothing_totals(recent: np.ndarray, sums: np.ndarray, ages: np.ndarray, h: int, p: Mapping) -> np.ndarray:
    return np.full(h, float((1.0 - float(p["alpha"])) ** ages @ sums[:, 0]))


def _autoregression_columns(p: Mapping, y: Column, lags: Sequence[Column], age: Column) -> list[Column]:
    """The upper triangle of the products of (1, lags from far to near, y)."""
    k = int(p["order"])
    terms = [F.lit(1.0), *[lags[i] for i in range(k, 0, -1)], y]
    full = lags[k].isNotNull()
    return [F.when(full, terms[i] * terms[j]).otherwise(0.0) for i in range(k + 2) for j in range(i, k + 2)]


def _autoregression_totals(recent: np.ndarray, sums: np.ndarray, ages: np.ndarray, h: int, p: Mapping) -> np.ndarray:
    k = int(p["order"])
    gram = np.zeros((k + 2, k + 2))
    gram[np.triu_indices(k + 2)] = sums.sum(axis=0)
    gram = np.triu(gram) + np.triu(gram, 1).T
    if gram[0, 0] < k + 2:
        return np.full(h, recent[-1])
    beta = np.linalg.pinv(gram[:-1, :-1], rcond=1e-12, hermitian=True) @ gram[:-1, -1]
    held = list(recent[-k:])
    for _ in range(h):
        held.append(float(beta[0] + beta[1:] @ np.array(held[-k:])))
    return np.array(held[k:])


def _smoothing_family(past: History, h: int, p: Mapping) -> np.ndarray:
    a = float(p["alpha"])
    level = a * past.decayed[1.0 - a] + (1.0 - a) ** past.n * past.first[0]
    return np.full(h, past.center + past.scale * level)


def _autoregression_family(past: History, h: int, p: Mapping) -> np.ndarray:
    k = int(p["order"])
    if past.n < 2 * k + 2:
        return np.full(h, past.center + past.scale * past.last[0])
    cross = past.cross(k)
    beta = np.linalg.pinv(cross[:-1, :-1], rcond=1e-12, hermitian=True) @ cross[:-1, -1]
    held = past.last[:k][::-1].tolist()
    for _ in range(h):
        held.append(float(beta[0] + beta[1:] @ np.array(held[len(held) - k :])))
    return past.center + past.scale * np.array(held[k:])


def _windowed(predict: FitPredict) -> FitPredict:
    return lambda y, h, p: predict(y if p["window"] is None else y[-int(p["window"]) :], h, p)


def _window_or_whole(p: Mapping, h: int) -> int:
    return WHOLE if p["window"] is None else int(p["window"])


register_model(Model("naive", {}, lambda p, h: 1, lambda y, h, p: np.full(h, y[-1])))
register_model(Model("window_mean", {"window": 7}, lambda p, h: int(p["window"]), _window_mean))
register_model(Model("seasonal_naive", {"season": 7}, lambda p, h: int(p["season"]), _seasonal))
register_model(Model("drift", {"window": 28}, lambda p, h: int(p["window"]), _drift))
register_model(
    Model(
        "smoothing",
        {"alpha": 0.3, "window": None},
        _window_or_whole,
        _windowed(_smoothing),
        Totals(lambda p: 1, _smoothing_columns, _smoothing_totals),
        Family(lambda p: 1, lambda p: [1.0 - float(p["alpha"])], _smoothing_family),
    )
)
register_model(
    Model(
        "autoregression",
        {"order": 3, "window": None},
        _window_or_whole,
        _windowed(_autoregression),
        Totals(lambda p: int(p["order"]), _autoregression_columns, _autoregression_totals),
        Family(lambda p: int(p["order"]), lambda p: [], _autoregression_family),
    )
)


def naive_last(df: DataFrame, spec: SeriesSpec, h: int, freq: str = "D", name: str = "yhat") -> DataFrame:
    """The last observed value copied ``h`` steps ahead."""
    seen = df.where(F.col(spec.target_col).isNotNull())
    last = seen.groupBy(*spec.keys).agg(F.max_by(spec.target_col, spec.order_struct()).alias(name))
    return future_frame(df, h, freq, id_col=spec.keys, time_col=spec.time_col).join(last, spec.keys)


def recent_values(df: DataFrame, spec: SeriesSpec, most: int, name: str = "_recent") -> DataFrame:
    """The last ``most`` observed values per series in time order, and the last time. Bounded by ``most`` per series."""
    from pyspark.sql import Window

    w = Window.partitionBy(*spec.keys).orderBy(*[F.col(c).desc() for c in spec.order])
    seen = df.where(F.col(spec.target_col).isNotNull())
    head = seen.select(*spec.keys, *spec.order, spec.target_col).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    out = head.groupBy(*spec.keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("_k"), F.col(spec.target_col).alias("v")))).alias("_s")
    )
    last = df.groupBy(*spec.keys).agg(F.max(spec.time_col).alias("_last"))
    return attach(out.withColumn(name, F.transform("_s", lambda s: s["v"])).drop("_s"), last, spec.keys, BROADCAST_ROWS + 1)


def _runner(m: Model, p: Mapping, h: int):
    """Arrow function from arrays of past values to arrays of ``h`` predictions."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([m.predict(np.array(v, float), h, p) for v in values], index=values.index)

    return run


def _totals_runner(m: Model, p: Mapping, h: int, step: int):
    """Arrow function from the last values, the cutoff's turn and a series' sums to arrays of ``h`` predictions."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, turn: pd.Series, bins: pd.Series, sums: pd.Series, center: pd.Series, scale: pd.Series) -> pd.Series:
        out = []
        for v, t, b, s, c, d in zip(values, turn, bins, sums, center, scale):
            later = np.array(b, np.int64) - int(t)
            held = np.array([np.array(x, float) for x in s])[later >= 0]
            out.append(c + d * m.totals.predict((np.array(v, float) - c) / d, held, later[later >= 0] * step, h, p))
        return pd.Series(out, index=values.index)

    return run


def _sums(seen: DataFrame, spec: SeriesSpec, models: Mapping[str, tuple[Model, Mapping]], h: int, step: int, windows: int, layout: Layout) -> DataFrame:
    """Per series and model the sums over the rows between two cutoffs; all older rows belong to the oldest cutoff."""
    most = max(max(m.totals.lags(p), 1) for m, p in models.values())
    y = F.col(spec.target_col).cast("double")
    from_end = F.col("_n") - 1 - F.col("_pos")

    def build(frame, w):
        turn = F.least(F.floor((from_end - h) / step), F.lit(windows - 1)).cast("int")
        scale = F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1.0)
        z = (y - F.col("_center")) / scale
        frame = frame.withColumns({"_turn": turn, "_age": from_end - h - turn * step, "_z": z, "_old": from_end >= h, "_c": F.col("_center"), "_d": scale})
        return frame.withColumns({f"_z{k}": F.lag("_z", k).over(w) for k in range(1, most + 1)})

    whole = {"_n": F.count(F.lit(1)), "_center": F.avg(y), "_scale": F.stddev_pop(y)}
    rows = over_groups(seen, spec.keys, spec.order, build, back=most, whole=whole, layout=layout, fresh=True).where("_old")
    lags = [F.col("_z"), *[F.col(f"_z{k}") for k in range(1, most + 1)]]
    terms = {n: m.totals.columns(p, F.col("_z"), lags, F.col("_age")) for n, (m, p) in models.items()}
    totals = [F.array(*[F.sum(c) for c in columns]).alias(f"_t_{n}") for n, columns in terms.items()]
    parts = rows.groupBy(*spec.keys, "_turn").agg(F.first("_c").alias("_c"), F.first("_d").alias("_d"), *totals)
    held = F.sort_array(F.collect_list(F.struct("_turn", *[f"_t_{n}" for n in terms])))
    out = parts.groupBy(*spec.keys).agg(F.first("_c").alias("_center"), F.first("_d").alias("_scale"), held.alias("_held"))
    return out.select(*spec.keys, "_center", "_scale", F.col("_held")["_turn"].alias("_bins"), *[F.col("_held")[f"_t_{n}"].alias(f"_t_{n}") for n in terms])


def forecast(df: DataFrame, spec: SeriesSpec, model: str, h: int, freq: str = "D", params: Mapping | None = None, name: str = "yhat") -> DataFrame:
    """``h`` future rows per series from a registered model."""
    m = get_model(model)
    p = m.validate(params)
    if m.whole(p):
        seen = df.where(F.col(spec.target_col).isNotNull())
        recent = recent_values(df, spec, max(1, m.totals.lags(p)))
        recent = attach(recent, _sums(seen, spec, {"m": (m, p)}, 0, 1, 1, measure(df, spec.keys)), spec.keys, BROADCAST_ROWS + 1)
        values = _totals_runner(m, p, h, 1)("_recent", F.lit(0), "_bins", "_t_m", "_center", "_scale")
    else:
        recent = recent_values(df, spec, max(1, m.reach(p, h)))
        values = _runner(m, p, h)("_recent")

    steps = recent.select(*spec.keys, "_last", F.posexplode(values).alias("_i", name))
    time = F.expr(f"_last + (_i + 1) * {FREQUENCIES[freq]}")
    return steps.select(*spec.keys, time.alias(spec.time_col), (F.col("_i") + 1).alias("step"), name)


def cross_validation(df: DataFrame, spec: SeriesSpec, models: Mapping[str, Mapping | None], h: int, windows: int = 1, step: int | None = None, layout: Layout | None = None) -> DataFrame:
    """Rolling-origin backtest: for every cutoff row, each model sees the values up to it and predicts the next ``h`` rows.

    Cutoffs lie ``h``, ``h + step``, ... rows before the end of the series. A cutoff row carries the few last values its
    models need and the ``h`` actual values behind it; models of the whole history get sums over all rows up to the cutoff. So
    series of any length are cut into blocks like every other frame.
    """
    step = step or h
    ready = {n: (get_model(n), get_model(n).validate(p)) for n, p in models.items()}
    whole = {n: (m, p) for n, (m, p) in ready.items() if m.whole(p)}
    reach = max(max(m.totals.lags(p), 1) if n in whole else m.reach(p, h) for n, (m, p) in ready.items())
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    seen = df.where(y.isNotNull())
    from_end = F.col("_n") - 1 - F.col("_pos")

    def build(frame, w):
        turn = F.floor((from_end - h) / step)
        is_cut = (from_end >= h) & ((from_end - h) % step == 0) & (turn < windows)
        past = F.collect_list(y).over(w.rowsBetween(-(reach - 1), 0))
        ahead = F.collect_list(F.struct(F.col(spec.time_col).alias("t"), y.alias("v"))).over(w.rowsBetween(1, h))
        return frame.withColumns({"_past": F.when(is_cut, past), "_ahead": F.when(is_cut, ahead), "_turn": turn})

    cut = over_groups(seen, spec.keys, spec.order, build, back=reach, ahead=h, whole={"_n": F.count(F.lit(1))}, layout=layout, fresh=True)
    cut = cut.where(F.col("_past").isNotNull()).select(*spec.keys, F.col(spec.time_col).alias("cutoff"), "_past", "_ahead", "_turn")
    if whole:
        cut = attach(cut, _sums(seen, spec, whole, h, step, windows, layout), spec.keys, BROADCAST_ROWS + 1)

    def predicted(n: str, m: Model, p: Mapping) -> Column:
        return _totals_runner(m, p, h, step)("_past", "_turn", "_bins", f"_t_{n}", "_center", "_scale") if n in whole else _runner(m, p, h)("_past")

    outs = [predicted(n, m, p).alias(f"_f_{n}") for n, (m, p) in ready.items()]
    rows = cut.select(*spec.keys, "cutoff", "_ahead", *outs)
    zipped = F.posexplode("_ahead").alias("_i", "_a")
    long = rows.select(*spec.keys, "cutoff", *[f"_f_{n}" for n in ready], zipped)
    preds = [F.get(F.col(f"_f_{n}"), F.col("_i")).alias(n) for n in ready]
    return long.select(*spec.keys, "cutoff", F.col("_a.t").alias(spec.time_col), (F.col("_i") + 1).alias("step"), F.col("_a.v").alias(spec.target_col), *preds)


def holdout(df: DataFrame, spec: SeriesSpec, model: str, h: int, freq: str = "D", params: Mapping | None = None) -> DataFrame:
    """Forecast from everything but the last ``h`` rows, joined to the actual values by time."""
    marked = tail_split(df, spec, h)
    train = marked.where(~F.col("is_test")).drop("is_test")
    guess = forecast(train, spec, model, h, freq, params)
    return df.select(*spec.keys, *spec.order, spec.target_col).join(guess.drop("step"), [*spec.keys, spec.time_col], "inner")


def holdout_by_position(df: DataFrame, spec: SeriesSpec, model: str, h: int, params: Mapping | None = None) -> DataFrame:
    """The last ``h`` observed rows next to the model's values in the same order, with the naive guess."""
    return cross_validation(df, spec, {model: params, "naive": None} if model != "naive" else {"naive": None}, h)


def with_fallback(joined: DataFrame, insample: DataFrame, spec: SeriesSpec, h: int) -> tuple[DataFrame, str]:
    """The joined holdout, or the last ``h`` in-sample rows per series when the join found nothing."""
    if not joined.isEmpty():
        return joined, "future_holdout"
    marked = tail_split(insample, spec, h)
    return marked.where("is_test").drop("is_test"), "insample_tail_fallback"


def evaluation(rows: DataFrame, spec: SeriesSpec, prediction: str = "yhat", step_size: int = 1, lags: int = 20) -> dict[str, DataFrame]:
    """Overall metrics, step metrics and residual tests of actual / predicted rows."""
    y, p = F.col(spec.target_col), F.col(prediction)
    whole = rows.where(y.isNotNull() & p.isNotNull()).withColumn("_res", y - p)
    order = [*spec.keys, *spec.order]
    return {
        "metrics": accuracy(whole, spec.target_col, prediction),
        "steps": step_accuracy(whole, spec, prediction, step_size),
        "ljung_box": ljung_box(whole, [], order, "_res", lags),
        "adf": adf(whole, [], order, "_res"),
    }


def compare_with_naive(rows: DataFrame, spec: SeriesSpec, prediction: str, naive: str = "naive", by: Sequence[str] = ()) -> DataFrame:
    """Metrics of a model and of the naive guess, and whether their squared errors differ."""
    y = F.col(spec.target_col)
    mine = accuracy(rows, spec.target_col, prediction, by, floor=True)
    base = accuracy(rows, spec.target_col, naive, by, floor=True)
    base = base.select(*by, *[F.col(f"`{c}`").alias(f"naive_{c}") for c in base.columns if c not in by and c != "n"])
    errors = rows.withColumns({"_e1": F.col(prediction) - y, "_e2": F.col(naive) - y})
    order = [c for c in [*spec.keys, *spec.order, "step"] if c in errors.columns]
    test = diebold_mariano_hac(errors, "_e1", "_e2", order, by=by).drop("n")
    if by:
        return mine.join(base, list(by)).join(test, list(by))
    one = F.lit(1).alias("_one")
    return mine.select("*", one).join(base.select("*", one), "_one").join(test.select("*", one), "_one").drop("_one")
