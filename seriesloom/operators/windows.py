"""Lag, rolling, expanding and exponentially weighted features of a series' own past."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.series import Layout, by_size, measure, over_groups
from ..spec import SeriesSpec

# The default feature set.
LAGS = (1, 2, 3, 7, 14, 28)
DIFFS = (1, 7)
MEAN_WINDOWS = (3, 7, 14, 28)
STD_WINDOWS = (7, 14, 28)
RANGE_WINDOWS = (7, 14)
EWM_SPANS = (7, 14)


def previous(w: WindowSpec, rows: int) -> WindowSpec:
    """The ``rows`` rows before the current one."""
    return w.rowsBetween(-rows, -1)


def full(value: Column, y: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    """``value`` where the frame of previous rows holds at least ``least`` observations (default: all)."""
    return F.when(F.count(y).over(previous(w, rows)) >= (rows if least is None else least), value)


def rolling(fn, y: Column, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return full(fn(y).over(previous(w, rows)), y, w, rows, least)


def ewm_reach(span: int) -> int:
    """Rows after which an observation's weight is below 1e-15, however many of the rows between are missing."""
    return math.ceil(2 * math.log(1e15) / -math.log(1.0 - 2.0 / (span + 1.0)))


def ewm_levels(df: DataFrame, spec: SeriesSpec, spans: Sequence[int] = EWM_SPANS, layout: Layout | None = None) -> DataFrame:
    """Add ``_ewm_<span>``: the recursive exponentially weighted mean at every observed row.

    With the weight a, an observation that follows the previous one after g steps is mixed in with the share
    b = a / ((1 - a)^g + a), because missing steps age the mean. The recursion unrolls into a sum of b * y * exp(D_i - D_t)
    with D the running total of -ln(1 - b). Exponents are taken relative to segments of D to stay in range: a running sum
    inside the segment plus the total of the segment before it, everything older having decayed away. That is constant
    work per row, on the partitioning the other features use.
    """
    y = F.col(spec.target_col)
    width = 300.0

    def build(frame: DataFrame, w: WindowSpec) -> DataFrame:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        cell = [*spec.keys, *[c for c in ("_blk",) if c in frame.columns]]
        last_seen = F.last(F.when(y.isNotNull(), F.col("_pos")), ignorenulls=True).over(before)
        frame = frame.withColumn("_gap", F.when(y.isNotNull(), F.col("_pos") - last_seen))
        gap = F.col("_gap")
        share, loss = {}, {}
        for s in spans:
            a = 2.0 / (s + 1.0)
            norm = F.pow(F.lit(1.0 - a), gap) + a
            share[f"_b{s}"] = F.when(y.isNotNull(), F.coalesce(a / norm, F.lit(1.0)))
            loss[f"_l{s}"] = F.when(gap.isNotNull(), F.least(-math.log(1.0 - a) * gap + F.log(norm), F.lit(width)))
        frame = frame.withColumns(share | loss)
        frame = frame.withColumns({f"_d{s}": F.coalesce(F.sum(f"_l{s}").over(upto), F.lit(0.0)) for s in spans})
        frame = frame.withColumns({f"_s{s}": F.floor(F.col(f"_d{s}") / width) for s in spans})
        inside = {}
        for s in spans:
            value = F.col(f"_b{s}") * y * F.exp(F.col(f"_d{s}") - F.col(f"_s{s}") * width)
            run = Window.partitionBy(*cell, f"_s{s}").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
            inside[f"_v{s}"] = F.coalesce(F.sum(value).over(run), F.lit(0.0))
        frame = frame.withColumns(inside)
        ends = {}
        for s in spans:
            closed = F.struct(F.col(f"_s{s}").alias("s"), F.col(f"_v{s}").alias("v"))
            ends[f"_e{s}"] = F.when(F.lead(f"_s{s}", 1).over(w) != F.col(f"_s{s}"), closed)
        frame = frame.withColumns(ends)
        frame = frame.withColumns({f"_e{s}": F.last(f"_e{s}", ignorenulls=True).over(before) for s in spans})
        level = {}
        for s in spans:
            d, seg, closed = F.col(f"_d{s}"), F.col(f"_s{s}"), F.col(f"_e{s}")
            older = F.when(closed["s"] == seg - 1, F.exp((seg - 1) * width - d) * closed["v"]).otherwise(F.lit(0.0))
            level[f"_ewm_{s}"] = F.when(y.isNotNull(), F.exp(seg * width - d) * F.col(f"_v{s}") + older)
        helpers = ["_gap", *[f"_{p}{s}" for p in "bldsve" for s in spans]]
        return frame.withColumns(level).drop(*helpers)

    return over_groups(df, spec.keys, spec.order, build, back=max(ewm_reach(s) for s in spans), layout=layout)


def history_columns(y: Column, w: WindowSpec, ewm: bool = True) -> dict[str, Column]:
    """The default history pack without its expanding part; ``ewm`` expects the carried ``_level_<span>`` columns."""
    out = {f"hist_lag_{k}": F.lag(y, k).over(w) for k in LAGS}
    out |= {f"hist_diff_{k}": y - F.lag(y, k).over(w) for k in DIFFS}
    out |= {f"hist_roll_mean_{n}": rolling(F.avg, y, w, n) for n in MEAN_WINDOWS}
    out |= {f"hist_roll_std_{n}": rolling(F.stddev_samp, y, w, n) for n in STD_WINDOWS}
    for n in RANGE_WINDOWS:
        out[f"hist_roll_min_{n}"] = rolling(F.min, y, w, n)
        out[f"hist_roll_max_{n}"] = rolling(F.max, y, w, n)
    if ewm:
        out |= {f"hist_ewm_mean_{s}": F.lag(f"_level_{s}", 1).over(w) for s in EWM_SPANS}
    return out


def level_carry() -> dict[str, Column]:
    return {f"_level_{s}": F.col(f"_ewm_{s}") for s in EWM_SPANS}


def expanding_columns(prefix: str = "_past") -> dict[str, Column]:
    n, mean, m2 = (F.col(f"{prefix}_{p}") for p in ("n", "mean", "m2"))
    return {
        "hist_expanding_mean": mean,
        "hist_expanding_std": F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1))),
    }


HISTORY_REACH = max(*LAGS, *MEAN_WINDOWS)


@by_size
def history_features(df: DataFrame, spec: SeriesSpec, ewm: bool = True, layout: Layout | None = None) -> DataFrame:
    """Lags, differences, rolling and expanding statistics, EWM; every one over strictly earlier rows."""
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    if ewm:
        df = ewm_levels(df, spec, layout=layout)

    def build(frame, w):
        return frame.withColumns(history_columns(y, w, ewm) | expanding_columns())

    out = over_groups(
        df,
        spec.keys,
        spec.order,
        build,
        back=HISTORY_REACH,
        moments={"_past": y},
        carry=level_carry() if ewm else None,
        layout=layout,
    )
    return out.drop(*[f"_ewm_{s}" for s in EWM_SPANS])


def lag_features(df: DataFrame, spec: SeriesSpec, lags: Sequence[int] = (1, 7, 14), layout: Layout | None = None) -> DataFrame:
    lags = sorted({int(k) for k in lags if int(k) > 0})
    y = F.col(spec.target_col)

    def build(frame, w):
        return frame.withColumns({f"lag_{k}": F.lag(y, k).over(w) for k in lags})

    return over_groups(df, spec.keys, spec.order, build, back=max(lags, default=0), layout=layout)


def rolling_features(df: DataFrame, spec: SeriesSpec, windows: Sequence[int] = (7, 14, 28), layout: Layout | None = None) -> DataFrame:
    windows = sorted({int(n) for n in windows if int(n) > 1})
    y = F.col(spec.target_col)

    def build(frame, w):
        cols = {}
        for n in windows:
            cols |= {
                f"roll_mean_{n}": rolling(F.avg, y, w, n),
                f"roll_std_{n}": rolling(F.stddev_samp, y, w, n),
                f"roll_min_{n}": rolling(F.min, y, w, n),
                f"roll_max_{n}": rolling(F.max, y, w, n),
            }
        return frame.withColumns(cols)

    return over_groups(df, spec.keys, spec.order, build, back=max(windows, default=0), layout=layout)


def diff_features(df: DataFrame, spec: SeriesSpec, periods: Sequence[int] = (1, 7), layout: Layout | None = None) -> DataFrame:
    periods = sorted({int(p) for p in periods if int(p) > 0})
    y = F.col(spec.target_col)

    def build(frame, w):
        return frame.withColumns({f"diff_{p}": y - F.lag(y, p).over(w) for p in periods})

    return over_groups(df, spec.keys, spec.order, build, back=max(periods, default=0), layout=layout)


def prepare_dataset(
    df: DataFrame,
    spec: SeriesSpec,
    lags: Sequence[int] = (1, 7, 14),
    windows: Sequence[int] = (7, 14, 28),
    periods: Sequence[int] = (1, 7),
) -> DataFrame:
    """The configurable pack in one pass over the series: lags, rolling statistics and differences."""
    y = F.col(spec.target_col)
    lags, windows, periods = ([int(v) for v in vs] for vs in (lags, windows, periods))

    def build(frame, w):
        cols = {f"lag_{k}": F.lag(y, k).over(w) for k in lags}
        for n in windows:
            cols |= {
                f"roll_mean_{n}": rolling(F.avg, y, w, n),
                f"roll_std_{n}": rolling(F.stddev_samp, y, w, n),
                f"roll_min_{n}": rolling(F.min, y, w, n),
                f"roll_max_{n}": rolling(F.max, y, w, n),
            }
        return frame.withColumns(cols | {f"diff_{p}": y - F.lag(y, p).over(w) for p in periods})

    return over_groups(df, spec.keys, spec.order, build, back=max([0, *lags, *windows, *periods]))


def job_features(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The short pack of the feature job: calendar parts, lags 1-3, mean and std of up to 3 previous values, difference."""
    y, t = F.col(spec.target_col), F.col(spec.time_col)
    parts = {
        "ds_year": F.year(t),
        "ds_month": F.month(t),
        "ds_day": F.dayofmonth(t),
        "ds_dayofweek": F.weekday(t),
        "ds_is_month_start": (F.dayofmonth(t) == 1).cast("int"),
        "ds_is_month_end": (F.to_date(t) == F.last_day(t)).cast("int"),
    }

    def build(frame, w):
        cols = {f"y_lag_{k}": F.lag(y, k).over(w) for k in (1, 2, 3)}
        cols |= {
            "y_rolling_mean_3": rolling(F.avg, y, w, 3, least=1),
            "y_rolling_std_3": rolling(F.stddev_samp, y, w, 3, least=2),
            "y_diff_1": y - F.lag(y, 1).over(w),
        }
        return frame.withColumns(parts | cols)

    return over_groups(df, spec.keys, spec.order, build, back=3)


def row_numbers(df: DataFrame, spec: SeriesSpec, layout: Layout | None = None) -> DataFrame:
    """Row number in the series and whole days since its first time."""
    t = F.unix_micros(F.col(spec.time_col).cast("timestamp"))

    def build(frame, _w):
        return frame.withColumns(
            {
                "feat_row_no_in_group": (F.col("_pos") + 1).cast("long"),
                "feat_days_since_first": F.floor((t - F.col("_first")) / F.lit(86_400_000_000)).cast("long"),
            }
        )

    return over_groups(df, spec.keys, spec.order, build, whole={"_first": F.min(t)}, layout=layout)


def running_level(df: DataFrame, spec: SeriesSpec, layout: Layout | None = None) -> DataFrame:
    """Mean up to the row with missing values as 0, and the series z-score (spread clamped at 1e-6)."""
    y0 = F.coalesce(F.col(spec.target_col), F.lit(0.0))

    def build(frame, _w):
        spread = F.greatest(F.col("_sd"), F.lit(1e-6))
        return frame.withColumns(
            {
                "feat_cummean_y": (F.col("_sum") + y0) / (F.col("_pos") + 1),
                "feat_zscore_y": (y0 - F.col("_mu")) / spread,
            }
        )

    return over_groups(
        df,
        spec.keys,
        spec.order,
        build,
        running={"_sum": y0},
        whole={"_mu": F.avg(y0), "_sd": F.stddev_pop(y0)},
        layout=layout,
    )


def missing_columns(y: Column, w: WindowSpec, rows: int, name: str) -> dict[str, Column]:
    """Share of missing previous values among the last ``rows`` rows, and whether the newest is missing."""
    gone = F.lag(y, 1).over(w).isNull().cast("double")
    # The value before row i-1 is missing exactly when row i-1's lag is; a series starts with one gap.
    frame = w.rowsBetween(-rows, -1)
    present = F.count(y).over(frame)
    seen = F.least(F.col("_pos") + 1, F.lit(rows))
    return {f"hist_{name}_missing_ratio": (seen - present) / seen, f"hist_{name}_missing_flag": gone}


def missing_features(df: DataFrame, spec: SeriesSpec, rows: int = 32, name: str = "pypots", layout: Layout | None = None) -> DataFrame:
    y = F.col(spec.target_col)

    def build(frame, w):
        return frame.withColumns(missing_columns(y, w, rows, name))

    return over_groups(df, spec.keys, spec.order, build, back=rows + 1, layout=layout)


def tail_split(df: DataFrame, spec: SeriesSpec, h: int) -> DataFrame:
    """Mark the last ``h`` rows of every series with ``is_test``; the rest is training data.

    Only the ``h`` newest rows per series travel (Spark limits each partition before the exchange); their first row is
    the border that splits the whole series, so no series is sorted in one task.
    """
    newest = Window.partitionBy(*spec.keys).orderBy(*[F.col(c).desc() for c in spec.order])
    tail = df.select(*spec.keys, *spec.order).withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= int(h))
    border = tail.groupBy(*spec.keys).agg(F.min(spec.order_struct()).alias("_border"))
    names = {k: f"_t_{k}" for k in spec.keys}
    border = border.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, n in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    out = df.join(border, cond, "left").drop(*names.values())
    return out.withColumn("is_test", spec.order_struct() >= F.col("_border")).drop("_border")


def forecast_steps(df: DataFrame, spec: SeriesSpec, name: str = "forecast_step", layout: Layout | None = None) -> DataFrame:
    def build(frame, _w):
        return frame.withColumn(name, (F.col("_pos") + 1).cast("long"))

    return over_groups(df, spec.keys, spec.order, build, layout=layout)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``; ``row_number() = 1`` is limited per partition before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def history_windows(df: DataFrame, spec: SeriesSpec, rows: int, name: str = "window", layout: Layout | None = None) -> DataFrame:
    """The previous ``rows`` values as an array, left padded with NULL to full length."""
    y = F.col(spec.target_col)

    def build(frame, w):
        seen = F.transform(F.collect_list(F.struct(y.alias("v"))).over(previous(w, rows)), lambda s: s["v"])
        pad = F.array_repeat(F.lit(None).cast("double"), rows - F.size(seen))
        return frame.withColumn(name, F.concat(pad, seen))

    return over_groups(df, spec.keys, spec.order, build, back=rows, layout=layout)


@by_size
def fill_values(df: DataFrame, spec: SeriesSpec, method: str = "ffill", causal: bool = False, name: str | None = None, layout: Layout | None = None) -> DataFrame:
    """Fill gaps of the target: ffill (then bfill), bfill (then ffill), interpolate, zero or mean; the rest is 0.

    ``causal`` keeps ffill from looking ahead into later values.
    """
    y, out = F.col(spec.target_col), name or spec.target_col
    method = (method or "ffill").strip().lower()
    if method == "zero":
        return df.withColumn(out, F.coalesce(y, F.lit(0.0)))

    def build(frame, _w):
        if method == "mean":
            value = F.coalesce(y, F.col("_mean"))
        elif method == "bfill":
            value = F.coalesce(F.col("_next"), F.col("_prev"))
        elif method == "interpolate":
            prev, nxt = F.col("_prev_at"), F.col("_next_at")
            part = F.try_divide(F.col("_pos") - prev["p"], nxt["p"] - prev["p"])
            between = prev["v"] + (nxt["v"] - prev["v"]) * part
            value = F.coalesce(y, between, prev["v"], nxt["v"])
        else:
            value = F.coalesce(F.col("_prev"), F.lit(None) if causal else F.col("_next"))
        return frame.withColumn(out, F.coalesce(value, F.lit(0.0)))

    if method == "mean":
        return over_groups(df, spec.keys, spec.order, build, whole={"_mean": F.avg(y)}, layout=layout)
    if method == "interpolate":
        point = F.when(y.isNotNull(), F.struct(F.col("_pos").alias("p"), y.alias("v")))
        numbered = over_groups(df, spec.keys, spec.order, lambda f, _w: f.withColumn("_at", point), layout=layout)
        known = F.col("_at")
        return over_groups(
            numbered, spec.keys, spec.order, build, carry={"_prev_at": known}, carry_back={"_next_at": known}, layout=layout
        ).drop("_at")
    return over_groups(df, spec.keys, spec.order, build, carry={"_prev": y}, carry_back={"_next": y}, layout=layout)
