"""Calendar columns and future frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SeriesSpec

# Step of each supported frequency.
FREQUENCIES = {
    "H": "INTERVAL 1 HOUR",
    "D": "INTERVAL 1 DAY",
    "W": "INTERVAL 7 DAY",
    "M": "INTERVAL 1 MONTH",
}


def _cycle(value: Column, period: float, fn) -> Column:
    return fn(2 * F.pi() * value / F.lit(float(period)))


def calendar_columns(time: str, prefix: str = "") -> dict[str, Column]:
    """Calendar parts of a timestamp; Monday is day 0 of the week."""
    t = F.col(time)
    dow = F.weekday(t)
    parts = {
        "year": F.year(t),
        "quarter": F.quarter(t),
        "month": F.month(t),
        "weekofyear": F.weekofyear(t),
        "day": F.dayofmonth(t),
        "dayofyear": F.dayofyear(t),
        "dayofweek": dow,
        "is_weekend": (dow >= 5).cast("int"),
    }
    return {prefix + k: v for k, v in parts.items()}


def month_edge_columns(time: str, prefix: str = "") -> dict[str, Column]:
    t = F.col(time)
    return {
        f"{prefix}is_month_start": (F.dayofmonth(t) == 1).cast("int"),
        f"{prefix}is_month_end": (F.to_date(t) == F.last_day(t)).cast("int"),
    }


def cyclical_columns(time: str, prefix: str = "") -> dict[str, Column]:
    """Position in the week, month cycle and year as points on a circle."""
    t = F.col(time)
    return {
        f"{prefix}dow_sin": _cycle(F.weekday(t), 7, F.sin),
        f"{prefix}dow_cos": _cycle(F.weekday(t), 7, F.cos),
        f"{prefix}month_sin": _cycle(F.month(t), 12, F.sin),
        f"{prefix}month_cos": _cycle(F.month(t), 12, F.cos),
        f"{prefix}doy_sin": _cycle(F.dayofyear(t), 365.25, F.sin),
        f"{prefix}doy_cos": _cycle(F.dayofyear(t), 365.25, F.cos),
    }


def add_calendar(df: DataFrame, time: str = "ds", prefix: str = "", edges: bool = True, cyclical: bool = True) -> DataFrame:
    cols = calendar_columns(time, prefix)
    if edges:
        cols |= month_edge_columns(time, prefix)
    if cyclical:
        cols |= cyclical_columns(time, prefix)
    return df.withColumns(cols)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def execution_columns(df: DataFrame, spec: SeriesSpec) -> dict[str, Column]:
    """``feat_proc_seconds`` and ``feat_exec_lag_sec`` when their source columns are there."""
    out: dict[str, Column] = {}
    if "proc_seconds" in df.columns:
        out["feat_proc_seconds"] = F.col("proc_seconds").try_cast("double")
    if "exec_ts" in df.columns:
        out["feat_exec_lag_sec"] = seconds_between(F.col("exec_ts").try_cast("timestamp"), F.col(spec.time_col))
    return out


def future_frame(df: DataFrame, h: int, freq: str = "D", id_col: str = "unique_id", time_col: str = "ds") -> DataFrame:
    """The next ``h`` steps after each series' last time; exactly ``h`` rows per series."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unsupported frequency: {freq}")
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    last = df.where(F.col(time_col).isNotNull()).groupBy(*ids).agg(F.max(time_col).alias("_last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(int(h))))
    # Every step is counted from the last time itself, so month ends do not drift.
    return last.select(*ids, "_last", steps.alias("step")).select(
        *ids, F.expr(f"_last + step * {FREQUENCIES[freq]}").alias(time_col), "step"
    )
