"""The feature build: calendar, history, static and anomaly families of a series table in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.anomaly import point_scores, tail_probability
from ..operators.calendar import calendar_columns, cyclical_columns, execution_columns, month_edge_columns
from ..operators.prep import prefix_projection
from ..operators.statics import static_features
from ..operators.windows import HISTORY_REACH, ewm_levels, expanding_columns, history_columns, level_carry
from ..spec import SeriesSpec, clean_target
from .series import Layout, attach, by_size, measure, over_groups


@by_size
def build_features(df: DataFrame, spec: SeriesSpec, families: Sequence[str] = ("base", "hist", "stat"), detectors: Sequence[str] = (), layout: Layout | None = None) -> DataFrame:
    """Keys, time and target with every ``feat_``, ``hist_`` and ``stat_`` column of the chosen families.

    All series-ordered features share one window, so ordinary series cost one exchange and one sort for everything.
    """
    df = clean_target(df, spec)
    layout = layout or measure(df, spec.keys)
    y = F.col(spec.target_col)
    t = F.unix_micros(F.col(spec.time_col).cast("timestamp"))
    names = ("year", "month", "day", "dayofweek", "weekofyear", "dayofyear", "is_weekend")
    calendar = {f"feat_{n}": c for n, c in calendar_columns(spec.time_col).items() if n in names}
    calendar |= month_edge_columns(spec.time_col, "feat_")
    calendar |= {n: c for n, c in cyclical_columns(spec.time_col, "feat_").items() if "doy" not in n}
    calendar |= execution_columns(df, spec)
    want_hist, want_stat = "hist" in families, "stat" in families
    in_place = want_stat and layout.plain
    if want_hist:
        df = ewm_levels(df, spec, layout=layout)

    def build(frame, w):
        cols = dict(calendar)
        cols["feat_days_since_first"] = F.floor((t - F.col("_first")) / F.lit(86_400_000_000)).cast("long")
        cols["feat_row_no_in_group"] = (F.col("_pos") + 1).cast("long")
        if want_hist:
            cols |= history_columns(y, w) | expanding_columns()
        if in_place:
            g = Window.partitionBy(*spec.keys)
            n = F.col("_n_obs")
            cols |= {
                "stat_y_count": n,
                "stat_y_mean": F.avg(y).over(g),
                "stat_y_std": F.stddev_samp(y).over(g),
                "stat_y_min": F.min(y).over(g),
                "stat_y_max": F.max(y).over(g),
                "stat_y_median": F.percentile(y, F.lit(0.5)).over(g),
                "stat_y_q25": F.percentile(y, F.lit(0.25)).over(g),
                "stat_y_q75": F.percentile(y, F.lit(0.75)).over(g),
                "stat_y_trend_slope": F.when(n >= 2, F.regr_slope(y, F.when(y.isNotNull(), F.col("_seen")).cast("double")).over(g)),
            }
        frame = frame.withColumns(cols)
        if in_place:
            frame = frame.withColumns(
                {
                    "stat_y_iqr": F.col("stat_y_q75") - F.col("stat_y_q25"),
                    "stat_y_cv": F.col("stat_y_std") / (F.abs("stat_y_mean") + 1e-9),
                }
            )
        return frame

    out = over_groups(
        df,
        spec.keys,
        spec.order,
        build,
        back=HISTORY_REACH if want_hist else 0,
        running={"_seen": y.isNotNull().cast("long")},
        whole={"_first": F.min(t), "_n_obs": F.count(y)},
        moments={"_past": y} if want_hist else None,
        carry=level_carry() if want_hist else None,
        layout=layout,
    )
    if want_stat and not in_place:
        out = attach(out, static_features(df, spec, layout=layout), spec.keys, layout.hot_groups)
    if "anomaly" in families:
        out = point_scores(out, spec, layout=layout)
        for kind in detectors:
            out = tail_probability(out, spec, kind, layout=layout)
    return prefix_projection(out, spec, "base" in families)
