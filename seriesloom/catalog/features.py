"""Series features: calendar, windows, statics, anomalies and window packs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import anomaly, calendar, embed, profile, statics, windows
from ..plans.features import build_features
from .views import (
    GAPPY_SQL, LINES, LINES_SQL, SERIES, SERIES_SQL, TICKS, TICKS_SQL, day, gappy, lines, r, series, ticks,
)

KEYS = ["loto", "unique_id"]
W = "PARTITION BY loto, unique_id, ts_type ORDER BY ds"
WT = "PARTITION BY loto, unique_id, ts_type ORDER BY ds, row_id"
DAY_SQL = "strftime(ds, '%Y-%m-%d') AS ds"


def sql_round(pairs: dict[str, str], n: int = 6) -> str:
    return ",\n  ".join(f"round({e}, {n}) + 0.0 AS {name}" for name, e in pairs.items())


def _roll(fn: str, n: int, least: int | None = None, y: str = "y", w: str = W) -> str:
    frame = f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({y}) OVER {frame} >= {least or n} THEN {fn}({y}) OVER {frame} END"


CALENDAR_SQL = {
    "year": "year(ds)", "quarter": "quarter(ds)", "month": "month(ds)", "weekofyear": "weekofyear(ds)", "day": "day(ds)",
    "dayofyear": "dayofyear(ds)", "dayofweek": "(isodow(ds) - 1)", "is_weekend": "CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END",
}
EDGE_SQL = {
    "is_month_start": "CASE WHEN day(ds) = 1 THEN 1 ELSE 0 END",
    "is_month_end": "CASE WHEN CAST(ds AS DATE) = last_day(ds) THEN 1 ELSE 0 END",
}
CYCLE_SQL = {
    "dow_sin": "sin(2 * pi() * (isodow(ds) - 1) / 7.0)", "dow_cos": "cos(2 * pi() * (isodow(ds) - 1) / 7.0)",
    "month_sin": "sin(2 * pi() * month(ds) / 12.0)", "month_cos": "cos(2 * pi() * month(ds) / 12.0)",
    "doy_sin": "sin(2 * pi() * dayofyear(ds) / 365.25)", "doy_cos": "cos(2 * pi() * dayofyear(ds) / 365.25)",
}
HISTORY_SQL = {f"hist_lag_{k}": f"lag(y, {k}) OVER ({W})" for k in windows.LAGS}
HISTORY_SQL |= {f"hist_diff_{k}": f"y - lag(y, {k}) OVER ({W})" for k in windows.DIFFS}
HISTORY_SQL |= {f"hist_roll_mean_{n}": _roll("avg", n) for n in windows.MEAN_WINDOWS}
HISTORY_SQL |= {f"hist_roll_std_{n}": _roll("stddev_samp", n) for n in windows.STD_WINDOWS}
HISTORY_SQL |= {f"hist_roll_min_{n}": _roll("min", n) for n in windows.RANGE_WINDOWS}
HISTORY_SQL |= {f"hist_roll_max_{n}": _roll("max", n) for n in windows.RANGE_WINDOWS}
PAST = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
EXPANDING_SQL = {"hist_expanding_mean": f"avg(y) OVER {PAST}", "hist_expanding_std": f"stddev_samp(y) OVER {PAST}"}
STATIC_AGG_SQL = {
    "stat_y_mean": "avg(y)", "stat_y_std": "stddev_samp(y)", "stat_y_min": "min(y)", "stat_y_max": "max(y)",
    "stat_y_median": "quantile_cont(y, 0.5)", "stat_y_q25": "quantile_cont(y, 0.25)", "stat_y_q75": "quantile_cont(y, 0.75)",
    "stat_y_iqr": "quantile_cont(y, 0.75) - quantile_cont(y, 0.25)", "stat_y_cv": "stddev_samp(y) / (abs(avg(y)) + 1e-9)",
    "stat_y_trend_slope": "CASE WHEN count(y) >= 2 THEN regr_slope(y, x) END",
}
NUMBERED_SQL = """numbered AS (SELECT *, CASE WHEN y IS NOT NULL THEN count(y) OVER (PARTITION BY loto, unique_id, ts_type ORDER BY ds
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS x FROM {src})"""


def _plain(pairs: dict[str, str], prefix: str = "") -> str:
    return ",\n  ".join(f"CAST({e} AS BIGINT) AS {prefix}{n}" for n, e in pairs.items())


def _cycles(prefix: str = "", names=None) -> str:
    return sql_round({prefix + n: e for n, e in CYCLE_SQL.items() if names is None or n in names})


def register(reg) -> None:
    _calendar(reg)
    _windows(reg)
    _statics(reg)
    _anomaly(reg)
    _packs(reg)


def _calendar(reg) -> None:
    @reg.add(
        "calendar_features",
        f"WITH {SERIES_SQL} SELECT loto, unique_id, {DAY_SQL}, {_plain(CALENDAR_SQL)}, {_plain(EDGE_SQL)}, {_cycles()} FROM series",
    )
    def _(spark, sf):
        df = calendar.add_calendar(series(spark, sf))
        ints = [F.col(n).cast("long").alias(n) for n in (*CALENDAR_SQL, *EDGE_SQL)]
        return df.select(*KEYS, day("ds").alias("ds"), *ints, *[r(n).alias(n) for n in CYCLE_SQL])

    @reg.add(
        "execution_lag",
        """SELECT event_id, round(value, 6) + 0.0 AS feat_proc_seconds,
           round((epoch_us(ts + to_seconds(user_id)) - epoch_us(date_trunc('day', ts))) / 1e6, 6) + 0.0 AS feat_exec_lag_sec FROM events""",
    )
    def _(spark, sf):
        from .views import table

        e = table(spark, sf, "events").select(
            "event_id",
            F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ds"),
            F.col("value").cast("string").alias("proc_seconds"),
            F.timestamp_seconds(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000).cast("decimal(20,0)") + F.col("user_id")).alias("exec_ts"),
        )
        e = e.withColumns(calendar.execution_columns(e, SERIES))
        return e.select("event_id", *[r(c).alias(c) for c in ("feat_proc_seconds", "feat_exec_lag_sec")])

    @reg.add(
        "future_frame_daily",
        f"""WITH {SERIES_SQL}, ends AS (SELECT loto, unique_id, max(ds) AS last FROM series GROUP BY 1, 2)
        SELECT loto, unique_id, strftime(last + to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS ds, k AS step FROM ends, range(1, 8) t(k)""",
    )
    def _(spark, sf):
        out = calendar.future_frame(series(spark, sf), 7, "D", id_col=KEYS)
        return out.select(*KEYS, day("ds").alias("ds"), F.col("step").cast("long").alias("step"))

    @reg.add(
        "future_frame_monthly",
        f"""WITH {SERIES_SQL}, ends AS (SELECT loto, unique_id, max(ds) AS last FROM series GROUP BY 1, 2)
        SELECT loto, unique_id, strftime(last + to_months(CAST(k AS INTEGER)), '%Y-%m-%d') AS ds, k AS step FROM ends, range(1, 7) t(k)""",
    )
    def _(spark, sf):
        out = calendar.future_frame(series(spark, sf), 6, "M", id_col=KEYS)
        return out.select(*KEYS, day("ds").alias("ds"), F.col("step").cast("long").alias("step"))


def _windows(reg) -> None:
    lags = {n: e for n, e in HISTORY_SQL.items() if "lag" in n or "diff" in n}

    @reg.add("lag_and_diff", f"WITH {GAPPY_SQL} SELECT loto, unique_id, {DAY_SQL}, {sql_round(lags)} FROM gappy")
    def _(spark, sf):
        out = windows.history_features(gappy(spark, sf), SERIES, ewm=False)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(n).alias(n) for n in lags])

    rolls = {n: e for n, e in HISTORY_SQL.items() if "roll" in n}

    @reg.add("rolling_features", f"WITH {GAPPY_SQL} SELECT loto, unique_id, {DAY_SQL}, {sql_round(rolls)} FROM gappy")
    def _(spark, sf):
        out = windows.history_features(gappy(spark, sf), SERIES, ewm=False)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(n).alias(n) for n in rolls])

    @reg.add("expanding_features", f"WITH {GAPPY_SQL} SELECT loto, unique_id, {DAY_SQL}, {sql_round(EXPANDING_SQL)} FROM gappy")
    def _(spark, sf):
        out = windows.history_features(gappy(spark, sf), SERIES, ewm=False)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(n).alias(n) for n in EXPANDING_SQL])

    # Without gaps the recursion has a closed form over the row numbers, which plain SQL can state.
    ewm_sql = ",\n".join(
        f"""round((SELECT sum(CASE WHEN p.rn = 1 THEN pow(1 - {a}, c.rn - 2) ELSE {a} * pow(1 - {a}, c.rn - 1 - p.rn) END * p.y)
        FROM numbered p WHERE p.loto = c.loto AND p.unique_id = c.unique_id AND p.rn < c.rn), 6) + 0.0 AS hist_ewm_mean_{s}"""
        for s, a in ((7, "(2.0 / 8)"), (14, "(2.0 / 15)"))
    )

    @reg.add(
        "ewm_features",
        f"""WITH {SERIES_SQL}, numbered AS (SELECT loto, unique_id, ds, y, row_number() OVER ({W}) AS rn FROM series)
        SELECT loto, unique_id, {DAY_SQL}, {ewm_sql} FROM numbered c""",
    )
    def _(spark, sf):
        out = windows.history_features(series(spark, sf), SERIES)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(f"hist_ewm_mean_{s}").alias(f"hist_ewm_mean_{s}") for s in windows.EWM_SPANS])

    # With gaps the level is stepped from row to row: a value that follows after g rows is mixed in with a / ((1 - a)^g + a).
    step = ", ".join(f"CASE WHEN n.y IS NULL THEN l.e{s} WHEN l.e{s} IS NULL THEN n.y ELSE l.e{s} + {a} / (pow(1 - {a}, l.gap + 1) + {a}) * (n.y - l.e{s}) END" for s, a in ((7, "(2.0 / 8)"), (14, "(2.0 / 15)")))
    gaps = f"""WITH RECURSIVE {GAPPY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds) AS rn FROM gappy),
      l AS (SELECT loto, unique_id, 1::BIGINT AS rn, CAST(y AS DOUBLE) AS e7, CAST(y AS DOUBLE) AS e14, 0 AS gap FROM n WHERE rn = 1
        UNION ALL SELECT n.loto, n.unique_id, n.rn, {step}, CASE WHEN n.y IS NULL THEN l.gap + 1 ELSE 0 END FROM l JOIN n ON n.loto = l.loto AND n.unique_id = l.unique_id AND n.rn = l.rn + 1)
      SELECT n.loto, n.unique_id, strftime(n.ds, '%Y-%m-%d') AS ds, round(l.e7, 6) + 0.0 AS hist_ewm_mean_7, round(l.e14, 6) + 0.0 AS hist_ewm_mean_14 FROM n LEFT JOIN l ON n.loto = l.loto AND n.unique_id = l.unique_id AND n.rn = l.rn + 1"""

    @reg.add("ewm_with_gaps", gaps)
    def _(spark, sf):
        out = windows.history_features(gappy(spark, sf), SERIES)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(f"hist_ewm_mean_{s}").alias(f"hist_ewm_mean_{s}") for s in windows.EWM_SPANS])

    pack = {f"lag_{k}": f"lag(y, {k}) OVER ({WT})" for k in (1, 7, 14)}
    for n in (7, 14, 28):
        for fn, tag in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")):
            pack[f"roll_{tag}_{n}"] = _roll(fn, n, w=WT)
    pack |= {f"diff_{p}": f"y - lag(y, {p}) OVER ({WT})" for p in (1, 7)}

    @reg.add("prepared_dataset", f"WITH {TICKS_SQL} SELECT row_id, {sql_round(pack)} FROM ticks")
    def _(spark, sf):
        out = windows.prepare_dataset(ticks(spark, sf), TICKS)
        return out.select("row_id", *[r(n).alias(n) for n in pack])

    job = {f"y_lag_{k}": f"lag(y, {k}) OVER ({WT})" for k in (1, 2, 3)}
    job |= {"y_rolling_mean_3": _roll("avg", 3, 1, w=WT), "y_rolling_std_3": _roll("stddev_samp", 3, 2, w=WT), "y_diff_1": f"y - lag(y, 1) OVER ({WT})"}
    parts = {"ds_year": "year(ds)", "ds_month": "month(ds)", "ds_day": "day(ds)", "ds_dayofweek": "isodow(ds) - 1"}
    parts |= {f"ds_{k}": v for k, v in EDGE_SQL.items()}

    @reg.add("feature_job", f"WITH {TICKS_SQL} SELECT row_id, {_plain(parts)}, {sql_round(job)} FROM ticks")
    def _(spark, sf):
        out = windows.job_features(ticks(spark, sf), TICKS)
        return out.select("row_id", *[F.col(n).cast("long").alias(n) for n in parts], *[r(n).alias(n) for n in job])

    @reg.add(
        "row_number_and_age",
        f"""WITH {TICKS_SQL} SELECT row_id, row_number() OVER ({WT}) AS feat_row_no_in_group,
        CAST(floor((epoch_us(ds) - epoch_us(min(ds) OVER (PARTITION BY loto, unique_id, ts_type))) / 86400000000) AS BIGINT) AS feat_days_since_first FROM ticks""",
    )
    def _(spark, sf):
        return windows.row_numbers(ticks(spark, sf), TICKS).select("row_id", "feat_row_no_in_group", "feat_days_since_first")

    @reg.add(
        "running_level",
        f"""WITH {GAPPY_SQL}, z AS (SELECT *, coalesce(y, 0.0) AS y0 FROM gappy)
        SELECT loto, unique_id, {DAY_SQL}, round(avg(y0) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS feat_cummean_y,
        round((y0 - avg(y0) OVER g) / greatest(stddev_pop(y0) OVER g, 1e-6), 6) + 0.0 AS feat_zscore_y
        FROM z WINDOW g AS (PARTITION BY loto, unique_id, ts_type)""",
    )
    def _(spark, sf):
        out = windows.running_level(gappy(spark, sf), SERIES)
        return out.select(*KEYS, day("ds").alias("ds"), r("feat_cummean_y").alias("feat_cummean_y"), r("feat_zscore_y").alias("feat_zscore_y"))

    @reg.add(
        "missing_history",
        f"""WITH {GAPPY_SQL}, s AS (SELECT *, CASE WHEN lag(y, 1) OVER ({W}) IS NULL THEN 1.0 ELSE 0.0 END AS gone FROM gappy)
        SELECT loto, unique_id, {DAY_SQL}, round(avg(gone) OVER ({W} ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 6) + 0.0 AS hist_pypots_missing_ratio,
        CAST(gone AS DOUBLE) AS hist_pypots_missing_flag FROM s""",
    )
    def _(spark, sf):
        out = windows.missing_features(gappy(spark, sf), SERIES, 32)
        return out.select(*KEYS, day("ds").alias("ds"), r("hist_pypots_missing_ratio").alias("hist_pypots_missing_ratio"), "hist_pypots_missing_flag")

    @reg.add(
        "tail_split",
        f"""WITH {TICKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id, ts_type ORDER BY ds DESC, row_id DESC) AS rn FROM ticks)
        SELECT row_id, rn <= 7 AS is_test FROM n""",
    )
    def _(spark, sf):
        return windows.tail_split(ticks(spark, sf), TICKS, 7).select("row_id", "is_test")

    @reg.add("forecast_steps", f"WITH {TICKS_SQL} SELECT row_id, row_number() OVER ({WT}) AS forecast_step FROM ticks")
    def _(spark, sf):
        return windows.forecast_steps(ticks(spark, sf), TICKS).select("row_id", "forecast_step")

    @reg.add(
        "history_windows",
        f"""WITH {TICKS_SQL}, v AS (SELECT row_id, {', '.join(f'lag(y, {k}) OVER ({WT}) AS l{k}' for k in range(1, 9))} FROM ticks)
        SELECT row_id, {sql_round({f'w{8 - k}': f'l{k}' for k in range(1, 9)})} FROM v""",
    )
    def _(spark, sf):
        out = windows.history_windows(ticks(spark, sf), TICKS, 8)
        return out.select("row_id", *[r(F.get("window", F.lit(i))).alias(f"w{i}") for i in range(8)])

    carried = f"last_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    coming = f"first_value(y IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    fills = {
        "ffill": f"coalesce({carried}, {coming}, 0.0)",
        "ffill_causal": f"coalesce({carried}, 0.0)",
        "bfill": f"coalesce({coming}, {carried}, 0.0)",
        "zero": "coalesce(y, 0.0)",
        "mean": "coalesce(y, avg(y) OVER (PARTITION BY loto, unique_id, ts_type), 0.0)",
    }
    for tag, expr in fills.items():

        def fill(spark, sf, tag=tag):
            out = windows.fill_values(gappy(spark, sf), SERIES, tag.split("_")[0], causal="causal" in tag, name="filled")
            return out.select(*KEYS, day("ds").alias("ds"), r("filled").alias("filled"))

        reg.add(f"fill_{tag}", f"WITH {GAPPY_SQL} SELECT loto, unique_id, {DAY_SQL}, round({expr}, 6) + 0.0 AS filled FROM gappy")(fill)

    @reg.add(
        "fill_interpolate",
        f"""WITH {GAPPY_SQL}, n AS (SELECT *, row_number() OVER ({W}) AS p FROM gappy),
        k AS (SELECT *, CASE WHEN y IS NOT NULL THEN p END AS q FROM n),
        b AS (SELECT *, {carried} AS pv, {coming} AS nv, {carried.replace('(y ', '(q ')} AS pp, {coming.replace('(y ', '(q ')} AS np FROM k)
        SELECT loto, unique_id, {DAY_SQL}, round(coalesce(y, pv + (nv - pv) * (p - pp) / (np - pp), pv, nv, 0.0), 6) + 0.0 AS filled FROM b""",
    )
    def _(spark, sf):
        out = windows.fill_values(gappy(spark, sf), SERIES, "interpolate", name="filled")
        return out.select(*KEYS, day("ds").alias("ds"), r("filled").alias("filled"))


def _statics(reg) -> None:
    stats = {n: e for n, e in STATIC_AGG_SQL.items()}

    @reg.add(
        "static_features",
        f"""WITH {GAPPY_SQL}, {NUMBERED_SQL.format(src='gappy')}
        SELECT loto, unique_id, ts_type, count(y) AS stat_y_count, {sql_round(stats)} FROM numbered GROUP BY 1, 2, 3""",
    )
    def _(spark, sf):
        out = statics.static_features(gappy(spark, sf), SERIES)
        return out.select("loto", "unique_id", "ts_type", "stat_y_count", *[r(n).alias(n) for n in stats])

    @reg.add(
        "trend_slope",
        f"""WITH {TICKS_SQL}, n AS (SELECT *, row_number() OVER ({WT}) - 1 AS x FROM ticks)
        SELECT loto, unique_id, round(CASE WHEN count(y) >= 2 THEN regr_slope(y, x) END, 6) + 0.0 AS stat_y_trend_slope FROM n GROUP BY 1, 2""",
    )
    def _(spark, sf):
        return statics.trend_slope(ticks(spark, sf), TICKS).select(*KEYS, r("stat_y_trend_slope").alias("stat_y_trend_slope"))

    @reg.add(
        "group_mode",
        f"""WITH {SERIES_SQL} SELECT loto || '__' || ts_type AS unique_id, {DAY_SQL}, round(avg(y), 6) + 0.0 AS y,
        min(unique_id) AS label FROM series GROUP BY loto, ts_type, series.ds""",
    )
    def _(spark, sf):
        out = statics.group_mode(series(spark, sf).withColumn("label", F.col("unique_id")))
        return out.select("unique_id", day("ds").alias("ds"), r("y").alias("y"), "label")

    @reg.add("horizon_from_ids", f"WITH {TICKS_SQL} SELECT count(DISTINCT unique_id) AS horizon FROM ticks")
    def _(spark, sf):
        return statics.distinct_ids(ticks(spark, sf))

    names = [f"feat_{n}" for n in ("year", "month", "day", "dayofweek", "weekofyear", "dayofyear", "is_weekend", "is_month_start", "is_month_end")]
    ints = {f"feat_{n}": e for n, e in (CALENDAR_SQL | EDGE_SQL).items() if f"feat_{n}" in names}
    cyc = [n for n in CYCLE_SQL if "doy" not in n]
    hist = HISTORY_SQL | EXPANDING_SQL
    group = "(PARTITION BY loto, unique_id, ts_type)"
    whole = {n: e for n, e in {
        "stat_y_mean": f"avg(y) OVER {group}", "stat_y_std": f"stddev_samp(y) OVER {group}", "stat_y_min": f"min(y) OVER {group}",
        "stat_y_max": f"max(y) OVER {group}", "stat_y_median": f"quantile_cont(y, 0.5) OVER {group}",
        "stat_y_q25": f"quantile_cont(y, 0.25) OVER {group}", "stat_y_q75": f"quantile_cont(y, 0.75) OVER {group}",
        "stat_y_iqr": f"quantile_cont(y, 0.75) OVER {group} - quantile_cont(y, 0.25) OVER {group}",
        "stat_y_cv": f"stddev_samp(y) OVER {group} / (abs(avg(y) OVER {group}) + 1e-9)",
        "stat_y_trend_slope": f"regr_slope(y, x) OVER {group}",
    }.items()}

    @reg.add(
        "feature_build",
        f"""WITH {SERIES_SQL}, {NUMBERED_SQL.format(src='series')}
        SELECT loto, unique_id, ts_type, {DAY_SQL}, round(y, 6) + 0.0 AS y, {_plain(ints)}, {_cycles('feat_', cyc)},
        CAST(floor((epoch_us(ds) - epoch_us(min(ds) OVER {group})) / 86400000000) AS BIGINT) AS feat_days_since_first,
        row_number() OVER ({W}) AS feat_row_no_in_group, {sql_round(hist)}, count(y) OVER {group} AS stat_y_count, {sql_round(whole)} FROM numbered""",
    )
    def _(spark, sf):
        out = build_features(series(spark, sf), SERIES)
        keep_int = [*ints, "feat_days_since_first", "feat_row_no_in_group", "stat_y_count"]
        real = [c for c in out.columns if c.startswith(("feat_", "hist_", "stat_")) and c not in keep_int and "ewm" not in c]
        return out.select(
            "loto", "unique_id", "ts_type", day("ds").alias("ds"), r("y").alias("y"),
            *[F.col(c).cast("long").alias(c) for c in keep_int], *[r(c).alias(c) for c in real],
        )

    wide = {n: e.replace(W, "PARTITION BY loto, unique_id ORDER BY ds, order_id, line_no, part_id, y") for n, e in (HISTORY_SQL | EXPANDING_SQL).items()}

    @reg.add("feature_build_lines", f"WITH {LINES_SQL} SELECT loto, unique_id, order_id, line_no, part_id, {sql_round(wide)} FROM lines")
    def _(spark, sf):
        spec = replace(LINES, order_cols=(*LINES.order_cols, "y"))
        out = windows.history_features(lines(spark, sf), spec)
        return out.select("loto", "unique_id", "order_id", "line_no", "part_id", *[r(c).alias(c) for c in wide])

    @reg.add("feature_build_anomaly")
    def _(spark, sf):
        return build_features(gappy(spark, sf), SERIES, ("base", "hist", "stat", "anomaly"), ("ecod", "copod"))


def _anomaly(reg) -> None:
    prev = f"({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
    sql = f"""WITH {GAPPY_SQL}, a AS (
      SELECT loto, unique_id, ds, lag(y, 1) OVER ({W}) AS x, count(y) OVER {PAST} AS pn, avg(y) OVER {PAST} AS pm, stddev_pop(y) OVER {PAST} AS ps,
        CASE WHEN count(y) OVER {prev} >= 7 THEN quantile_cont(y, 0.25) OVER {prev} END AS q1,
        CASE WHEN count(y) OVER {prev} >= 7 THEN quantile_cont(y, 0.75) OVER {prev} END AS q3,
        CASE WHEN count(y) OVER {prev} >= 7 THEN quantile_cont(y, 0.5) OVER {prev} END AS med,
        list(y) OVER {prev} AS vals FROM gappy),
    b AS (SELECT *, CASE WHEN pn >= 3 AND ps > 0 THEN abs((x - pm) / (ps + 1e-9)) END AS z, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
        (SELECT quantile_cont(abs(u.v - a.med), 0.5) FROM unnest(a.vals) AS u(v) WHERE u.v IS NOT NULL) AS mad FROM a),
    c AS (SELECT *, abs(0.6745 * (x - med) / (nullif(mad, 0) + 1e-9)) AS rz FROM b)
    SELECT loto, unique_id, {DAY_SQL}, round(z, 6) + 0.0 AS hist_outlier_zscore_abs, CAST(z > 3 AS DOUBLE) AS hist_outlier_flag_z3,
      round(CASE WHEN x IS NOT NULL AND q1 IS NOT NULL THEN greatest((x - hi) / (abs(iqr) + 1e-9), (lo - x) / (abs(iqr) + 1e-9), 0.0) END, 6) + 0.0 AS hist_outlier_iqr_score,
      CAST(x < lo OR x > hi AS DOUBLE) AS hist_outlier_flag_iqr, round(rz, 6) + 0.0 AS hist_outlier_robust_z_abs, CAST(rz > 3.5 AS DOUBLE) AS hist_outlier_flag_robust FROM c"""

    @reg.add("point_anomalies", sql)
    def _(spark, sf):
        out = anomaly.point_scores(gappy(spark, sf), SERIES)
        names = ["hist_outlier_zscore_abs", "hist_outlier_iqr_score", "hist_outlier_robust_z_abs"]
        flags = ["hist_outlier_flag_z3", "hist_outlier_flag_iqr", "hist_outlier_flag_robust"]
        return out.select(*KEYS, day("ds").alias("ds"), *[r(n).alias(n) for n in names], *flags)

    tails = """, t AS (SELECT *, count(y) OVER (PARTITION BY loto, unique_id ORDER BY y) AS le, count(y) OVER (PARTITION BY loto, unique_id ORDER BY y DESC) AS ge,
        count(y) OVER (PARTITION BY loto, unique_id) AS n FROM gappy),
      k AS (SELECT loto, unique_id, skewness(y) AS sk FROM gappy GROUP BY 1, 2),
      u AS (SELECT t.*, CASE WHEN y IS NOT NULL THEN -ln(le / n) END AS ul, CASE WHEN y IS NOT NULL THEN -ln(ge / n) END AS ur, sk FROM t JOIN k USING (loto, unique_id)),
      s AS (SELECT *, CASE WHEN sk < 0 THEN ul WHEN sk > 0 THEN ur ELSE ul + ur END AS uc FROM u),
      f AS (SELECT *, {score} AS sc FROM s), th AS (SELECT loto, unique_id, quantile_cont(sc, 0.9) AS q FROM f GROUP BY 1, 2)"""
    lagged = f"""SELECT loto, unique_id, {DAY_SQL}, round(CASE WHEN n >= {{least}} THEN lag(sc, 1) OVER ({W}) END, 6) + 0.0 AS score,
        CASE WHEN n >= {{least}} THEN lag(CAST(sc {{op}} q AS DOUBLE), 1) OVER ({W}) END AS flag FROM f JOIN th USING (loto, unique_id)"""

    def published(out, name):
        return out.select(*KEYS, day("ds").alias("ds"), r(f"{name}_score").alias("score"), F.col(f"{name}_flag").alias("flag"))

    for kind, score in (("ecod", "greatest(ul, ur, uc)"), ("copod", "greatest(uc, (ul + ur) / 2)")):

        def tail(spark, sf, kind=kind):
            return published(anomaly.tail_probability(gappy(spark, sf), SERIES, kind), f"hist_pyod_{kind}")

        reg.add(f"anomaly_{kind}", f"WITH {GAPPY_SQL}{tails.format(score=score)} {lagged.format(least=20, op='>')}")(tail)

    hbos = f"""WITH {GAPPY_SQL}, m AS (SELECT *, min(y) OVER g AS lo, max(y) OVER g AS hi, count(y) OVER g AS n FROM gappy WINDOW g AS (PARTITION BY loto, unique_id)),
      b AS (SELECT *, (hi - lo) / 10 AS width, CASE WHEN y IS NOT NULL THEN least(floor((y - lo) / ((hi - lo) / 10)), 9) END AS bin FROM m),
      f AS (SELECT *, CASE WHEN y IS NOT NULL THEN -log2(count(y) OVER (PARTITION BY loto, unique_id, bin) / (n * width) + 0.1) END AS sc FROM b),
      th AS (SELECT loto, unique_id, quantile_cont(sc, 0.9) AS q FROM f GROUP BY 1, 2) {lagged.format(least=20, op='>')}"""

    @reg.add("anomaly_hbos", hbos)
    def _(spark, sf):
        return published(anomaly.histogram_score(gappy(spark, sf), SERIES), "hist_pyod_hbos")

    near = ", ".join(f"abs(y - lag(y, {k}) OVER o), abs(lead(y, {k}) OVER o - y)" for k in range(1, 6))
    knn = f"""WITH {GAPPY_SQL}, d AS (SELECT loto, unique_id, ds, list_sort(list_filter([{near}], lambda v: v IS NOT NULL)) AS ds5
        FROM gappy WHERE y IS NOT NULL WINDOW o AS (PARTITION BY loto, unique_id, ts_type ORDER BY y, ds)),
      f AS (SELECT g.*, count(g.y) OVER (PARTITION BY g.loto, g.unique_id) AS n, ds5[least(5, len(ds5))] AS sc FROM gappy g LEFT JOIN d USING (loto, unique_id, ds)),
      th AS (SELECT loto, unique_id, quantile_cont(sc, 0.9) AS q FROM f GROUP BY 1, 2) {lagged.format(least=20, op='>')}"""

    @reg.add("anomaly_knn", knn)
    def _(spark, sf):
        return published(anomaly.neighbour_scores(gappy(spark, sf), SERIES), "hist_pyod_knn")

    @reg.add("anomaly_lof")
    def _(spark, sf):
        return published(anomaly.neighbour_scores(gappy(spark, sf), SERIES, 15, "lof", least=30), "hist_merlion_lof")

    thr = f"""WITH {GAPPY_SQL}, f AS (SELECT *, count(y) OVER g AS n, abs((y - avg(y) OVER g) / stddev_pop(y) OVER g) AS sc FROM gappy WINDOW g AS (PARTITION BY loto, unique_id)),
      th AS (SELECT loto, unique_id, quantile_cont(sc, 0.9) AS q FROM f GROUP BY 1, 2) {lagged.format(least=30, op='>=')}"""

    @reg.add("anomaly_threshold", thr)
    def _(spark, sf):
        return published(anomaly.threshold_score(gappy(spark, sf), SERIES), "hist_merlion_stat_threshold")

    causal = f"""WITH {GAPPY_SQL}, f AS (SELECT *, abs((y - avg(y) OVER g) / stddev_pop(y) OVER g) AS sc FROM gappy WINDOW g AS (PARTITION BY loto, unique_id)),
      m AS (SELECT *, count(sc) OVER e AS k, avg(sc) OVER e + {anomaly._normal_quantile(0.9)!r} * sqrt(var_pop(sc) OVER e) AS border FROM f WINDOW e AS (PARTITION BY loto, unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT loto, unique_id, {DAY_SQL}, round(lag(CASE WHEN k >= 30 THEN sc END) OVER o, 6) + 0.0 AS score, lag(CASE WHEN k >= 30 THEN CAST(sc >= border AS DOUBLE) END) OVER o AS flag
      FROM m WINDOW o AS (PARTITION BY loto, unique_id ORDER BY ds)"""

    @reg.add("anomaly_threshold_causal", causal)
    def _(spark, sf):
        return published(anomaly.threshold_score(gappy(spark, sf), SERIES, causal=True), "hist_merlion_stat_threshold")

    @reg.add("anomaly_isolation_forest")
    def _(spark, sf):
        return published(anomaly.isolation_scores(gappy(spark, sf), SERIES), "hist_merlion_iforest")

    @reg.add("anomaly_spectral_residual")
    def _(spark, sf):
        return published(anomaly.spectral_residual(gappy(spark, sf), SERIES), "hist_merlion_spectral_residual")

    @reg.add("matrix_profile")
    def _(spark, sf):
        out = profile.matrix_profile(gappy(spark, sf), SERIES, rows=16)
        names = ["hist_stumpy_mp_score", "hist_stumpy_mp_zscore", "hist_stumpy_discord_flag", "hist_stumpy_missing_ratio", "hist_stumpy_missing_flag"]
        return out.select(*KEYS, day("ds").alias("ds"), *[r(n, 5).alias(n) for n in names])

    @reg.add(
        "flag_share",
        f"""WITH {SERIES_SQL}, f AS (SELECT *, CASE WHEN day(ds) % 7 = 0 THEN NULL WHEN y > 12.5 THEN 1.0 ELSE 0.0 END AS flag FROM series)
        SELECT loto, unique_id, {DAY_SQL}, round(CASE WHEN count(flag) OVER w >= 2 THEN avg(flag) OVER w END, 6) + 0.0 AS share FROM f
        WINDOW w AS ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    )
    def _(spark, sf):
        df = series(spark, sf).withColumn("flag", F.when(F.dayofmonth("ds") % 7 != 0, (F.col("y") > 12.5).cast("double")))
        return anomaly.flag_share(df, SERIES, "flag", "share").select(*KEYS, day("ds").alias("ds"), r("share").alias("share"))


def _packs(reg) -> None:
    here = f"({W} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)"
    base = f"""WITH {GAPPY_SQL}, s AS (SELECT *, lag(y, 1) OVER ({W}) AS x, row_number() OVER ({W}) AS rn FROM gappy),
      p AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          first_value(x IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS v FROM s),
      o AS (SELECT *, count(x) OVER {here} AS obs FROM p),
      q AS (SELECT *, rn >= 16 AND obs >= 4 AND sum(CASE WHEN rn >= 16 AND obs >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY loto, unique_id) >= 20 AS ok FROM o)"""
    summary = {
        "w_last": "v", "w_mean": f"avg(v) OVER {here}", "w_std": f"stddev_pop(v) OVER {here}", "w_min": f"min(v) OVER {here}",
        "w_max": f"max(v) OVER {here}", "w_median": f"quantile_cont(v, 0.5) OVER {here}",
        "w_iqr": f"quantile_cont(v, 0.75) OVER {here} - quantile_cont(v, 0.25) OVER {here}", "w_abs_energy": f"sum(v * v) OVER {here}",
        "w_slope": f"regr_slope(v, rn) OVER {here}", "w_missing_ratio": "1.0 - obs / 16.0",
    }
    cols = {f"hist_autogluon_raw_{k}": f"CASE WHEN ok THEN {e} END" for k, e in summary.items()}

    @reg.add("window_summary", f"{base} SELECT loto, unique_id, {DAY_SQL}, {sql_round(cols)} FROM q")
    def _(spark, sf):
        out = embed.window_summary(gappy(spark, sf), SERIES, rows=16)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(n).alias(n) for n in cols])

    pack = {
        "sum_values": f"sum(v) OVER {here}", "median": f"quantile_cont(v, 0.5) OVER {here}", "mean": f"avg(v) OVER {here}", "length": "CAST(16 AS DOUBLE)",
        "standard_deviation": f"stddev_pop(v) OVER {here}", "variance": f"var_pop(v) OVER {here}", "root_mean_square": f"sqrt(avg(v * v) OVER {here})",
        "maximum": f"max(v) OVER {here}", "absolute_maximum": f"max(abs(v)) OVER {here}", "minimum": f"min(v) OVER {here}",
    }
    mini = {f"hist_tsfresh_{k}": f"CASE WHEN ok THEN {e} END" for k, e in pack.items()}

    @reg.add("minimal_pack", f"{base} SELECT loto, unique_id, {DAY_SQL}, {sql_round(mini)} FROM q")
    def _(spark, sf):
        out = embed.minimal_pack(gappy(spark, sf), SERIES, rows=16)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(n).alias(n) for n in mini])

    @reg.add("domain_pack")
    def _(spark, sf):
        out = embed.domain_pack(gappy(spark, sf), SERIES, rows=16)
        return out.select(*KEYS, day("ds").alias("ds"), *[r(c, 5).alias(c) for c in out.columns if c.startswith("hist_")])

    held = ", ".join(f"lag(y, {k}) OVER ({W}) AS l{k}" for k in range(16, 0, -1))
    arr = "[" + ", ".join(f"l{k}" for k in range(16, 0, -1)) + "]"
    waves = []
    for k in (1, 2, 3, 4):
        for fn in ("sin", "cos"):
            name = f"hist_chronos_{8 + 2 * (k - 1) + (fn == 'cos')}"
            terms = " + ".join(f"z[{i + 1}] * {fn}({2.0 * 3.141592653589793 * k * i / 16!r})" for i in range(16))
            waves.append((name, f"({terms}) / 16.0"))
    level = {
        "hist_chronos_1": "list_avg(z)", "hist_chronos_2": "list_stddev_pop(z)", "hist_chronos_3": "list_min(z)", "hist_chronos_4": "list_max(z)",
        "hist_chronos_5": "list_median(z)", "hist_chronos_6": "z[16]",
        "hist_chronos_7": "(" + " + ".join(f"z[{i + 1}] * ({i} - 7.5)" for i in range(16)) + ") / (340.0 + 1e-6)",
    }
    emb_sql = f"""WITH {GAPPY_SQL}, l AS (SELECT loto, unique_id, ds, row_number() OVER ({W}) - 1 AS y_idx, {held} FROM gappy),
      a AS (SELECT loto, unique_id, ds, y_idx, {arr} AS v FROM l), b AS (SELECT *, list_filter(v, lambda x: x IS NOT NULL) AS s FROM a),
      c AS (SELECT *, list_avg(s) AS m, list_stddev_pop(s) AS sd FROM b WHERE len(s) >= 4),
      e AS (SELECT *, list_transform(v, lambda x: CASE WHEN x IS NULL THEN 0.0 ELSE (x - m) / (sd + 1e-6) END) AS z FROM c)
      SELECT loto, unique_id, {DAY_SQL}, CAST(y_idx AS INTEGER) AS y_idx, {sql_round(level | dict(waves))} FROM e"""

    @reg.add("harmonic_embedding", emb_sql)
    def _(spark, sf):
        out = embed.window_embeddings(gappy(spark, sf), SERIES, dim=15, rows=16, least=4)
        wide = [r(F.get("embedding", F.lit(i))).alias(f"hist_chronos_{i + 1}") for i in range(15)]
        return out.select(*KEYS, day("ds").alias("ds"), "y_idx", *wide)

    @reg.add("projection_embedding")
    def _(spark, sf):
        out = embed.window_embeddings(gappy(spark, sf), SERIES, dim=8, rows=16, least=4, kind="projection")
        wide = embed.explode_embedding(out, 8, "uni2ts")
        return wide.select(*KEYS, day("ds").alias("ds"), "y_idx", *[r(F.col(f"hist_uni2ts_{i}").cast("double"), 4).alias(f"hist_uni2ts_{i}") for i in range(1, 9)])

    @reg.add(
        "embedding_counters",
        f"""WITH {GAPPY_SQL}, n AS (SELECT count(y) OVER ({W} ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS obs FROM gappy)
        SELECT count(*) AS rows, count(*) FILTER (obs >= 4) AS embedded, count(*) FILTER (obs < 4) AS skipped_short FROM n""",
    )
    def _(spark, sf):
        return embed.embedding_counters(gappy(spark, sf), SERIES, rows=16, least=4)

    @reg.add(
        "fit_dimension",
        "SELECT vec_id, round(list_sum(list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE))), 4) + 0.0 AS cut_sum, least(len(embedding), 10) AS cut_len, 1000 AS pad_len FROM embeddings",
    )
    def _(spark, sf):
        from .views import table

        e = table(spark, sf, "embeddings").select("vec_id", embed.fit_dim("embedding", 10).alias("cut"), embed.fit_dim("embedding", 1000).alias("pad"))
        total = F.aggregate("cut", F.lit(0.0), lambda a, v: a + v)
        return e.select("vec_id", r(total, 4).alias("cut_sum"), F.size("cut").cast("long").alias("cut_len"), F.size("pad").alias("pad_len"))

    @reg.add(
        "pooled_vectors",
        """WITH u AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
        SELECT label, i AS dim, round(avg(CAST(v AS DOUBLE)), 6) + 0.0 AS mean FROM u GROUP BY 1, 2""",
    )
    def _(spark, sf):
        from .views import table

        pooled = embed.pool_vectors(table(spark, sf, "embeddings"), ["label"])
        return pooled.select("label", F.posexplode("embedding").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), r("mean").alias("mean"))
