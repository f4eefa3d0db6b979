"""Whole-series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import group_quantiles
from ..plans.series import PLACED, Layout, attach, by_size, measure, over_groups
from ..spec import SeriesSpec


def trend_slope(df: DataFrame, spec: SeriesSpec, layout: Layout | None = None) -> DataFrame:
    """Least squares slope of the observed values on 0..n-1; NULL below two values."""
    y = F.col(spec.target_col)
    seen = df.where(y.isNotNull())
    numbered = over_groups(seen, spec.keys, spec.order, lambda f, _w: f.withColumn("_x", F.col("_pos").cast("double")), layout=layout, fresh=True)
    return numbered.groupBy(*spec.keys).agg(
        F.when(F.count(y) >= 2, F.regr_slope(y, F.col("_x"))).alias("stat_y_trend_slope")
    )


@by_size
def static_features(df: DataFrame, spec: SeriesSpec, layout: Layout | None = None) -> DataFrame:
    """One row per series: count, moments, quartiles, spread and trend of the target."""
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    numbered = over_groups(
        df.select(*spec.keys, *spec.order, y, *[c for c in (PLACED,) if c in df.columns]),
        spec.keys,
        spec.order,
        lambda f, _w: f.withColumn("_x", F.when(y.isNotNull(), F.col("_seen").cast("double"))),
        running={"_seen": y.isNotNull().cast("long")},
        layout=layout,
    )
    aggs = [
        F.count(y).alias("stat_y_count"),
        F.avg(y).alias("stat_y_mean"),
        F.stddev_samp(y).alias("stat_y_std"),
        F.min(y).alias("stat_y_min"),
        F.max(y).alias("stat_y_max"),
        F.when(F.count(y) >= 2, F.regr_slope(y, F.col("_x"))).alias("stat_y_trend_slope"),
    ]
    wanted = {
        "stat_y_median": (spec.target_col, 0.5),
        "stat_y_q25": (spec.target_col, 0.25),
        "stat_y_q75": (spec.target_col, 0.75),
    }
    if layout.plain:
        # Same grouping as the numbering above, so the quartiles ride along without another exchange.
        aggs += [F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]
        out = numbered.groupBy(*spec.keys).agg(*aggs)
    else:
        out = attach(numbered.groupBy(*spec.keys).agg(*aggs), group_quantiles(df, spec.keys, wanted, layout), spec.keys, layout.hot_groups)
    return out.withColumns(
        {
            "stat_y_iqr": F.col("stat_y_q75") - F.col("stat_y_q25"),
            "stat_y_cv": F.col("stat_y_std") / (F.abs("stat_y_mean") + 1e-9),
        }
    )


def group_mode(df: DataFrame, target: str = "y", id_col: str = "unique_id", time_col: str = "ds", order_col: str | None = None) -> DataFrame:
    """One series per (loto, ts_type): target and numeric columns averaged, others first non-null by ``order_col``."""
    keys = ["loto", "ts_type", time_col]
    order_col = order_col or id_col
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    aggs = []
    for name, kind in df.dtypes:
        if name in keys or name == id_col:
            continue
        if name == target or kind in numeric or kind.startswith("decimal"):
            aggs.append(F.avg(F.col(name).cast("double")).alias(name))
        else:
            aggs.append(F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order_col))).alias(name))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumn(id_col, F.concat_ws("__", F.col("loto").cast("string"), F.col("ts_type").cast("string")))


def distinct_ids(df: DataFrame, id_col: str = "unique_id", approximate: bool = False) -> DataFrame:
    """Horizon taken from the number of series."""
    ids = F.col(id_col).cast("string")
    n = F.approx_count_distinct(ids) if approximate else F.count_distinct(ids)
    return df.agg(n.cast("long").alias("horizon"))
