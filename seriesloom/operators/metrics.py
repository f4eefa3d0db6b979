"""Accuracy metrics, intervals and summaries of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import group_quantiles
from ..plans.series import Layout, attach, measure, over_groups
from ..spec import SeriesSpec


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def metric_columns(y: Column, p: Column) -> dict[str, Column]:
    """mae, rmse, mape and smape as aggregates over rows where both values are finite."""
    ok = _finite(y) & _finite(p)
    e = F.when(ok, F.abs(y - p))
    mid = (F.abs(y) + F.abs(p)) / 2
    return {
        "mae": F.avg(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(F.when(y != 0, e / F.abs(y))) * 100,
        "smape": F.avg(F.when(mid != 0, e / mid)) * 100,
    }


def floor_metric_columns(y: Column, p: Column) -> dict[str, Column]:
    """The variant that divides by 1e-12 where the denominator is 0."""
    e = F.abs(p - y)
    mid = (F.abs(y) + F.abs(p)) / 2
    return {
        "MAE": F.avg(e),
        "RMSE": F.sqrt(F.avg(e * e)),
        "MAPE(%)": F.avg(e / F.when(y == 0, 1e-12).otherwise(F.abs(y))) * 100,
        "sMAPE(%)": F.avg(e / F.when(mid == 0, 1e-12).otherwise(mid)) * 100,
    }


def accuracy(df: DataFrame, y: str = "y", p: str = "yhat", by: Sequence[str] = (), floor: bool = False) -> DataFrame:
    cols = (floor_metric_columns if floor else metric_columns)(F.col(y), F.col(p))
    n = F.count_if(_finite(F.col(y)) & _finite(F.col(p))).alias("n")
    return df.groupBy(*by).agg(n, *[c.alias(k) for k, c in cols.items()])


def step_accuracy(df: DataFrame, spec: SeriesSpec, p: str = "yhat", size: int = 1, layout: Layout | None = None) -> DataFrame:
    """Metrics per bucket of forecast steps. Rows are numbered before incomplete ones are dropped."""
    size = max(1, int(size))
    step = F.col("_pos") + 1
    first = F.floor((step - 1) / size) * size + 1
    numbered = over_groups(
        df, spec.keys, spec.order, lambda f, _w: f.withColumns({"_step": step, "step_from": first.cast("long")}), layout=layout
    )
    y = F.col(spec.target_col)
    done = numbered.where(y.isNotNull() & F.col(p).isNotNull())
    out = done.groupBy("step_from").agg(
        F.least(F.first("step_from") + size - 1, F.max("_step")).cast("long").alias("step_to"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(k) for k, c in metric_columns(y, F.col(p)).items()],
    )
    a, b = F.col("step_from").cast("string"), F.col("step_to").cast("string")
    return out.withColumn("step_label", F.when(a == b, a).otherwise(F.concat_ws("-", a, b)))


def point_summary(df: DataFrame, p: str = "yhat", by: Sequence[str] = (), order: Sequence[str] = ("ds",), *, first: int) -> DataFrame:
    """Count, mean, std and the first ``first`` values per group; only that many rows per group are gathered."""
    from pyspark.sql import Window

    stats = df.groupBy(*by).agg(
        F.count(p).alias("count"),
        F.avg(p).alias("mean"),
        F.when(F.count(p) > 1, F.stddev_samp(p)).otherwise(F.lit(0.0)).alias("std"),
    )
    listed = df if by else df.orderBy(*order).limit(first)  # without keys a window would bring all rows into one task
    w = Window.partitionBy(*by).orderBy(*order)
    head = listed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first)
    lists = head.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", F.col(p).alias("v")))), lambda s: s["v"]).alias("sample")
    )
    return stats.join(lists, list(by), "left") if by else stats.withColumn("sample", F.lit(lists.first()["sample"]))


def higher_quantile(df: DataFrame, by: Sequence[str], value: str, p: float, name: str, layout: Layout | None = None) -> DataFrame:
    """The smallest order statistic at or above the quantile's rank (no interpolation)."""
    seen = df.where(F.col(value).isNotNull()).select(*by, value)
    rank = F.ceil(F.round(F.lit(float(p)) * (F.col("_n") - 1), 9))
    placed = over_groups(
        seen, by, [value], lambda f, _w: f.withColumn("_hit", F.col("_pos") == rank), whole={"_n": F.count(F.lit(1))}, layout=layout
    )
    return placed.where("_hit").select(*by, F.col(value).alias(name))


def conformal_interval(df: DataFrame, y: str = "y", p: str = "yhat", coverage: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """Rows with ``lower`` and ``upper``: prediction plus or minus the quantile of the absolute residuals."""
    c = min(max(float(coverage), 0.5), 0.999)
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("_abs", F.abs(F.col(y) - F.col(p)))
    q = higher_quantile(rows, by, "_abs", c, "quantile_abs_residual")
    if by:
        layout = measure(rows, by)
        rows = attach(rows, q, by, layout.hot_groups) if not layout.plain else rows.join(q, list(by), "left")
    else:
        first = q.first()
        rows = rows.withColumn("quantile_abs_residual", F.lit(first[0] if first else None).cast("double"))
    r = F.col("quantile_abs_residual")
    return rows.withColumns({"lower": F.col(p) - r, "upper": F.col(p) + r, "coverage_target": F.lit(c)}).drop("_abs")


def interval_summary(df: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    inside = (F.col(y) >= F.col("lower")) & (F.col(y) <= F.col("upper"))
    return df.groupBy(*by).agg(
        F.max("coverage_target").alias("coverage_target"),
        F.max("quantile_abs_residual").alias("quantile_abs_residual"),
        F.avg(inside.cast("double")).alias("empirical_coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("interval_width_mean"),
    )


def residual_summary(df: DataFrame, y: str = "y", p: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(
        F.avg(e).alias("mean"),
        F.when(F.count(e) > 1, F.stddev_samp(e)).otherwise(F.lit(0.0)).alias("std"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def metric_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Count, mean, std, quartiles and range of each metric column, one row per metric that has values."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).try_cast("double").alias("value")) for m in metrics])
    long = df.select(F.explode(pairs).alias("_m")).select("_m.*").where(F.col("value").isNotNull())
    stats = long.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    wanted = {"q25": ("value", 0.25), "median": ("value", 0.5), "q75": ("value", 0.75)}
    return stats.join(group_quantiles(long, ["metric"], wanted), "metric")
