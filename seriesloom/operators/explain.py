"""What moves the target: correlations, information, what-if slopes, importances and regressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dist import normal_sf
from ..plans.effects import Effects
from ..plans.grams import gram, solve
from ..plans.quantiles import group_quantiles, with_group_quantiles
from ..plans.ranks import average_rank, value_table, with_average_rank
from ..plans.series import Layout, attach, over_groups
from ..session import durable, held, rows_per_task
from .stats import permutation_range

MAX_LEVELS = 500
MAX_SUBSET_FEATURES = 16


def long_features(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = (), fill: bool = True, layout: Layout | None = None) -> DataFrame:
    """(feature, x, y) rows where the target is known; with ``fill`` missing x become the feature's median."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).try_cast("double").alias("x")) for f in features])
    rows = df.where(F.col(target).isNotNull()).select(*keep, F.col(target).cast("double").alias("y"), F.explode(pairs).alias("_p"))
    long = rows.select(*keep, "y", "_p.*")
    if not fill:
        return long.where(F.col("x").isNotNull())
    filled = with_group_quantiles(long, ["feature"], {"_med": ("x", 0.5)}, layout)
    return filled.withColumn("x", F.coalesce("x", "_med")).drop("_med")


def feature_layout(df: DataFrame, features: Sequence[str], target: str) -> Layout:
    """Every feature's group has one row per known target, so a single count tells whether the groups are oversized."""
    n = df.where(F.col(target).isNotNull()).count()
    limit = rows_per_task(df.sparkSession)
    return Layout(limit, None, len(features), n * len(features), everything=n > limit)


def correlations(df: DataFrame, features: Sequence[str], target: str = "y", fill: bool = True) -> DataFrame:
    """Pearson and Spearman of each feature with the target."""
    df = held(df.where(F.col(target).isNotNull()).select(*dict.fromkeys([*features, target])))
    layout = feature_layout(df, features, target)
    long = long_features(df, features, target, fill=fill, layout=layout)
    if layout.everything:
        return _large_correlations(long)
    ranked = with_average_rank(long, ["feature"], "x", "_rx", layout)
    ranked = with_average_rank(ranked, ["feature"], "y", "_ry", layout)
    return ranked.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), _corr(F.col("x"), F.col("y")).alias("pearson"), _corr(F.col("_rx"), F.col("_ry")).alias("spearman")
    )


def _large_correlations(long: DataFrame) -> DataFrame:
    """Correlations of features with more rows than a task holds: ranks stay on tables of distinct values, no row is joined to its own.

    The target's ranks go onto the rows, which then collapse to one row per value of x with the sum of those ranks; ranks of x
    follow from that table's order.
    """
    plain = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), _corr(F.col("x"), F.col("y")).alias("pearson"))
    table = value_table(long, ["feature"], "y").select("feature", "y", average_rank().alias("_ry"), "_c")
    table = held(table)
    # ranks are taken around their mean, so sums of their squares keep their digits
    sizes = durable(table.groupBy("feature").agg(((F.sum("_c") + 1) / 2).alias("_mid")))
    groups = sizes.count()
    table = attach(table, sizes, ["feature"], groups).withColumn("_ry", F.col("_ry") - F.col("_mid"))
    side = table.agg(F.count(F.lit(1))).first()[0]
    of_x = attach(long, table.select("feature", "y", "_ry"), ["feature", "y"], side).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("_c"), F.sum("_ry").alias("_sy"))

    def build(frame, _w):
        return frame.withColumn("_rank", F.col("_before") + (F.col("_c") + 1) / F.lit(2.0))

    of_x = over_groups(held(of_x), ["feature"], ["x"], build, running={"_before": F.col("_c")})
    rx = F.col("_rank") - F.col("_mid")
    xx = attach(of_x, sizes, ["feature"], groups).groupBy("feature").agg(F.sum(F.col("_c") * rx * rx).alias("_xx"), F.sum(rx * F.col("_sy")).alias("_xy"))
    yy = table.groupBy("feature").agg(F.sum(F.col("_c") * F.col("_ry") * F.col("_ry")).alias("_yy"))
    spearman = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    return plain.join(xx, "feature").join(yy, "feature").select("feature", "n", "pearson", spearman.alias("spearman"))


def _corr(x: Column, y: Column) -> Column:
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.corr(x, y))


def correlation_table(df: DataFrame, features: Sequence[str], target: str, least: int = 12) -> DataFrame:
    """Correlations over complete pairs for features with at least ``least`` of them, strongest first."""
    out = correlations(df, features, target, fill=False).where(F.col("n") >= least)
    return out.orderBy(F.abs("spearman").desc_nulls_last(), "feature")


def lag_correlations(df: DataFrame, features: Sequence[str], keys: Sequence[str], order: Sequence[str], target: str = "y", max_lag: int = 7) -> DataFrame:
    """Correlation of the target with each feature 0..max_lag rows earlier in the same series."""
    long = long_features(df, features, target, keep=[*keys, *order], layout=feature_layout(df, features, target))

    def build(frame, w):
        return frame.withColumns({f"_x{k}": F.lag("x", k).over(w) if k else F.col("x") for k in range(max_lag + 1)})

    lagged = over_groups(long, ["feature", *keys], order, build, back=max_lag)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_x{k}").alias("xl")) for k in range(max_lag + 1)]))
    wide = lagged.select("feature", "y", pairs.alias("_p")).select("feature", "y", "_p.*").where(F.col("xl").isNotNull())
    return wide.groupBy("feature", "lag").agg(_corr(F.col("xl"), F.col("y")).alias("corr"))


def mutual_information(df: DataFrame, features: Sequence[str], target: str = "y", bins: int = 16) -> DataFrame:
    """Plug-in mutual information on an equal-width grid (in nats)."""
    long = long_features(df, features, target, layout=feature_layout(df, features, target))
    span = long.groupBy("feature").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))

    def slot(v: str, lo: str, hi: str) -> Column:
        width = (F.col(hi) - F.col(lo)) / bins
        return F.when(width > 0, F.least(F.floor((F.col(v) - F.col(lo)) / width), F.lit(bins - 1))).otherwise(0)

    cells = (
        long.join(F.broadcast(span), "feature")
        .groupBy("feature", slot("x", "_x0", "_x1").alias("i"), slot("y", "_y0", "_y1").alias("j"))
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    g = Window.partitionBy("feature")
    cells = cells.withColumns(
        {
            "n": F.sum("c").over(g),
            "ci": F.sum("c").over(Window.partitionBy("feature", "i")),
            "cj": F.sum("c").over(Window.partitionBy("feature", "j")),
        }
    )
    return cells.groupBy("feature").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ci") * F.col("cj")))).alias("mutual_info"))


def first_rows(df: DataFrame, most: int | None) -> DataFrame:
    """All rows, or the first ``most`` where a caller asks for a top list."""
    return df if most is None else df.limit(max(1, int(most)))


def attribution_summary(correlation: DataFrame, lag_corr: DataFrame | None = None, information: DataFrame | None = None, permutation: DataFrame | None = None, top_k: int | None = None) -> DataFrame:
    """Features by the best score source there is: permutation, then information, then absolute correlation."""
    if permutation is not None:
        scores = permutation.select("feature", F.col("delta_mae_mean").alias("score"), F.lit("permutation").alias("source"))
    elif information is not None:
        scores = information.select("feature", F.col("mutual_info").alias("score"), F.lit("mutual_info").alias("source"))
    else:
        scores = correlation.select("feature", F.abs("pearson").alias("score"), F.lit("correlations").alias("source"))
    sign = correlation.select("feature", F.when(F.col("pearson") >= 0, "positive").when(F.col("pearson") < 0, "negative").alias("direction"))
    out = scores.where(F.col("score").isNotNull()).join(sign, "feature", "left")
    if lag_corr is not None:
        best = lag_corr.where(F.col("corr").isNotNull()).groupBy("feature").agg(F.max_by("lag", F.struct(F.abs("corr"), -F.col("lag"))).alias("best_lag"))
        out = out.join(best, "feature", "left")
    else:
        out = out.withColumn("best_lag", F.lit(None).cast("int"))
    return first_rows(out.orderBy(F.col("score").desc(), "feature"), top_k)


def what_if(df: DataFrame, features: Sequence[str], prediction: str = "yhat", scenarios: Sequence[Mapping] = (), top: int | None = None, pct: float = 0.05) -> DataFrame:
    """Estimated change of the prediction when a feature moves: slope of the prediction on it times the move.

    A scenario names a feature and ``delta``, ``multiplier`` or ``pct``. Without scenarios every feature (or the ``top`` ones
    of the largest variance) rises by 5 percent.
    """
    long = long_features(df, features, prediction, fill=False)
    stats = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope("y", "x").alias("slope"), F.avg("x").alias("_mean"), F.var_samp("x").alias("_var")
    )
    stats = stats.where((F.col("_n") >= 3) & (F.col("_var") > 0))
    if scenarios:
        rows = [
            (str(s.get("name") or f"{s['feature']}_scenario"), s["feature"], _num(s.get("delta")), _num(s.get("multiplier")), _num(s.get("pct", 0.0)))
            for s in scenarios
        ]
        table = df.sparkSession.createDataFrame(rows, "name string, feature string, _delta double, _mult double, _pct double")
        stats = stats.join(F.broadcast(table), "feature")
    else:
        stats = first_rows(stats.orderBy(F.col("_var").desc(), "feature"), top).withColumns(
            {
                "name": F.concat("feature", F.lit(f"+{pct:.0%}")),
                "_delta": F.lit(None).cast("double"),
                "_mult": F.lit(None).cast("double"),
                "_pct": F.lit(pct),
            }
        )
    move = F.coalesce(F.col("_delta"), F.col("_mean") * (F.col("_mult") - 1.0), F.col("_mean") * F.col("_pct"))
    return stats.select("name", "feature", move.alias("delta_x"), (F.col("slope") * move).alias("estimated_delta_y"), "slope")


def _num(v) -> float | None:
    return None if v is None else float(v)


def mixed_copies(df: DataFrame, features: Sequence[str], row_id: str, repeats: int, seed: int = 42, layout: Layout | None = None) -> DataFrame:
    """Every row as it is (``_copy`` 0) and once per feature and repeat with that feature's value from another row.

    Rows are put into a seeded hash order once. Copy ``1 + feature * repeats + repeat`` takes its feature from the row so many places
    before, the first rows from the last ones: a shift of a random order, so every copy's values are a random permutation. One
    ordered pass serves all copies, and they never meet in a join. Only the last rows of the order, one a copy, come to the driver.
    """
    names, total = list(features), df.count()
    hashed = df.withColumn("_h", F.xxhash64(F.lit(int(seed)), F.col(row_id)))
    offsets = [1 + i % max(total - 1, 1) for i in range(len(names) * repeats)]
    deep = max(offsets, default=1)
    ends = hashed.orderBy(F.col("_h").desc(), F.col(row_id).desc()).limit(deep).select(*names).collect()[::-1]
    kinds = {f.name: f.dataType for f in df.schema}

    def build(frame, w):
        new = {}
        for i, name in enumerate(names):
            tail = F.array(*[F.lit(row[name]).cast(kinds[name]) for row in ends]).cast(T.ArrayType(kinds[name]))
            own = offsets[i * repeats : (i + 1) * repeats]
            new[f"_mix_{i}"] = F.array(*[F.when(F.col("_pos") >= o, F.lag(name, o).over(w)).otherwise(F.get(tail, (F.col("_pos") + (deep - o)).cast("int"))) for o in own])
        return frame.withColumns(new)

    rows = over_groups(hashed, [], ["_h", row_id], build, back=deep, layout=layout).drop("_h")
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(len(offsets)))))
    turn = ((F.col("_copy") - 1) % repeats).cast("int")
    owned = {name: F.when((F.col("_copy") > 0) & (F.floor((F.col("_copy") - 1) / repeats) == i), F.get(f"_mix_{i}", turn)).otherwise(F.col(name)) for i, name in enumerate(names)}
    return copies.withColumns(owned).drop(*[f"_mix_{i}" for i in range(len(names))])


def _by_feature(scores: Sequence[float | None], features: Sequence[str], repeats: int) -> list[tuple[str, float | None, float | None]]:
    """Mean and deviation of each feature's scores over its repeats."""
    out = []
    for i, name in enumerate(features):
        own = [x for x in scores[i * repeats : (i + 1) * repeats] if x is not None]
        out.append((name, float(np.mean(own)) if own else None, float(np.std(own)) if own else None))
    return out


def permutation_importance(df: DataFrame, features: Sequence[str], predict: Callable[[DataFrame], DataFrame], row_id: str, target: str = "y", prediction: str = "yhat", repeats: int = 3, seed: int = 42) -> DataFrame:
    """Rise of the mean absolute error when a feature's values are shuffled.

    ``predict`` adds the prediction column to a frame, from a row's own columns. Features the model ignores come out as 0. All
    features and repeats share one ordered pass and one prediction; their errors are added up side by side.
    """
    copies = predict(mixed_copies(df, features, row_id, repeats, seed)).where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
    errors = {r["_copy"]: r["e"] for r in copies.groupBy("_copy").agg(F.avg(F.abs(F.col(target) - F.col(prediction))).alias("e")).collect()}
    base = errors.get(0)
    rise = [errors[c] - base if errors.get(c) is not None and base is not None else None for c in range(1, len(features) * repeats + 1)]
    out = [(name, mean, std, base, "permutation") for name, mean, std in _by_feature(rise, features, repeats)]
    return df.sparkSession.createDataFrame(out, "feature string, delta_mae_mean double, delta_mae_std double, base_mae double, method string")


def parameter_impact(df: DataFrame, params: Sequence[str], target: str, row_id: str, alpha: float = 0.05, n_iter: int = 600, max_values: int | None = None, numeric: Sequence[str] | None = None) -> DataFrame:
    """Per parameter with two values or more: best and worst value by mean target, effect, permutation p-value, correlation.

    Where ``max_values`` is given, parameters of more values keep their row, without a test.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [p for p in params if isinstance(kinds[p], T.NumericType)] if numeric is None else list(numeric)
    pairs = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value"), (F.col(p).cast("double") if p in numeric else F.lit(None).cast("double")).alias("num")) for p in params])
    long = df.select(F.col(row_id).alias("_id"), F.col(target).try_cast("double").alias("y"), F.explode(pairs).alias("_p"))
    long = long.select("_id", "y", "_p.*").where(F.col("y").isNotNull() & F.col("value").isNotNull())
    means = long.groupBy("parameter", "value").agg(
        F.count(F.lit(1)).alias("c"), F.avg("y").alias("m"), F.sum("num").alias("_sx"), F.sum(F.col("num") * F.col("num")).alias("_sxx"),
        F.sum(F.col("num") * F.col("y")).alias("_sxy"), F.sum("y").alias("_sy"), F.sum(F.col("y") * F.col("y")).alias("_syy"),
    )
    n = F.sum("c")
    cov = F.sum("_sxy") - F.sum("_sx") * F.sum("_sy") / n
    vx, vy = F.sum("_sxx") - F.sum("_sx") * F.sum("_sx") / n, F.sum("_syy") - F.sum("_sy") * F.sum("_sy") / n
    table = means.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("groups"),
        n.alias("sample_size"),
        F.min_by("value", F.struct("m", "value")).alias("best_value"),
        F.min("m").alias("best_mean"),
        F.max_by("value", F.struct("m", "value")).alias("worst_value"),
        F.max("m").alias("worst_mean"),
        F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("pearson_corr_numeric"),
    )
    table = table.where(F.col("groups") >= 2).withColumn("effect_abs", F.abs(F.col("worst_mean") - F.col("best_mean")))
    tested = table if max_values is None else table.where(F.col("groups") <= max_values)
    fit = long.join(F.broadcast(tested.select("parameter")), "parameter", "left_semi")
    tests = permutation_range(fit, "value", "y", "_id", n_iter=n_iter, by=["parameter"])
    out = table.join(tests.select("parameter", F.col("pvalue").alias("permutation_pvalue")), "parameter", "left")
    return out.withColumn("is_significant", F.coalesce(F.col("permutation_pvalue") < alpha, F.lit(False)))


def contribution_rates(impact: DataFrame) -> DataFrame:
    """Each effect's share of the sum of all effects (one row per parameter)."""
    effect = F.coalesce(F.col("effect_abs").try_cast("double"), F.lit(0.0))
    total = impact.agg(F.sum(effect)).first()[0] or 0.0
    return impact.withColumn("contribution_rate", effect / F.lit(total) if total > 0 else F.lit(0.0))


# --- regressions on cross products ---------------------------------------------------------------------------------------


def _levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted category values; a dense regression on more than 500 of them is refused."""
    out = {}
    for c in columns:
        rows = df.select(F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("v")).distinct().limit(MAX_LEVELS + 1).collect()
        if len(rows) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} categories")
        out[c] = sorted(r["v"] for r in rows)
    return out


def _design(df: DataFrame, numeric: Mapping[str, Column], categories: Sequence[str]) -> tuple[DataFrame, list[str]]:
    cols = {f"_x_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in numeric.items()}
    for c, levels in _levels(df, categories).items():
        text = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        for i, v in enumerate(levels[1:]):
            cols[f"_x_{c}_{i}"] = (text == F.lit(v)).cast("double")
    return df.withColumns({"_one": F.lit(1.0)} | cols), ["_one", *cols]


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    if not columns:
        return {}
    row = group_quantiles(df, [], {c: (c, 0.5) for c in columns}).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in columns}


def _fitted_on(df: DataFrame, target: Column, numeric: Mapping[str, Column], categories: Sequence[str]) -> Effects:
    """The numeric columns (``_x_<name>``) and the target (``_y``, the last) of a regression that also has categories."""
    cols = {f"_x_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in numeric.items()} | {"_y": target.cast("double")}
    return Effects(df.select(*categories, *[c.alias(n) for n, c in cols.items()]), categories, list(cols))


def _without_spanned(g: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Columns that the categories explain wholly count as zero, not as what rounding left of them."""
    kept = np.diag(g) > 1e-10 * np.maximum(np.diag(raw), 1e-300)
    return np.where(np.outer(kept, kept), g, 0.0)


def _r_squared(effects: Effects, numeric: Sequence[str], categories: Sequence[str]) -> tuple[int, float]:
    """Columns next to the intercept, and the clipped R2; 0 where the rows are too few for the columns."""
    found = effects.absorbed([c for c in effects.categories if c in categories])
    on, target = [effects.cols.index(f"_x_{c}") for c in numeric], len(effects.cols) - 1
    columns, total = len(on) + found.dummies, effects.raw[target, target]
    if effects.n < max(8, columns + 2) or total <= 0:
        return columns, 0.0
    g = _without_spanned(found.gram, effects.raw)
    rss = solve(g, target, on)[1] if on else g[target, target]
    return columns, float(min(1.0, max(0.0, 1.0 - rss / total)))


def shapley_r2(df: DataFrame, target: str, features: Sequence[str], categories: Sequence[str] = (), orders: int = 60, seed: int = 42) -> DataFrame:
    """Share of R2 per feature, averaged over sampled orders of the features.

    Cross products are summed once for every set of categories met; every subset's regression is then solved from them.
    """
    names = list(features)
    rows = df.where(F.col(target).isNotNull())
    effects = _fitted_on(rows, F.col(target), {c: F.col(c) for c in names if c not in categories}, [c for c in names if c in categories])
    held: dict[frozenset, float] = {frozenset(): 0.0}

    def value(chosen: frozenset) -> float:
        if chosen not in held:
            held[chosen] = _r_squared(effects, [c for c in names if c in chosen and c not in categories], [c for c in names if c in chosen and c in categories])[1]
        return held[chosen]

    rng = np.random.default_rng(seed)
    share = dict.fromkeys(names, 0.0)
    rounds = max(10, int(orders))
    for _ in range(rounds):
        before, chosen = 0.0, frozenset()
        for c in rng.permutation(names):
            chosen = chosen | {str(c)}
            after = value(chosen)
            share[str(c)] += max(0.0, after - before)
            before = after
    total = sum(share.values())
    out = [(c, v / rounds, v / total if total > 0 else 0.0) for c, v in share.items()]
    return df.sparkSession.createDataFrame(out, "feature string, shapley_r2_contrib double, shapley_rate double")


def subset_r2(df: DataFrame, target: str, features: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    """R2 of every non-empty subset of the features, from one pass over the data for each set of categories; there are 2**n - 1 of them."""
    names = list(features)
    if len(names) > MAX_SUBSET_FEATURES:
        raise ValueError(f"subsets of more than {MAX_SUBSET_FEATURES} features; use shapley_r2")
    rows = df.where(F.col(target).isNotNull())
    effects = _fitted_on(rows, F.col(target), {c: F.col(c) for c in names if c not in categories}, [c for c in names if c in categories])
    out = []
    for size in range(1, len(names) + 1):
        for chosen in combinations(names, size):
            out.append((",".join(chosen), *_r_squared(effects, [c for c in chosen if c not in categories], [c for c in chosen if c in categories])))
    return df.sparkSession.createDataFrame(out, "features string, columns int, r2 double")


def proxy_effect(df: DataFrame, target: str, treatment: str, numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Regression estimate of a binary treatment (at or above the median, or the most common value) with plain errors."""
    df = held(df.select(*dict.fromkeys([target, treatment, *numeric, *categories])))
    kind = df.schema[treatment].dataType
    rows = df.where(F.col(target).isNotNull())
    if isinstance(kind, T.NumericType):
        treat = F.coalesce((F.col(treatment) >= F.lit(_medians(df, [treatment])[treatment])), F.lit(False))
    else:
        top = df.groupBy(F.col(treatment).cast("string").alias("v")).count().orderBy(F.col("count").desc(), "v").first()
        treat = F.coalesce(F.col(treatment).cast("string").eqNullSafe(F.lit(top["v"] if top else None)), F.lit(False))
    med = _medians(rows, numeric)
    effects = _fitted_on(rows, F.col(target), {"_treat": treat} | {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in numeric}, categories)
    schema = "ok boolean, n long, treatment_col string, ate_proxy double, std_error double, z_score double, ci_low_95 double, ci_high_95 double"
    n = effects.n
    if n < 20 or not 0.0 < effects.means[0] < 1.0:
        return df.sparkSession.createDataFrame([(False, n, treatment, None, None, None, None, None)], schema)
    found = effects.absorbed(effects.categories)
    on = list(range(len(effects.cols) - 1))
    beta, rss, inv = solve(_without_spanned(found.gram, effects.raw), len(on), on)
    se = math.sqrt(max(1e-12, rss / max(1, n - 1 - len(on) - found.dummies) * inv[0, 0]))
    b = float(beta[0])
    return df.sparkSession.createDataFrame([(True, n, treatment, b, se, b / se, b - 1.96 * se, b + 1.96 * se)], schema)


def causal_hints(df: DataFrame, target: str, treatments: Sequence[str], numeric: Sequence[str], categories: Sequence[str], top: int | None = None) -> DataFrame:
    """Standardised coefficient of each numeric treatment with controls and HC3 errors, strongest first.

    Two passes per treatment: cross products for the coefficients, then leverages and squared residuals for the errors. Leverages
    are exact but for several categories of more than 1000 values together, where they are estimated from random signs.
    """
    out = []
    df = held(df.select(*dict.fromkeys([target, *treatments, *numeric, *categories])))
    for t in treatments:
        if t == target:
            continue
        own = [c for c in numeric if c != t]
        rows = df.where(F.col(target).isNotNull() & F.col(t).isNotNull())
        s = rows.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(t).alias("k"), F.avg(target).alias("ym"), F.stddev_samp(target).alias("ys"),
            F.avg(t).alias("tm"), F.stddev_samp(t).alias("ts"),
        ).first()
        if s["n"] < 30 or s["k"] < 4 or not s["ys"] or not s["ts"]:
            continue
        med = _medians(rows, own)
        treat = (F.col(t).cast("double") - F.lit(s["tm"])) / F.lit(s["ts"])
        effects = _fitted_on(rows, (F.col(target).cast("double") - F.lit(s["ym"])) / F.lit(s["ys"]), {"_treat": treat} | {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in own}, categories)
        found = effects.absorbed(effects.categories)
        n, cols = effects.n, effects.cols[:-1]
        p = 1 + len(cols) + found.dummies
        if n < p - 1 + 12:
            continue
        beta, _, inv = solve(_without_spanned(found.gram, effects.raw), len(cols), list(range(len(cols))))
        weighted = _hc3(effects.residuals(effects.categories), cols, beta, inv)
        meat = np.array(gram(weighted, [], cols).first()["gram"], float).reshape(len(cols), len(cols))
        cov = inv @ meat @ inv
        b, se = float(beta[0]), math.sqrt(max(cov[0, 0], 0.0))
        pv = 2.0 * normal_sf(abs(b / se)) if se > 0 else None
        out.append((t, b, pv, b - 1.959963984540054 * se, b + 1.959963984540054 * se, n, p - 2, bool(pv is not None and pv < 0.05), "positive" if b >= 0 else "negative", abs(b)))
    schema = "treatment string, std_coef double, pvalue double, ci_low_95 double, ci_high_95 double, n long, controls int, significant boolean, direction string, abs_std_coef double"
    table = df.sparkSession.createDataFrame(out, schema)
    return first_rows(table.orderBy(F.col("significant").desc(), F.col("abs_std_coef").desc()), top)


def _hc3(rows: DataFrame, cols: Sequence[str], beta: np.ndarray, inv: np.ndarray) -> DataFrame:
    """Rows of residual columns scaled by residual / (1 - leverage); ``_h`` is the leverage of all else."""
    names = list(cols)

    def scale(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            e = pdf["_y"].to_numpy(float) - x @ beta
            h = pdf["_h"].to_numpy(float) + np.einsum("ij,jk,ik->i", x, inv, x)
            pdf[names] = x * (e / np.maximum(1.0 - h, 1e-8))[:, None]
            yield pdf[names]

    picked = rows.select(*[F.col(c).cast("double").alias(c) for c in [*names, "_y", "_h"]])
    return picked.mapInPandas(scale, ", ".join(f"`{c}` double" for c in names))


def forest_contribution(df: DataFrame, target: str, numeric: Sequence[str], categories: Sequence[str], row_id: str, trees: int = 400, repeats: int = 24, top: int | None = None, seed: int = 42, least: int = 12) -> DataFrame:
    """Permutation importance (loss of R2 on held-out rows) under a random forest, and each column's share of it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = df.where(F.col(target).isNotNull()).select(*dict.fromkeys([row_id, *numeric, *categories]), F.col(target).cast("double").alias("_y"))
    rows = held(rows)
    med = _medians(rows, numeric)
    design, cols = _design(rows, {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in numeric}, categories)
    cols = cols[1:]
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(10))
    data = design.select(F.col(row_id).alias("_id"), "_y", *cols, (spot < 3).alias("_test"))
    counts = data.agg(F.count_if("_test").alias("te"), F.count_if(~F.col("_test")).alias("tr")).first()
    schema = "feature string, importance_mean double, importance_std double, contribution_rate double, model_r2 double, model_mae double, n_train long, n_test long"
    if counts["te"] < 4 or counts["tr"] < 6 or counts["te"] + counts["tr"] < least or len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    pack = VectorAssembler(inputCols=cols, outputCol="features")
    forest = RandomForestRegressor(labelCol="_y", numTrees=trees, minInstancesPerNode=2, seed=seed, predictionCol="_p")
    model = forest.fit(pack.transform(data.where(~F.col("_test"))))
    test = data.where("_test")
    mean = test.agg(F.avg("_y")).first()[0]

    e = F.col("_y") - F.col("_p")
    copies = model.transform(pack.transform(mixed_copies(test, cols, "_id", repeats, seed)))
    found = copies.groupBy("_copy").agg(
        (1.0 - F.sum(e * e) / F.sum(F.pow(F.col("_y") - F.lit(mean), F.lit(2)))).alias("r2"), F.avg(F.abs(e)).alias("mae")
    )
    scores = {r["_copy"]: r for r in found.collect()}
    base = scores[0]
    loss = [base["r2"] - scores[c]["r2"] if base["r2"] is not None else None for c in range(1, len(cols) * repeats + 1)]
    table = df.sparkSession.createDataFrame(_by_feature(loss, [c[3:] for c in cols], repeats), "feature string, importance_mean double, importance_std double")
    table = first_rows(table.orderBy(F.col("importance_mean").desc(), "feature"), top)
    gain = F.greatest(F.col("importance_mean"), F.lit(0.0))
    total = F.sum(gain).over(Window.partitionBy(F.lit(1)))  # one row a column
    return table.withColumns(
        {
            "contribution_rate": F.when(total > 0, gain / total).otherwise(0.0),
            "model_r2": F.lit(base["r2"]),
            "model_mae": F.lit(base["mae"]),
            "n_train": F.lit(counts["tr"]),
            "n_test": F.lit(counts["te"]),
        }
    )
