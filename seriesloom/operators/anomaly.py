"""Anomaly scores per series. Scores and flags are lagged one row so that a row only sees its past."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..plans.quantiles import with_group_quantiles
from ..plans.ranks import tail_counts
from ..plans.series import Layout, by_size, measure, over_groups
from ..spec import SeriesSpec
from .windows import full, previous


def sorted_quantile(values: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array column; NULL when empty."""
    rank = F.lit(float(p)) * (F.size(values) - 1)
    low = F.floor(rank).cast("int")
    a = F.try_element_at(values, low + 1)
    b = F.try_element_at(values, F.ceil(rank).cast("int") + 1)
    return F.when(F.size(values) > 0, a + (b - a) * (rank - low))


def point_scores(df: DataFrame, spec: SeriesSpec, rows: int = 14, layout: Layout | None = None) -> DataFrame:
    """Expanding z, rolling IQR score and rolling robust z of the previous value, each with its flag."""
    y = F.col(spec.target_col)
    least = max(3, min(rows, max(5, rows // 2)))

    def build(frame: DataFrame, w: WindowSpec) -> DataFrame:
        x = F.lag(y, 1).over(w)
        window = full(F.sort_array(F.collect_list(y).over(previous(w, rows))), y, w, rows, least)
        frame = frame.withColumns({"_x": x, "_win": window})
        frame = frame.withColumns(
            {
                "_q1": sorted_quantile(F.col("_win"), 0.25),
                "_q3": sorted_quantile(F.col("_win"), 0.75),
                "_med": sorted_quantile(F.col("_win"), 0.5),
            }
        )
        med = F.col("_med")
        frame = frame.withColumn("_dev", F.sort_array(F.transform("_win", lambda v: F.abs(v - med))))
        return frame.withColumn("_mad", sorted_quantile(F.col("_dev"), 0.5)).withColumns(_score_columns())

    helpers = ["_x", "_win", "_q1", "_q3", "_med", "_dev", "_mad"]
    return over_groups(
        df, spec.keys, spec.order, build, back=rows + 1, moments={"_past": y}, layout=layout
    ).drop(*helpers)


def _score_columns() -> dict[str, Column]:
    x = F.col("_x")
    n, mean, m2 = F.col("_past_n"), F.col("_past_mean"), F.col("_past_m2")
    sd = F.when((n >= 3) & (m2 > 0), F.sqrt(m2 / n))
    z = F.abs((x - mean) / (sd + 1e-9))
    q1, q3 = F.col("_q1"), F.col("_q3")
    iqr = q3 - q1
    low, high = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    over = F.greatest((x - high) / (F.abs(iqr) + 1e-9), (low - x) / (F.abs(iqr) + 1e-9), F.lit(0.0))
    robust = F.abs(0.6745 * (x - F.col("_med")) / (F.when(F.col("_mad") != 0, F.col("_mad")) + 1e-9))

    def flag(test: Column) -> Column:
        return test.cast("double")

    return {
        "hist_outlier_zscore_abs": z,
        "hist_outlier_flag_z3": flag(z > 3.0),
        "hist_outlier_iqr_score": F.when(x.isNotNull() & q1.isNotNull(), over),
        "hist_outlier_flag_iqr": flag((x < low) | (x > high)),
        "hist_outlier_robust_z_abs": robust,
        "hist_outlier_flag_robust": flag(robust > 3.5),
    }


@by_size
def publish(
    df: DataFrame,
    spec: SeriesSpec,
    score: str,
    name: str,
    contamination: float,
    least: int,
    strict: bool = True,
    causal: bool = False,
    layout: Layout | None = None,
) -> DataFrame:
    """Turn a raw score into the lagged ``<name>_score`` and ``<name>_flag``.

    The border is the group's ``1 - contamination`` quantile of its scores; ``causal`` uses the past rows' mean plus
    a normal quantile instead, so that no later score moves the border. Groups with fewer than ``least`` observed
    values get NULLs.
    """
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    s = F.col(score)

    if causal:
        z = _normal_quantile(1.0 - contamination)

        def build(frame, w):
            n, mean, m2 = F.col("_sc_n"), F.col("_sc_mean"), F.col("_sc_m2")
            border = F.when(n >= least, mean + z * F.sqrt(m2 / n))
            hit = (s > border) if strict else (s >= border)
            frame = frame.withColumns({"_flag": hit.cast("double"), "_seen": F.when(n >= least, s)})
            return frame.withColumns(
                {f"{name}_score": F.lag("_seen", 1).over(w), f"{name}_flag": F.lag("_flag", 1).over(w)}
            )

        out = over_groups(df, spec.keys, spec.order, build, back=1, moments={"_sc": s}, layout=layout)
        return out.drop("_flag", "_seen", score)

    marked = with_group_quantiles(df, spec.keys, {"_border": (score, 1.0 - contamination)}, layout)

    def build(frame, w):
        enough = F.col("_n_obs") >= least
        hit = (s > F.col("_border")) if strict else (s >= F.col("_border"))
        return frame.withColumns(
            {
                f"{name}_score": F.when(enough, F.lag(s, 1).over(w)),
                f"{name}_flag": F.when(enough, F.lag(hit.cast("double"), 1).over(w)),
            }
        )

    return over_groups(
        marked, spec.keys, spec.order, build, back=1, whole={"_n_obs": F.count(y)}, layout=layout
    ).drop("_border", score)


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


@by_size
def tail_probability(df: DataFrame, spec: SeriesSpec, kind: str = "ecod", contamination: float = 0.1, least: int = 20, causal: bool = False, layout: Layout | None = None) -> DataFrame:
    """ECOD / COPOD in one dimension: negative log tail probabilities of the empirical distribution."""
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    counted = tail_counts(df, spec.keys, spec.target_col, layout)
    left, right = -F.log(F.col("_le") / F.col("_n")), -F.log(F.col("_ge") / F.col("_n"))

    def build(frame, _w):
        skew = F.signum(F.round(F.col("_skew"), 12))
        chosen = F.when(skew < 0, left).when(skew > 0, right).otherwise(left + right)
        if kind == "ecod":
            score = F.greatest(left, right, chosen)
        elif kind == "copod":
            score = F.greatest(chosen, (left + right) / 2)
        else:
            raise ValueError(f"unknown tail detector: {kind}")
        return frame.withColumn("_score", F.when(y.isNotNull(), score))

    scored = over_groups(counted, spec.keys, spec.order, build, whole={"_skew": F.skewness(y)}, layout=layout)
    return publish(scored.drop("_le", "_ge", "_n"), spec, "_score", f"hist_pyod_{kind}", contamination, least, causal=causal, layout=layout)


@by_size
def histogram_score(df: DataFrame, spec: SeriesSpec, bins: int = 10, alpha: float = 0.1, contamination: float = 0.1, least: int = 20, causal: bool = False, layout: Layout | None = None) -> DataFrame:
    """HBOS: negative log density of the equal-width bin the value falls in."""
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)

    def locate(frame, _w):
        width = (F.col("_hi") - F.col("_lo")) / bins
        at = F.when(width > 0, F.least(F.floor((y - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
        return frame.withColumns({"_bin": F.when(y.isNotNull(), at.cast("int")), "_width": width})

    placed = over_groups(df, spec.keys, spec.order, locate, whole={"_lo": F.min(y), "_hi": F.max(y)}, layout=layout)
    counts = {f"_b{i}": F.count_if(F.col("_bin") == i) for i in range(bins)}

    def score(frame, _w):
        mine = F.element_at(F.array(*[F.col(c) for c in counts]), F.col("_bin") + 1)
        density = F.try_divide(mine, F.col("_nobs") * F.col("_width"))
        return frame.withColumn("_score", F.when(y.isNotNull(), -F.log2(F.coalesce(density, F.lit(0.0)) + alpha)))

    scored = over_groups(placed, spec.keys, spec.order, score, whole=counts | {"_nobs": F.count(y)}, layout=layout)
    return publish(scored.drop("_bin", "_width"), spec, "_score", "hist_pyod_hbos", contamination, least, causal=causal, layout=layout)


@by_size
def neighbour_scores(df: DataFrame, spec: SeriesSpec, k: int = 5, kind: str = "knn", contamination: float = 0.1, least: int = 20, causal: bool = False, layout: Layout | None = None) -> DataFrame:
    """One-dimensional KNN distance or LOF.

    In value order the ``k`` nearest neighbours of a row lie within ``k`` rows on either side, so frames of the sorted
    series find them exactly and no pair of rows is ever formed.
    """
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    seen, unseen = df.where(y.isNotNull()), df.where(y.isNull())

    def near(frame, w, *extra):
        both = w.rowsBetween(-k, k)
        fields = [F.col("_pos").alias("p"), y.alias("v"), *[F.col(e).alias(e) for e in extra]]
        me, mine = F.col("_pos"), y
        others = F.filter(F.collect_list(F.struct(*fields)).over(both), lambda o: o["p"] != me)
        apart = F.transform(
            others, lambda o: F.struct(F.abs(o["v"] - mine).alias("d"), o["p"].alias("p"), *[o[e].alias(e) for e in extra])
        )
        return F.slice(F.sort_array(apart), 1, k)

    def build(frame, w):
        frame = frame.withColumn("_nb", near(frame, w)).withColumn("_kd", F.array_max(F.col("_nb")["d"]))
        if kind == "knn":
            return frame.withColumn("_score", F.col("_kd"))
        frame = frame.withColumn("_nb", near(frame, w, "_kd"))
        total = F.aggregate("_nb", F.lit(0.0), lambda a, o: a + F.greatest(o["_kd"], o["d"]))
        frame = frame.withColumn("_lrd", 1.0 / (F.try_divide(total, F.size("_nb")) + 1e-10))
        frame = frame.withColumn("_nb", near(frame, w, "_lrd"))
        mean = F.try_divide(F.aggregate("_nb", F.lit(0.0), lambda a, o: a + o["_lrd"]), F.size("_nb"))
        return frame.withColumn("_score", mean / F.col("_lrd"))

    scored = over_groups(seen, spec.keys, [spec.target_col, *spec.order], build, back=3 * k, ahead=3 * k, layout=layout)
    scored = scored.drop("_nb", "_kd", "_lrd").unionByName(unseen.withColumn("_score", F.lit(None).cast("double")))
    name = "hist_pyod_knn" if kind == "knn" else "hist_merlion_lof"
    return publish(scored, spec, "_score", name, contamination, least, strict=kind == "knn", causal=causal, layout=layout)


@by_size
def threshold_score(df: DataFrame, spec: SeriesSpec, contamination: float = 0.1, least: int = 30, causal: bool = False, layout: Layout | None = None) -> DataFrame:
    """Absolute z-score against the series' own level; flagged at or above the score quantile."""
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    scored = over_groups(
        df,
        spec.keys,
        spec.order,
        lambda f, _w: f.withColumn("_score", F.abs(F.try_divide(y - F.col("_mu"), F.col("_sd")))),
        whole={"_mu": F.avg(y), "_sd": F.stddev_pop(y)},
        layout=layout,
    )
    return publish(scored, spec, "_score", "hist_merlion_stat_threshold", contamination, least, strict=False, causal=causal, layout=layout)


def _average_path(n):
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def forest_profile(values: np.ndarray, trees: int, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Isolation forest of one variable, every tree on ``sample`` of its values."""
    x = np.asarray(values, dtype=float)
    rng = np.random.default_rng(seed)
    return grown(np.stack([rng.choice(x, min(sample, x.size), replace=False) for _ in range(trees)]), rng)


def grown(picks: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Isolation forest of one variable as a step function: (start of each step, anomaly score on it).

    ``picks`` has a row of values for every tree. In one dimension every leaf is an interval, so the mean path length over the
    trees is a step function of the value. All trees grow together, one depth at a time.
    """
    trees, size = picks.shape
    picks = np.sort(picks, axis=1)
    lo, hi = picks.min(), picks.max()
    span = hi - lo if hi > lo else 1.0
    unit = (picks - lo) / span
    flat = (unit * 0.5 + np.arange(trees)[:, None]).ravel()
    tree, a, b = np.arange(trees), np.zeros(trees, int), np.full(trees, size)
    left = np.full(trees, -np.inf)
    starts, paths, owner = [], [], []
    depth, limit = 0, math.ceil(math.log2(max(size, 2)))
    while tree.size:
        lowest, highest = unit[tree, a], unit[tree, b - 1]
        done = (b - a <= 1) | (lowest >= highest) | (depth >= limit)
        starts.append(left[done])
        paths.append(depth + _average_path((b - a)[done]))
        owner.append(tree[done])
        tree, a, b, left, lowest, highest = (v[~done] for v in (tree, a, b, left, lowest, highest))
        cut = lowest + (highest - lowest) * rng.uniform(1e-9, 1.0, tree.size)
        mid = np.clip(np.searchsorted(flat, tree + cut * 0.5) - tree * size, a + 1, b - 1) if tree.size else a
        edge = lo + cut * span
        tree = np.concatenate([tree, tree])
        a, b, left = np.concatenate([a, mid]), np.concatenate([mid, b]), np.concatenate([left, edge])
        depth += 1
    starts, paths, owner = np.concatenate(starts), np.concatenate(paths), np.concatenate(owner)
    by_tree = np.lexsort((starts, owner))
    starts, paths, owner = starts[by_tree], paths[by_tree], owner[by_tree]
    first = np.r_[True, owner[1:] != owner[:-1]]
    change = np.where(first, paths, paths - np.r_[0.0, paths[:-1]])
    order = np.argsort(starts, kind="stable")
    mean = np.cumsum(change[order]) / trees
    starts = starts[order]
    last = np.r_[starts[1:] != starts[:-1], True]
    return starts[last], np.exp2(-mean[last] / max(float(_average_path(size)), 1e-12))


@by_size
def isolation_scores(df: DataFrame, spec: SeriesSpec, trees: int = 100, sample: int = 512, contamination: float = 0.1, least: int = 30, seed: int = 42, causal: bool = False, layout: Layout | None = None) -> DataFrame:
    """Isolation forest per series; every tree draws ``sample`` of all the series' values by a hash of its own.

    A row says by itself which trees may draw it (its hash for the tree lies below a border a little above the share wanted), so
    the draws are one pass and a rank within each tree; a series of ``sample`` values or fewer gives every tree all of them. The forest becomes a table of steps (series, start, score); rows find their step by an as-of match in value order.
    """
    from pyspark.sql import Window

    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    seen, unseen = df.where(y.isNotNull()), df.where(y.isNull())
    keys = spec.keys
    values = seen.select(*keys, *spec.order, y.cast("double").alias("_v"))
    counts = values.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    sized = values.join(counts, same).select(*keys, *spec.order, "_v", "_n")
    border = (sample + 6.0 * math.sqrt(sample)) / F.col("_n") * (1 << 31)
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *spec.keys, *spec.order), F.lit(1 << 31))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("t"), draw(t).alias("u")))
    large = sized.where(F.col("_n") > sample).select(*keys, *spec.order, "_v", F.explode(F.filter(drawn, lambda d: d["u"] < border)).alias("_d"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_d.t").orderBy("_d.u", *spec.order))
    large = large.withColumn("_rn", nth).where(F.col("_rn") <= sample).select(*keys, F.col("_d.t").alias("_tree"), "_v")
    pool = large.unionByName(sized.where(F.col("_n") <= sample).select(*keys, F.lit(-1).alias("_tree"), "_v"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        ordered = pdf.sort_values(["_tree", "_v"])
        if ordered["_tree"].iloc[0] < 0:
            picks = np.tile(ordered["_v"].to_numpy(), (trees, 1))
        else:
            each = [g.to_numpy() for _, g in ordered.groupby("_tree")["_v"]]
            size = min(map(len, each))
            picks = np.stack([rng.permutation(g)[:size] for g in each])
        starts, scores = grown(picks, rng)
        out = pd.DataFrame({"_start": starts, "_score": scores})
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    steps = pool.groupBy(*keys).applyInPandas(grow, f"{schema}, _start double, _score double")
    rows = seen.select(F.struct(*seen.columns).alias("_row"), *keys, y.alias("_at"), F.lit(None).cast("double").alias("_step"))
    marks = steps.select(
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *keys, F.col("_start").alias("_at"), F.col("_score").alias("_step")
    )
    both = rows.unionByName(marks)
    side = F.col("_row").isNotNull().cast("int")
    matched = over_groups(
        both.withColumn("_side", side),
        keys,
        ["_at", "_side"],
        lambda f, _w: f.withColumn("_score", F.col("_found")),
        carry={"_found": F.col("_step")},
        layout=layout if layout.plain else None,
    )
    scored = matched.where("_row is not null").select("_row.*", "_score")
    scored = scored.unionByName(unseen.withColumn("_score", F.lit(None).cast("double")))
    return publish(scored, spec, "_score", "hist_merlion_iforest", contamination, least, strict=False, causal=causal, layout=layout)


def saliency(values: np.ndarray, smooth: int = 3, local: int = 21) -> np.ndarray:
    """Spectral residual saliency of a sequence relative to its local mean."""
    x = np.asarray(values, dtype=float)
    spectrum = np.fft.fft(x)
    size = np.abs(spectrum)
    loud = np.log(np.where(size > 1e-12, size, 1e-12))
    residual = np.exp(loud - _trailing_mean(loud, smooth))
    phase = np.where(size > 1e-12, spectrum / np.where(size > 1e-12, size, 1.0), 0.0)
    map_ = np.abs(np.fft.ifft(residual * phase))
    level = _trailing_mean(map_, local)
    return (map_ - level) / np.where(level > 1e-12, level, 1e-12)


def _trailing_mean(x: np.ndarray, n: int) -> np.ndarray:
    total = np.cumsum(np.r_[0.0, x])
    i = np.arange(1, x.size + 1)
    start = np.maximum(i - n, 0)
    return (total[i] - total[start]) / (i - start)


@by_size
def spectral_residual(df: DataFrame, spec: SeriesSpec, segment: int = 4096, contamination: float = 0.1, least: int = 30, causal: bool = False, layout: Layout | None = None) -> DataFrame:
    """Spectral residual of the observed values, transformed in overlapping segments of bounded length.

    The method is defined on a window of the stream. Segments start half a length apart, the last one ends with the series, and
    every row is scored in one where it lies a quarter of the length from both ends, or as far as the series goes.
    """
    y = F.col(spec.target_col)
    layout = layout or measure(df, spec.keys)
    seen, unseen = df.where(y.isNotNull()), df.where(y.isNull())
    half, pos = segment // 2, F.col("_at")
    last = F.greatest(F.ceil((F.col("_rows") - segment) / half), F.lit(0))
    start = lambda j: F.least(j * half, F.greatest(F.col("_rows") - segment, F.lit(0)))
    near = F.floor(pos / half)
    holds = lambda j: (j >= 0) & (j <= last) & (pos >= start(j)) & (pos < start(j) + segment)
    own = F.greatest(F.least(F.floor((pos - segment // 4) / half), last), F.lit(0))
    cut = over_groups(
        seen, spec.keys, spec.order, lambda f, _w: f.withColumns({"_at": F.col("_pos"), "_rows": F.col("_n")}),
        whole={"_n": F.count(F.lit(1))}, layout=layout, fresh=True,
    )
    cut = cut.withColumns({"_own": own, "_seg": F.explode(F.array_distinct(F.filter(F.array(near - 1, near, last), holds)))})
    cut = cut.withColumn("_own", F.col("_own") == F.col("_seg")).drop("_at", "_rows")
    target, order = spec.target_col, spec.order

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(_score=saliency(pdf[target].to_numpy()))[pdf["_own"].to_numpy()].drop(columns=["_seg", "_own"])

    fields = [f for f in cut.schema if f.name not in ("_seg", "_own")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _score double"
    scored = cut.groupBy(*spec.keys, "_seg").applyInPandas(score, schema)
    scored = scored.unionByName(unseen.withColumn("_score", F.lit(None).cast("double")))
    return publish(scored, spec, "_score", "hist_merlion_spectral_residual", contamination, least, strict=False, causal=causal, layout=layout)


def flag_share(df: DataFrame, spec: SeriesSpec, flag: str, name: str, rows: int = 32, layout: Layout | None = None) -> DataFrame:
    """Mean of a flag over the last ``max(3, rows // 4)`` rows, from two observations."""
    n = max(3, rows // 4)
    f = F.col(flag)

    def build(frame, w):
        here = w.rowsBetween(-(n - 1), 0)
        return frame.withColumn(name, F.when(F.count(f).over(here) >= 2, F.avg(f).over(here)))

    return over_groups(df, spec.keys, spec.order, build, back=n, layout=layout)
