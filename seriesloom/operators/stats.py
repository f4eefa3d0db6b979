"""Statistical tests computed from sums, value counts and cross-product matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import f_sf, normal_sf, p_value
from ..plans.grams import gram, solve
from ..plans.quantiles import group_quantiles, with_group_quantiles
from ..plans.ranks import average_rank, value_table
from ..plans.series import BROADCAST_ROWS, Layout, attach, measure, over_groups
from ..session import durable
from ..spec import SeriesSpec


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """No grouping is one constant group, so that every test has a single plan shape."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(1)), ["_all"])


# --- autocorrelation ---------------------------------------------------------------------------------------------------


def lag_products(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int, layout: Layout | None = None) -> DataFrame:
    """Per group: ``n``, ``g0`` and ``g1..g<lags>``, the sums of centred products at each lag."""
    v = F.col(value)
    seen = df.where(v.isNotNull()).select(*keys, *[c for c in order if c not in keys], v)

    def build(frame, w):
        dev = v - F.col("_mu")
        cols = {"_g0": dev * dev}
        cols |= {f"_g{k}": dev * (F.lag(v, k).over(w) - F.col("_mu")) for k in range(1, lags + 1)}
        return frame.withColumns(cols)

    prods = over_groups(seen, keys, order, build, back=lags, whole={"_mu": F.avg(v)}, layout=layout)
    sums = [F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(lags + 1)]
    return prods.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), *sums)


def ljung_box(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, lags: int = 20, least: int = 3, clip: bool = True, layout: Layout | None = None) -> DataFrame:
    """Ljung-Box statistic per group. ``clip`` lowers the lag to n - 1; otherwise short groups stay NULL."""
    df, keys = _keyed(df, by)
    sums = lag_products(df, keys, order, value, lags, layout)
    n = F.col("n")
    used = F.greatest(F.least(F.lit(lags), n - 1), F.lit(1)) if clip else F.lit(lags)
    total = F.lit(0.0)
    for k in range(1, lags + 1):
        total = total + F.when(used >= k, F.try_divide(F.pow(F.col(f"g{k}") / F.col("g0"), F.lit(2)), n - k)).otherwise(0.0)
    ok = (n >= least) & (F.col("g0") > 0)
    out = sums.select(
        *keys,
        n.alias("nobs"),
        F.when(n >= least, used).otherwise(0).cast("long").alias("lags_used"),
        F.when(ok, n * (n + 2) * total).alias("lb_stat"),
    )
    out = out.withColumn("lb_pvalue", p_value("chi2", F.col("lb_stat"), F.when(F.col("lags_used") > 0, F.col("lags_used"))))
    return out.drop("_all")


# --- unit root ---------------------------------------------------------------------------------------------------------

# Published response surfaces of the unit-root statistic with a constant.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_BORDERS = (-18.83, -1.61, 2.74)  # below the first p = 0, above the last p = 1; the middle one parts the two fits
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def adf_pvalue(stat: float) -> float:
    low, middle, high = ADF_BORDERS
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    fit = ADF_SMALL if stat <= middle else ADF_LARGE
    return normal_sf(-sum(c * stat**i for i, c in enumerate(fit)))


def adf_max_lag(n: int) -> int:
    return max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


def adf(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, layout: Layout | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the lag is chosen by AIC on the common sample, then refitted.

    Regressions of all lags are read off one cross-product matrix per group. The few rows that only shorter lags can use
    are kept aside (at most the largest lag per group) and added for the refit.
    """
    df, keys = _keyed(df, by)
    v = F.col(value)
    seen = df.where(v.isNotNull()).select(*keys, *order, v)
    layout = layout or measure(seen, keys)
    sizes = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    top = adf_max_lag(int(longest))
    names = ["_y", "_level", "_one", *[f"_d{k}" for k in range(1, top + 1)]]

    def build(frame, w):
        def step(k):
            return F.lag(v, k).over(w) - F.lag(v, k + 1).over(w)

        cols = {"_y": v - F.lag(v, 1).over(w), "_level": F.lag(v, 1).over(w), "_one": F.lit(1.0)}
        cols |= {f"_d{k}": F.coalesce(step(k), F.lit(0.0)) for k in range(1, top + 1)}
        return frame.withColumns(cols | {"_i": F.col("_pos") - 1, "_size": F.col("_n")})

    rows = over_groups(seen, keys, order, build, back=top + 1, whole={"_n": F.count(F.lit(1))}, layout=layout)
    rows = rows.where((F.col("_i") >= 0) & (F.col("_size") >= 4))
    limit = F.greatest(F.least(F.floor(F.col("_size") / 2) - 2, F.ceil(12.0 * F.pow(F.col("_size") / 100.0, F.lit(0.25)))), F.lit(0))
    rows = rows.withColumn("_p", limit.cast("int"))
    common = gram(rows.where(F.col("_i") >= F.col("_p")), [*keys, "_size", "_p"], names)
    early = (
        rows.where(F.col("_i") < F.col("_p"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_i", F.array(*names).alias("x")))).alias("_early"))
    )
    joined = common.join(early, keys, "left")
    width = len(names)

    def solve_group(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            results = [
                _adf_row(np.array(g, float).reshape(width, width), int(n), int(p), e)
                for g, n, p, e in zip(pdf["gram"], pdf["n"], pdf["_p"], pdf["_early"])
            ]
            out[["adf_stat", "pvalue", "nobs", "used_lag"]] = pd.DataFrame(results, index=out.index)
            yield out

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    solved = joined.mapInPandas(solve_group, f"{types}, adf_stat double, pvalue double, nobs double, used_lag double")
    out = sizes.join(solved, keys, "left")
    nobs = F.coalesce(F.col("nobs"), F.col("_n")).cast("double")
    crit = [
        F.when(F.col("adf_stat").isNotNull(), sum(c / F.pow(nobs, F.lit(float(i))) for i, c in enumerate(cs))).alias(f"crit_{k.rstrip('%')}")
        for k, cs in ADF_CRITICAL.items()
    ]
    return out.select(*keys, "adf_stat", "pvalue", nobs.cast("long").alias("nobs"), F.col("used_lag").cast("int").alias("used_lag"), *crit).drop("_all")


def _adf_row(g: np.ndarray, n: int, p: int, early) -> tuple:
    """Lag by AIC on the common rows, then the statistic with every row that lag can use."""
    base = [1, 2]
    best, best_aic = 0, math.inf
    for k in range(p + 1):
        on = base + [3 + j for j in range(k)]
        _, rss, _ = solve(g, 0, on)
        aic = n * math.log(max(rss, 1e-300) / n) + 2 * len(on)
        if aic < best_aic - 1e-12:
            best, best_aic = k, aic
    full, rows = g.copy(), n
    for item in early if early is not None else []:
        if item["_i"] >= best:
            x = np.array(item["x"], float)
            full += np.outer(x, x)
            rows += 1
    on = base + [3 + j for j in range(best)]
    beta, rss, inv = solve(full, 0, on)
    df = rows - len(on)
    if df <= 0 or rss <= 0:
        return (None, None, rows, best)
    stat = beta[0] / math.sqrt(rss / df * inv[0, 0])
    return (stat, adf_pvalue(stat), rows, best)


# --- predictive causality ------------------------------------------------------------------------------------------------


def granger(df: DataFrame, spec: SeriesSpec, features: Sequence[str], max_lag: int = 8) -> DataFrame:
    """F test per (feature, lag): do the feature's lags help beyond the target's own lags?

    Lags never cross series. All features travel as one long frame; rows are put into classes by how many lags they have,
    one small matrix per (feature, class) is summed, and every lag's regression uses the classes that can serve it.
    """
    y = F.col(spec.target_col)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_x")) for f in features]))
    long = df.select(*spec.keys, *spec.order, y.alias("_y"), pairs.alias("_p")).select(*spec.keys, *spec.order, "_y", "_p.*")
    long = long.where(F.col("_y").isNotNull() & F.col("_x").isNotNull())

    def build(frame, w):
        cols = {"_one": F.lit(1.0), "_have": F.least(F.col("_pos"), F.lit(max_lag)).cast("int")}
        for k in range(1, max_lag + 1):
            cols[f"_y{k}"] = F.coalesce(F.lag("_y", k).over(w), F.lit(0.0))
            cols[f"_x{k}"] = F.coalesce(F.lag("_x", k).over(w), F.lit(0.0))
        return frame.withColumns(cols)

    rows = over_groups(long, ["feature", *spec.keys], spec.order, build, back=max_lag)
    names = ["_y", "_one", *[f"_y{k}" for k in range(1, max_lag + 1)], *[f"_x{k}" for k in range(1, max_lag + 1)]]
    grams = gram(rows, ["feature", "_have"], names)
    width = len(names)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {int(h): (np.array(g, float).reshape(width, width), int(n)) for h, g, n in zip(pdf["_have"], pdf["gram"], pdf["n"])}
        out = []
        for k in range(1, max_lag + 1):
            use = [v for h, v in held.items() if h >= k]
            if not use:
                continue
            g, n = sum(u[0] for u in use), sum(u[1] for u in use)
            own = [1, *[1 + j for j in range(1, k + 1)]]
            both = own + [1 + max_lag + j for j in range(1, k + 1)]
            free = n - len(both)
            if free <= 0:
                continue
            _, rss_own, _ = solve(g, 0, own)
            _, rss_both, _ = solve(g, 0, both)
            f = ((rss_own - rss_both) / k) / (rss_both / free) if rss_both > 0 else float("inf")
            out.append((pdf["feature"].iloc[0], k, n, f, f_sf(f, k, free) if math.isfinite(f) else 0.0))
        return pd.DataFrame(out, columns=["feature", "lag", "nobs", "f_stat", "pvalue"])

    return grams.groupBy("feature").applyInPandas(test, "feature string, lag int, nobs long, f_stat double, pvalue double")


def granger_screening(df: DataFrame, spec: SeriesSpec, features: Sequence[str], max_lag: int = 8, top_k: int | None = None) -> DataFrame:
    """Features by their smallest p-value and the lag it occurs at."""
    tests = granger(df, spec, features, max_lag)
    best = tests.groupBy("feature").agg(F.min("pvalue").alias("min_pvalue"), F.min_by("lag", F.struct("pvalue", "lag")).alias("best_lag"))
    ranked = best.orderBy("min_pvalue", "feature")
    return ranked if top_k is None else ranked.limit(top_k)


# --- forecast comparison -------------------------------------------------------------------------------------------------


def diebold_mariano(df: DataFrame, y: str, p1: str, p2: str, power: int = 2, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Plain-variance test of equal loss."""
    d = F.pow(F.abs(F.col(y) - F.col(p1)), F.lit(power)) - F.pow(F.abs(F.col(y) - F.col(p2)), F.lit(power))
    stats = df.withColumn("_d", d).groupBy(*by).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_loss_diff"), F.var_samp("_d").alias("_v"))
    ok = (F.col("n") >= least) & (F.col("_v") > 0)
    out = stats.withColumn("dm_stat", F.when(ok, F.col("mean_loss_diff") / F.sqrt(F.col("_v") / F.col("n")))).drop("_v")
    return out.withColumn("pvalue", p_value("normal2", F.col("dm_stat")))


def diebold_mariano_hac(df: DataFrame, e1: str, e2: str, order: Sequence[str], h: int = 1, power: int = 2, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """The test with a long-run variance: Bartlett weights over h - 1 lags."""
    df, keys = _keyed(df, by)
    d = F.pow(F.abs(F.col(e1)), F.lit(power)) - F.pow(F.abs(F.col(e2)), F.lit(power))
    lags = max(int(h) - 1, 0)
    sums = lag_products(df.withColumn("_d", d), keys, order, "_d", lags)
    spread = F.col("g0")
    for k in range(1, lags + 1):
        spread = spread + 2.0 * (1.0 - k / (lags + 1.0)) * F.col(f"g{k}")
    n = F.col("n")
    t = F.when((n >= least) & (spread > 0), F.col("mean") / (F.sqrt(spread) / n))
    out = sums.select(*keys, n, t.alias("dm_t"), F.col("mean").alias("mean_d"))
    return out.withColumn("dm_pvalue", p_value("normal2", F.col("dm_t"))).drop("_all")


# --- group differences ---------------------------------------------------------------------------------------------------


def permutation_range(df: DataFrame, label: str, value: str, row_id: str, n_iter: int = 500, seed: int = 42, by: Sequence[str] = (), block_rows: int = 262_144, labels: int = 65_536) -> DataFrame:
    """Permutation p-value of the range of group means, per outer group.

    Shuffling the whole table once per round would move it hundreds of times. A uniform shuffle can instead be drawn in two
    steps: first how many rows of each label fall into each block of rows (a hypergeometric draw), then a shuffle inside the
    block. Rows are dealt to blocks in the order of a hash of their id, and only label sums leave a block. Labels are cut into ranges
    of ``labels``, and a task holds one block and one range, so neither rows nor labels of a group ever meet in one place.
    """
    n_iter = int(max(50, n_iter))
    df, keys = _keyed(df.where(F.col(label).isNotNull() & F.col(value).isNotNull()), by)
    sizes = durable(df.groupBy(*keys, F.col(label).cast("string").alias("_l")).agg(F.count(F.lit(1)).alias("_c"), F.avg(value).alias("_m")))
    group = sizes.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("groups"), (F.max("_m") - F.min("_m")).alias("observed"))
    plan = group.where("groups >= 2 AND observed > 0")
    # labels in order, cut into ranges: the labels' sizes of one range, and the ranges' sizes of a group
    placed = over_groups(sizes, keys, ["_l"], lambda f, _w: f.withColumns({"_i": F.col("_pos"), "_g": F.floor(F.col("_pos") / labels)}))
    ranges = placed.groupBy(*keys, "_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_c"))), lambda x: x["_c"]).alias("_fine"), F.sum("_c").alias("_size"))
    ranges = durable(ranges)
    coarse = ranges.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_g", "_size"))), lambda x: x["_size"]).alias("_coarse"))
    if (ranges.agg(F.max("_g")).first()[0] or 0) > 0:
        block_rows *= 16  # many labels: fewer blocks, whose sums of every label must meet
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.xxhash64(F.lit(seed), F.col(row_id)).alias("_h"), F.col(row_id).alias("_id"))
    # Exact places in hash order give blocks of exactly block_rows rows, so block sizes follow from the group's size.
    dealt = over_groups(rows, keys, ["_h", "_id"], lambda f, _w: f.withColumns({"_at": F.col("_pos"), "_b": F.floor(F.col("_pos") / block_rows)}))
    packed = dealt.groupBy(*keys, "_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("_rows"))
    about = attach(attach(ranges, coarse, keys, BROADCAST_ROWS + 1), plan.select(*keys, "_n"), keys, BROADCAST_ROWS + 1).where(F.col("_n").isNotNull())
    names = [f"_k{i}" for i in range(len(keys))]
    about = about.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_g", "_fine", "_coarse", "_n")
    same = reduce(lambda x, y: x & y, [packed[k].eqNullSafe(about[n]) for k, n in zip(keys, names)])
    cells = packed.join(about, same).drop(*names)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def shuffle(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                block, g, n = (row.column(c)[0].as_py() for c in ("_b", "_g", "_n"))
                values, fine, total = (np.asarray(row.column(c)[0].values) for c in ("_rows", "_fine", "_coarse"))
                alone = n <= block_rows
                for first in range(0, n_iter, rounds):
                    turns = range(first, min(first + rounds, n_iter))
                    sums, high, low = [], [], []
                    for it in turns:
                        share, begin = _cell_share(total, fine, g, n, block_rows, block, seed, it)
                        mixed = np.random.default_rng([seed & 0x7FFFFFFF, 7, block, it]).permutation(values)
                        ends = begin + np.cumsum(share)
                        run = np.concatenate([[0.0], np.cumsum(mixed)])
                        found = run[ends] - run[ends - share]
                        if alone:
                            high.append(float((found / fine).max()))
                            low.append(float((found / fine).min()))
                        else:
                            sums.append(found.tolist())
                    k = len(turns)
                    same = [row.column(c).take(pa.array([0] * k)) for c in keys]
                    ends = [pa.array(high, pa.float64()), pa.array(low, pa.float64())] if alone else [pa.nulls(k, pa.float64())] * 2
                    held = pa.nulls(k, pa.list_(pa.float64())) if alone else pa.array(sums, pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*same, pa.array([g] * k, pa.int64()), pa.array(list(turns), pa.int32()), *ends, held], names=[*keys, "_g", "_it", "_hi", "_lo", "_sums"])

    rounds = max(1, 4_000_000 // labels)
    drawn = cells.mapInArrow(shuffle, f"{types}, _g long, _it int, _hi double, _lo double, _sums array<double>")
    # where a group has several blocks, their sums of a range's labels are added up before the means are compared
    several = drawn.where(F.col("_sums").isNotNull()).groupBy(*keys, "_g", "_it").agg(F.collect_list("_sums").alias("_all_sums"))
    several = several.withColumn("_sums", F.reduce("_all_sums", F.lit(None).cast("array<double>"), lambda x, y: F.when(x.isNull(), y).otherwise(F.zip_with(x, y, lambda u, v: u + v))))
    fine = ranges.select(*keys, "_g", "_fine")
    several = attach(several.drop("_all_sums"), fine, [*keys, "_g"], BROADCAST_ROWS + 1).withColumn("_means", F.zip_with("_sums", "_fine", lambda u, c: u / c))
    several = several.select(*keys, "_it", F.array_max("_means").alias("_hi"), F.array_min("_means").alias("_lo"))
    each = drawn.where(F.col("_sums").isNull()).select(*keys, "_it", "_hi", "_lo").unionByName(several)
    turned = each.groupBy(*keys, "_it").agg((F.max("_hi") - F.min("_lo")).alias("_r"))
    turned = attach(turned, plan.select(*keys, F.col("observed").alias("_o")), keys, BROADCAST_ROWS + 1)
    hits = turned.groupBy(*keys).agg(F.count_if(F.col("_r") >= F.col("_o") * (1 - 1e-12)).alias("_ge"))
    out = attach(group, hits, keys, BROADCAST_ROWS + 1)
    p = F.when(F.col("groups") < 2, F.lit(None)).when(F.col("observed") <= 0, F.lit(1.0)).otherwise((F.col("_ge") + 1) / F.lit(n_iter + 1.0))
    return out.select(*keys, F.col("_n").alias("n"), "groups", "observed", p.alias("pvalue")).drop("_all")


def _cell_share(coarse: np.ndarray, fine: np.ndarray, g: int, n: int, size: int, at: int, seed: int, it: int) -> tuple[np.ndarray, int]:
    """How many rows of each label of range ``g`` land in block ``at`` in round ``it``, and how many of the ranges before.

    Halving the block list keeps the cost at log(blocks) draws. At every node a hypergeometric draw tells what share of each range goes
    left, and another one what share of each label of this range; generators are seeded by the node (and the range), so all cells
    see the same draws and their shares add up without talking to each other.
    """
    lo, hi = 0, -(-n // size)
    coarse, fine = coarse.astype(np.int64), fine.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        node = [seed & 0x7FFFFFFF, it, lo, hi]
        first = np.random.default_rng(node).multivariate_hypergeometric(coarse, (mid - lo) * size, method="marginals")
        mine = np.random.default_rng([*node, g + 1]).multivariate_hypergeometric(fine, int(first[g]), method="marginals")
        if at < mid:
            hi, coarse, fine = mid, first, mine
        else:
            lo, coarse, fine = mid, coarse - first, fine - mine
    return fine, int(coarse[:g].sum())


def jarque_bera(df: DataFrame, value: str, by: Sequence[str] = (), alpha: float = 0.05, least: int = 8) -> DataFrame:
    """Normality from skewness and (raw) kurtosis; the chi-square(2) tail has a closed form."""
    v = F.col(value)
    s = df.groupBy(*by).agg(F.count(v).alias("n"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3.0).alias("kurtosis"))
    stat = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.pow(F.col("kurtosis") - 3.0, F.lit(2)) / 4.0)
    ok = F.col("n") >= least
    out = s.withColumns({"jb_stat": F.when(ok, stat), "skew": F.when(ok, F.col("skew")), "kurtosis": F.when(ok, F.col("kurtosis"))})
    out = out.withColumn("pvalue", F.exp(-F.col("jb_stat") / 2))
    return out.withColumn("reject_normality", F.col("pvalue") < alpha)


def mann_whitney(df: DataFrame, label: str, a, b, value: str, by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Rank-sum statistic of group ``a`` against ``b`` with the tie- and continuity-corrected normal p-value."""
    df, keys = _keyed(df.where(F.col(label).isin(a, b) & F.col(value).isNotNull()), by)
    t = value_table(df, keys, value, {"_a": F.col(label) == F.lit(a)})
    s = t.groupBy(*keys).agg(
        F.sum(F.col("_a") * average_rank()).alias("_r"),
        F.sum("_a").alias("n_a"),
        F.sum("_c").alias("_n"),
        F.sum(F.pow(F.col("_c").cast("double"), F.lit(3)) - F.col("_c")).alias("_ties"),
    )
    n1, n = F.col("n_a"), F.col("_n")
    n2 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2.0
    mu = n1 * n2 / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.when(sd > 0, (F.greatest(u, n1 * n2 - u) - mu - 0.5) / sd)
    ok = (n1 >= least) & (n2 >= least)
    out = s.select(*keys, n1, n2.alias("n_b"), F.when(ok, u).alias("u_stat"), F.when(ok, z).alias("z"))
    return out.withColumn("pvalue", F.least(p_value("normal2", F.greatest("z", F.lit(0.0))), F.lit(1.0))).drop("_all")


def levene(df: DataFrame, label: str, value: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Equality of spread around group medians; groups below ``least`` values are left out."""
    df, keys = _keyed(df.where(F.col(label).isNotNull() & F.col(value).isNotNull()), by)
    centred = with_group_quantiles(df.select(*keys, label, F.col(value).cast("double").alias("_v")), [*keys, label], {"_med": ("_v", 0.5)})
    z = centred.withColumn("_z", F.abs(F.col("_v") - F.col("_med")))
    g = z.groupBy(*keys, label).agg(F.count("_z").alias("_n"), F.avg("_z").alias("_m"), (F.var_pop("_z") * F.count("_z")).alias("_w")).where(F.col("_n") >= least)
    w = Window.partitionBy(*keys)
    g = g.withColumn("_all_m", F.sum(F.col("_n") * F.col("_m")).over(w) / F.sum("_n").over(w))
    s = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("_n").alias("n"),
        F.sum("_w").alias("_within"),
        F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_all_m"), F.lit(2))).alias("_between"),
    )
    k, n = F.col("groups"), F.col("n")
    stat = F.when((k >= 2) & (F.col("_within") > 0), (n - k) / (k - 1) * F.col("_between") / F.col("_within"))
    out = s.withColumn("stat", stat)
    return out.withColumn("pvalue", p_value("f", F.col("stat"), k - 1, n - k)).drop("_within", "_between", "_all")


def kruskal(df: DataFrame, label: str, value: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Rank test of equal location over all groups with at least ``least`` values."""
    df, keys = _keyed(df.where(F.col(label).isNotNull() & F.col(value).isNotNull()), by)
    big = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_g")).where(F.col("_g") >= least)
    kept = df.join(big.select(*keys, label), [*keys, label], "left_semi")
    t = value_table(kept, keys, value)
    ties = t.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.pow(F.col("_c").cast("double"), F.lit(3)) - F.col("_c")).alias("_ties"))
    counts = kept.groupBy(*keys, label, value).agg(F.count(F.lit(1)).alias("_k"))
    ranked = counts.join(t.select(*keys, value, average_rank().alias("_rank")), [*keys, value])
    g = ranked.groupBy(*keys, label).agg(F.sum("_k").alias("_n"), F.sum(F.col("_k") * F.col("_rank")).alias("_r"))
    s = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q")).join(ties, keys)
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("_q") - 3.0 * (n + 1)
    fix = 1.0 - F.col("_ties") / (n * n * n - n)
    out = s.withColumn("stat", F.when((F.col("groups") >= 2) & (fix > 0), h / fix))
    return out.withColumn("pvalue", p_value("chi2", F.col("stat"), F.col("groups") - 1)).drop("_q", "_ties", "_all")


def welch(df: DataFrame, label: str, a, b, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance t test and Cohen's d of two groups, from moments alone."""
    df, keys = _keyed(df.where(F.col(label).isin(a, b)), by)

    def part(g: str, x) -> list[Column]:
        v = F.when(F.col(label) == F.lit(x), F.col(value))
        return [F.count(v).alias(f"n_{g}"), F.avg(v).alias(f"mean_{g}"), F.var_samp(v).alias(f"_v_{g}")]

    s = df.groupBy(*keys).agg(*part("a", a), *part("b", b))
    na, nb, va, vb = F.col("n_a"), F.col("n_b"), F.col("_v_a"), F.col("_v_b")
    ea, eb = va / na, vb / nb
    diff = F.col("mean_a") - F.col("mean_b")
    ok = (na >= 2) & (nb >= 2)
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    out = s.withColumns(
        {
            "welch_t": F.when(ok & (ea + eb > 0), diff / F.sqrt(ea + eb)),
            "welch_df": F.when(ok & (ea + eb > 0), F.pow(ea + eb, F.lit(2)) / (ea * ea / (na - 1) + eb * eb / (nb - 1))),
            "cohens_d": F.when(ok & (pooled > 0), diff / pooled),
        }
    ).drop("_v_a", "_v_b")
    return out.withColumn("welch_pvalue", p_value("t2", F.col("welch_t"), F.col("welch_df"))).drop("_all")


def crosstab(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """Rows per group by whether the flag holds."""
    return df.groupBy(group).agg(F.count_if(~flag).alias("not_failed"), F.count_if(flag).alias("failed"))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Independence of two categories; two-by-two tables get the Yates correction."""
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row, col).agg(F.count(F.lit(1)).alias("o"))
    rows_ = cells.groupBy(row).agg(F.sum("o").alias("_r"))
    cols_ = cells.groupBy(col).agg(F.sum("o").alias("_c"))
    size = rows_.agg(F.sum("_r").alias("n"), F.count(F.lit(1)).alias("kr")).first()
    kc = cols_.count()
    n, kr = size["n"] or 0, size["kr"]
    dof = (kr - 1) * (kc - 1)
    # Cells that do not occur count as zero: their expected value is what is missing from the expected total.
    grid = cells.join(rows_, row).join(cols_, col).withColumn("e", F.col("_r") * F.col("_c") / F.lit(float(max(n, 1))))
    gap = F.abs(F.col("o") - F.col("e"))
    gap = gap - F.least(F.lit(0.5), gap) if dof == 1 else gap
    if dof == 1:
        full = rows_.select(row, "_r").withColumn("_j", F.lit(1)).join(cols_.select(col, "_c").withColumn("_j", F.lit(1)), "_j").drop("_j")
        grid = full.join(cells, [row, col], "left").fillna(0, ["o"]).withColumn("e", F.col("_r") * F.col("_c") / F.lit(float(max(n, 1))))
        out = grid.agg(F.sum(gap * gap / F.col("e")).alias("chi2_stat"))
    else:
        out = grid.agg((F.sum(gap * gap / F.col("e")) + (F.lit(float(n)) - F.sum("e"))).alias("chi2_stat"))
    out = out.withColumns({"dof": F.lit(dof).cast("long"), "n": F.lit(n).cast("long")})
    return out.withColumn("p_value", p_value("chi2", F.col("chi2_stat"), F.when(F.col("dof") > 0, F.col("dof"))))


def rejection_summary(df: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """How often stored p-values fall below alpha, and their median."""
    pairs = F.array(*[F.struct(F.lit(c).alias("diagnostic"), F.col(c).try_cast("double").alias("p")) for c in columns])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.*").where(F.col("p").isNotNull())
    s = long.groupBy("diagnostic").agg(F.count("p").alias("n"), F.avg((F.col("p") < alpha).cast("double")).alias("rejection_rate"))
    return s.join(group_quantiles(long, ["diagnostic"], {"median_pvalue": ("p", 0.5)}), "diagnostic").withColumn("alpha", F.lit(alpha))
