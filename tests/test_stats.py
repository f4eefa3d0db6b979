"""Test statistics against direct formulas, and tail probabilities against published tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom import SeriesSpec
from seriesloom.functions import dist
from seriesloom.operators import drift, explain, metrics, reports, runs, stats


def test_tail_probabilities():
    assert dist.normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert dist.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.f_sf(2.978237016, 10, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.kolmogorov_sf(1.3580986393225505) == pytest.approx(0.05, abs=1e-9)
    assert dist.kolmogorov_sf(0.5) == pytest.approx(0.9639452436648751, abs=1e-9)
    assert dist.chi2_sf(1e-9, 3) == pytest.approx(1.0)


def test_adf_surface():
    assert stats.adf_pvalue(-2.86154) == pytest.approx(0.05, abs=1e-3)
    assert stats.adf_pvalue(-3.43035) == pytest.approx(0.01, abs=5e-4)
    assert stats.adf_pvalue(5) == 1.0 and stats.adf_pvalue(-30) == 0.0


def adf_direct(x):
    n = len(x)
    top = stats.adf_max_lag(n)
    d = np.diff(x)

    def fit(k, start):
        y = d[start:]
        cols = [x[start : start + len(y)], np.ones(len(y))] + [d[start - j : start - j + len(y)] for j in range(1, k + 1)]
        z = np.column_stack(cols)
        b, *_ = np.linalg.lstsq(z, y, rcond=None)
        rss = ((y - z @ b) ** 2).sum()
        return b, rss, z, len(y)

    aics = []
    for k in range(top + 1):
        _, rss, z, m = fit(k, top)
        aics.append(m * math.log(rss / m) + 2 * z.shape[1])
    k = int(np.argmin(aics))
    b, rss, z, m = fit(k, k)
    se = math.sqrt(rss / (m - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
    return b[0] / se, m, k


def test_adf_against_direct_regression(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for name, x in {"walk": np.cumsum(rng.normal(size=150)), "noise": rng.normal(size=90), "ar": np.convolve(rng.normal(size=140), [1, 0.6, 0.3])[:120]}.items():
        want[name] = adf_direct(x)
        rows += [(name, i, float(v)) for i, v in enumerate(x)]
    rows += [("short", i, float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, y double")
    got = {r["k"]: r for r in stats.adf(df, ["k"], ["t"], "y").collect()}
    for name, (stat, nobs, lag) in want.items():
        assert got[name]["adf_stat"] == pytest.approx(stat, rel=1e-6)
        assert (got[name]["nobs"], got[name]["used_lag"]) == (nobs, lag)
    assert got["noise"]["pvalue"] < 0.01 < 0.05 < got["walk"]["pvalue"]
    assert got["short"]["adf_stat"] is None and got["short"]["nobs"] == 3


def test_granger_against_direct_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = np.r_[0, 0.8 * x[:-1]] + 0.3 * rng.normal(size=200)
    df = spark.createDataFrame([("a", i, float(x[i]), float(y[i]), float(rng.normal())) for i in range(200)], "unique_id string, ds long, x double, y double, z double")
    spec = SeriesSpec(("unique_id",))
    got = {(r["feature"], r["lag"]): r for r in stats.granger(df, spec, ["x", "z"], 3).collect()}
    for k in (1, 2, 3):
        t = y[k:]
        own = np.column_stack([np.ones(len(t))] + [y[k - j : len(y) - j] for j in range(1, k + 1)])
        both = np.column_stack([own] + [x[k - j : len(x) - j] for j in range(1, k + 1)])
        rss = [((t - m @ np.linalg.lstsq(m, t, rcond=None)[0]) ** 2).sum() for m in (own, both)]
        f = (rss[0] - rss[1]) / k / (rss[1] / (len(t) - both.shape[1]))
        assert got[("x", k)]["f_stat"] == pytest.approx(f, rel=1e-6)
    top = stats.granger_screening(df, spec, ["x", "z"], 3, 1).collect()
    assert [r["feature"] for r in top] == ["x"]


def test_ljung_box_short_and_long(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, -0.2, 0.3, -0.1])] + [("b", 0, 0.1), ("b", 1, -0.2)], "k string, t int, r double")
    got = {r["k"]: r for r in stats.ljung_box(df, ["k"], ["t"], "r", 20).collect()}
    assert (got["a"]["lags_used"], got["a"]["nobs"]) == (3, 4)
    assert got["b"]["lags_used"] == 0 and got["b"]["lb_stat"] is None
    x = np.array([0.1, -0.2, 0.3, -0.1])
    e = x - x.mean()
    q = 4 * 6 * sum((e[k:] @ e[: 4 - k] / (e @ e)) ** 2 / (4 - k) for k in (1, 2, 3))
    assert got["a"]["lb_stat"] == pytest.approx(q)
    assert got["a"]["lb_pvalue"] == pytest.approx(dist.chi2_sf(q, 3))


def test_permutation_test_levels(spark, small_blocks):
    rng = np.random.default_rng(0)
    rows = [(i, "ab"[i % 2], float(rng.normal() + (i % 2) * 2), float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, g string, far double, same double")
    for block in (262_144, 25):
        far = stats.permutation_range(df, "g", "far", "id", 200, block_rows=block).first()
        same = stats.permutation_range(df, "g", "same", "id", 200, block_rows=block).first()
        assert far["pvalue"] == pytest.approx(1 / 201)
        assert same["pvalue"] > 0.05
    flat = stats.permutation_range(df.withColumn("one", F.lit(1.0)), "g", "one", "id", 60).first()
    assert flat["pvalue"] == 1.0


def test_cell_shares_add_up():
    counts, size = np.array([40, 3, 0, 25, 1, 31]), 12
    n = int(counts.sum())
    for it in range(5):
        ranges = [counts[:2], counts[2:5], counts[5:]]
        coarse = np.array([r.sum() for r in ranges])
        cells = [[stats._cell_share(coarse, fine, g, n, size, at, 3, it) for g, fine in enumerate(ranges)] for at in range(-(-n // size))]
        assert (np.sum([np.concatenate([c[0] for c in row]) for row in cells], axis=0) == counts).all()
        for at, row in enumerate(cells):
            assert sum(int(c[0].sum()) for c in row) == min(size, n - at * size)
            assert [c[1] for c in row] == [0, int(row[0][0].sum()), int(row[0][0].sum() + row[1][0].sum())]


def test_permutation_test_of_many_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"g{i % 60}", float(rng.normal()), float(rng.normal() + (i % 60 == 7) * 6), None if i % 3 else "x") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, same double, far double, k string")
    want = None
    for block, labels in ((262_144, 65_536), (262_144, 7), (10, 7)):  # a range of labels on its own, several, several blocks
        far = stats.permutation_range(df, "g", "far", "id", 100, block_rows=block, labels=labels).first()
        same = {r.k: r for r in stats.permutation_range(df, "g", "same", "id", 100, by=["k"], block_rows=block, labels=labels).collect()}
        assert far["pvalue"] == pytest.approx(1 / 101) and far["groups"] == 60
        assert set(same) == {None, "x"} and all(0.02 < r["pvalue"] <= 1 for r in same.values())
        if block > 10:  # one block: the ranges don't change a shuffle
            want = want or {k: r["pvalue"] for k, r in same.items()}
            assert want == {k: r["pvalue"] for k, r in same.items()}


def test_permutation_test_of_very_many_labels(spark):
    df = spark.range(400_000).selectExpr("id", "pmod(id * 7919, 200000) AS g", "pmod(xxhash64(id), 1000) / 1000 AS y")
    row = stats.permutation_range(df, "g", "y", "id", 50, labels=50_000).first()
    assert row["groups"] == 200_000 and row["n"] == 400_000 and row["pvalue"] > 1 / 51


def test_mann_whitney_and_kruskal_known(spark):
    a, b = [1.1, 2.2, 3.3, 4.4, 4.4], [2.2, 5.5, 6.6, 7.7]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    got = stats.mann_whitney(df, "g", "a", "b", "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["u_stat"] == pytest.approx(u)
    assert 0 < got["pvalue"] < 1
    k = stats.kruskal(df, "g", "v").first()
    r = pd.Series(a + b).rank().to_numpy()
    h = 12 / 90 * (r[:5].sum() ** 2 / 5 + r[5:].sum() ** 2 / 4) - 30
    ties = 1 - (2 * 6) / (9**3 - 9)
    assert k["stat"] == pytest.approx(h / ties)


def test_drift_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(40)], "v double")
    out = drift.drift(df, df, "v").first()
    assert out["psi"] == pytest.approx(0.0, abs=1e-12) and out["ks_stat"] == 0.0 and out["ks_pvalue"] == pytest.approx(1.0)
    short = drift.drift(df.limit(5), df, "v").first()
    assert short["psi"] is None and short["ks_stat"] is None and short["ok"]


def test_metrics_fixture(spark):
    df = spark.createDataFrame([("A", 1, 1.0, 2.0), ("A", 2, 2.0, 2.0), ("A", 3, None, 1.0), ("B", 1, 4.0, 5.0), ("B", 2, 0.0, 1.0)], "unique_id string, ds int, y double, yhat double")
    two = metrics.accuracy(df.where("unique_id = 'A'")).first()
    assert two["mae"] == 0.5 and two["n"] == 2
    steps = {r["step_label"]: r for r in metrics.step_accuracy(df, SeriesSpec(("unique_id",)), size=2).collect()}
    assert steps["1-2"]["n"] == 4 and "3" not in steps
    wide = metrics.step_accuracy(df.withColumn("y", F.coalesce("y", F.lit(1.0))), SeriesSpec(("unique_id",)), size=2)
    assert {r["step_label"]: r["n"] for r in wide.collect()} == {"1-2": 4, "3": 1}
    assert metrics.accuracy(df.limit(0)).first()["mae"] is None


def test_conformal_uses_the_higher_order_statistic(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=57)
    df = spark.createDataFrame([(float(v), 0.0) for v in y], "y double, yhat double")
    got = metrics.interval_summary(metrics.conformal_interval(df, coverage=0.9)).first()
    assert got["quantile_abs_residual"] == pytest.approx(np.quantile(np.abs(y), 0.9, method="higher"))


def design(rng, n=80):
    t, x = rng.normal(size=n), rng.normal(size=n)
    g = rng.integers(0, 3, n)
    y = 1.5 * t - 0.5 * x + g + rng.normal(size=n) * (1 + np.abs(t))
    return t, x, g, y


def test_robust_errors_against_direct_formula(spark):
    t, x, g, y = design(np.random.default_rng(0))
    df = spark.createDataFrame([(float(a), float(b), f"m{c}", float(d)) for a, b, c, d in zip(t, x, g, y)], "t double, x double, model_name string, y double")
    got = explain.causal_hints(df, "y", ["t"], ["x"], ["model_name"]).first()
    ys, ts = (y - y.mean()) / y.std(ddof=1), (t - t.mean()) / t.std(ddof=1)
    m = np.column_stack([np.ones(len(t)), ts, x, g == 1, g == 2]).astype(float)
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ ys
    e = (ys - m @ b) / (1 - np.einsum("ij,jk,ik->i", m, inv, m))
    se = np.sqrt((inv @ (m.T * e**2) @ m @ inv)[1, 1])
    assert got["std_coef"] == pytest.approx(b[1])
    assert (got["ci_high_95"] - got["std_coef"]) / 1.959963984540054 == pytest.approx(se)


def test_proxy_effect_and_r2(spark):
    t, x, g, y = design(np.random.default_rng(2), 60)
    df = spark.createDataFrame([(float(a), float(b), f"m{c}", float(d)) for a, b, c, d in zip(t, x, g, y)], "t double, x double, model_name string, y double")
    got = explain.proxy_effect(df, "y", "t", ["x"], ["model_name"]).first()
    treat = (t >= np.median(t)).astype(float)
    m = np.column_stack([np.ones(60), treat, x, g == 1, g == 2]).astype(float)
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    assert got["ok"] and got["n"] == 60 and got["ate_proxy"] == pytest.approx(b[1])
    r2 = {r["features"]: r["r2"] for r in explain.subset_r2(df, "y", ["t", "x"]).collect()}
    assert r2["t"] == pytest.approx(np.corrcoef(t, y)[0, 1] ** 2)
    assert 0 <= r2["t,x"] <= 1
    share = explain.shapley_r2(df, "y", ["t", "x"]).collect()
    assert sum(r["shapley_rate"] for r in share) == pytest.approx(1.0)
    assert sum(r["shapley_r2_contrib"] for r in share) == pytest.approx(r2["t,x"])


@pytest.mark.parametrize("rows,limit", [(200, None), (200, 30), (3, None), (1, None)])
def test_copies_are_permutations_of_one_feature(spark, small_blocks, rows, limit):
    if limit:
        small_blocks(limit)
    df = spark.range(rows).selectExpr("id", "id * 1.5 AS x", "if(id % 7 = 0, null, concat('s', id)) AS s", "id % 3 AS other")
    out = explain.mixed_copies(df, ["x", "s"], "id", 4, seed=5).toPandas()
    order = df.withColumn("h", F.xxhash64(F.lit(5), "id")).orderBy("h", "id").toPandas()
    assert len(out) == 9 * rows
    for copy, part in out.groupby("_copy"):
        part = part.set_index("id").loc[order["id"]]
        for i, name in enumerate(["x", "s"]):
            moved = 1 + (copy - 1) % max(rows - 1, 1) if copy and (copy - 1) // 4 == i else 0
            assert np.roll(order[name].to_numpy(object), moved).tolist() == part[name].tolist()
        assert part["other"].tolist() == order["other"].tolist()


def test_exchanges_of_copies_do_not_grow(spark):
    df = spark.range(100).selectExpr("id", "id * 1.5 AS a", "id * 2.5 AS b", "id % 5 AS c")
    plans = [explain.mixed_copies(df, names, "id", k)._jdf.queryExecution().executedPlan().toString() for names, k in ((["a"], 1), (["a", "b", "c"], 20))]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_importance_of_an_ignored_feature_is_zero(spark):
    df = spark.range(100).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("a") * 3).cache()
    imp = explain.permutation_importance(df, ["a", "b"], lambda f: f.withColumn("yhat", F.col("a") * 3), "id")
    got = {r["feature"]: r["delta_mae_mean"] for r in imp.collect()}
    assert got["b"] == 0.0 and got["a"] > 0.3


def test_values_match(spark):
    cases = [("true", "1", True), ("1", "1.0", True), ("1.0000001", "1", True), ("a", "b", False), (" x ", "x", True), ("", "x", False), ("False", "0", True), ("2", "3", False)]
    df = spark.createDataFrame(cases, "e string, a string, want boolean")
    got = df.select("want", reports.values_match(F.col("e"), F.col("a")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_beta_posterior_order(spark):
    df = spark.createDataFrame([("A", "failed"), ("A", "success"), ("B", "success"), ("B", "success")], "model_name string, status string")
    got = runs.beta_posterior(df).orderBy(F.col("posterior_mean").desc()).collect()
    assert [r["model_name"] for r in got] == ["B", "A"] and got[1]["posterior_mean"] == 0.5
