"""Regressions with categories of any size against dense least squares."""

from itertools import combinations

import numpy as np
import pytest

from seriesloom.operators import explain
from seriesloom.plans import effects

COLUMNS = "id int, y double, t double, x double, a string, b string, c int"


def rows(n=900, levels=(30, 7, 600), seed=1):
    r = np.random.default_rng(seed)
    a, b, c = (r.integers(k, size=n) for k in levels)
    x = r.normal(size=n) + 0.3 * b
    t = 0.5 * x + 0.2 * a + r.normal(size=n)
    y = 5 + 2 * t - x + np.sin(a) + 0.5 * b + 0.1 * (c % 5) + r.normal(size=n)
    return [(i, float(y[i]), float(t[i]), float(x[i]), None if a[i] == 3 else f"a{a[i]}", f"b{b[i]}", int(c[i])) for i in range(n)]


def design(data, numeric, categories):
    columns = [np.ones(len(data))]
    columns += [np.array([r["y t x".split().index(k) + 1] for r in data]) for k in numeric]
    for k in categories:
        values = [str(r["abc".index(k) + 4]) for r in data]
        columns += [np.array([v == w for v in values], float) for w in sorted(set(values))[1:]]
    return np.column_stack(columns)


def dense_r2(data, numeric, categories):
    y, m = np.array([r[1] for r in data]), design(data, numeric, categories)
    e = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    return m.shape[1] - 1, 1 - (e @ e) / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("dense", [effects.DENSE, 0])
def test_subsets_equal_dense_least_squares(spark, monkeypatch, dense):
    monkeypatch.setattr(effects, "DENSE", dense)
    data = rows(levels=(30, 7, 600) if dense else (4, 3, 9), n=900 if dense else 300)
    names = ["t", "x", "a", "b"] if dense else ["x", "a", "b"]
    got = {r.features: r for r in explain.subset_r2(spark.createDataFrame(data, COLUMNS), "y", names, ["a", "b", "c"]).collect()}
    assert len(got) == 2 ** len(names) - 1
    for size in range(1, len(names) + 1):
        for chosen in combinations(names, size):
            columns, r2 = dense_r2(data, [c for c in chosen if c in "tx"], [c for c in chosen if c in "abc"])
            r = got[",".join(chosen)]
            assert r["columns"] == columns and r.r2 == pytest.approx(r2 if len(data) >= columns + 2 else 0.0, abs=1e-8), chosen


def dense_hints(data, categories):
    y, t = (np.array([r[i] for r in data]) for i in (1, 2))
    y, t = (y - y.mean()) / y.std(ddof=1), (t - t.mean()) / t.std(ddof=1)
    m = np.column_stack([t, design(data, ["x"], categories)])
    inv = np.linalg.pinv(m.T @ m)
    beta = inv @ m.T @ y
    left = np.maximum(1 - np.einsum("ij,jk,ik->i", m, inv, m), 1e-8)
    scaled = m * ((y - m @ beta) / left)[:, None]
    return beta[0], np.sqrt((inv @ scaled.T @ scaled @ inv)[0, 0]), m.shape[1]


@pytest.mark.parametrize("categories", [[], ["c"], ["a", "b"]])
def test_hints_equal_dense_least_squares(spark, categories):
    data = rows(n=1500)
    got = explain.causal_hints(spark.createDataFrame(data, COLUMNS), "y", ["t"], ["x"], categories).first()
    b, se, p = dense_hints(data, categories)
    assert got["std_coef"] == pytest.approx(b, abs=1e-8) and got["controls"] == p - 2
    assert (got["ci_high_95"] - got["ci_low_95"]) / 2 / 1.959963984540054 == pytest.approx(se, rel=1e-6)


def test_one_category_of_600_values(spark):
    data = rows()
    got = {r.features: r for r in explain.subset_r2(spark.createDataFrame(data, COLUMNS), "y", ["t", "c"], ["c"]).collect()}
    for chosen in (["t"], ["c"], ["t", "c"]):
        columns, r2 = dense_r2(data, [c for c in chosen if c != "c"], [c for c in chosen if c == "c"])
        assert got[",".join(chosen)]["columns"] == columns and got[",".join(chosen)].r2 == pytest.approx(r2, abs=1e-8)


def test_hints_with_estimated_leverages(spark, monkeypatch):
    monkeypatch.setattr(effects, "DENSE", 0)
    monkeypatch.setattr(effects, "PROBES", 12)
    monkeypatch.setattr(effects, "PROBES_AT_ONCE", 12)
    data = rows(n=400, levels=(5, 4, 9))
    got = explain.causal_hints(spark.createDataFrame(data, COLUMNS), "y", ["t"], ["x"], ["a", "b"]).first()
    b, se, _ = dense_hints(data, ["a", "b"])
    assert got["std_coef"] == pytest.approx(b, abs=1e-7)
    assert (got["ci_high_95"] - got["ci_low_95"]) / 2 / 1.959963984540054 == pytest.approx(se, rel=0.03)


def test_a_hundred_thousand_values(spark):
    df = spark.range(300_000).selectExpr("int(id) AS id", "pmod(xxhash64(id), 1000) / 100 AS x", "concat('c', pmod(id * 7919, 100000)) AS c", "pmod(id * 7919, 100000) % 13 AS shift", "pmod(xxhash64(id, 1), 1000) / 1000 AS e")
    df = df.selectExpr("id", "x", "c", "3 * x + shift + e AS y", "x >= 5 AS big")
    got = {r.features: r for r in explain.subset_r2(df, "y", ["x", "c"], ["c"]).collect()}
    assert got["x,c"]["columns"] == 100_000 and got["x,c"].r2 > 0.995 > got["x"].r2
    effect = explain.proxy_effect(df.withColumn("big", df["big"].cast("string")), "y", "big", [], ["c"]).first()
    assert effect["ok"] and abs(effect["ate_proxy"]) == pytest.approx(15, abs=0.2)
