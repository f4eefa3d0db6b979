"""Grids over whole histories: states of sums against models that see every value."""

import json
import math

import numpy as np
import pytest

from seriesloom.operators import grid
from seriesloom.operators.forecast import get_model
from seriesloom.plans.histories import History, histories
from seriesloom.spec import SeriesSpec

SPEC = SeriesSpec(("id",), "t", "y")
ALPHAS, ORDERS, H = [0.0, 0.05, 0.3, 0.77, 1.0], [1, 2, 3, 5, 9], 6


def series():
    r = np.random.default_rng(5)
    walk = 1000 + np.cumsum(r.normal(size=260))
    wave = np.sin(np.arange(90) / 3) + r.normal(scale=0.1, size=90)
    return {"walk": walk, "wave": wave, "flat": np.full(40, 3.25), "short": r.normal(size=12), "tiny": r.normal(size=7), "none": r.normal(size=6), None: r.normal(size=33)}


def frame(spark):
    rows = [(k, i, float(v)) for k, values in series().items() for i, v in enumerate(values)]
    rows += [("walk", 1000 + i, None) for i in range(3)] + [("wave", -1, None)]
    return spark.createDataFrame(rows, "id string, t int, y double").repartition(5)


def metrics(y, guess):
    return np.abs(y - guess).mean(), math.sqrt(((y - guess) ** 2).mean())


@pytest.mark.parametrize("rows,rates", [(None, 128), (40, 2)])
def test_states_answer_like_models_of_every_value(spark, small_blocks, monkeypatch, rows, rates):
    if rows:
        small_blocks(rows)
    monkeypatch.setattr(grid, "RATES", rates)
    space = [{"model": "smoothing", "alpha": a} for a in ALPHAS] + [{"model": "autoregression", "order": k} for k in ORDERS]
    space += [{"model": "smoothing", "alpha": 0.3, "window": 8}, {"model": "naive"}, {"model": "drift", "window": 9}, {"model": "autoregression", "order": "x"}]
    tasks = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(space)], "task_order int, params string")
    got = {(r.id, r.task_order): r for r in grid.run_grid(frame(spark), SPEC, tasks, H).collect()}
    assert len(got) == len(series()) * len(space)
    for k, values in series().items():
        for i, p in enumerate(space):
            r, p = got[k, i], dict(p)
            if len(values) <= H or p.get("order") == "x":
                assert r.status == "failed" and r.n == 0
                continue
            m = get_model(p.pop("model"))
            want = metrics(values[-H:], m.predict(values[:-H], H, m.validate(p)))
            assert r.status == "success" and r.n == H
            assert np.allclose((r.mae, r.rmse), want, rtol=1e-6, atol=1e-8), (k, m.name, p, r, want)


def test_cross_products_equal_sums_over_rows(spark):
    z = np.random.default_rng(2).normal(size=25)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(z)], "id string, t int, y double")
    r = histories(df, SPEC, 4, [0.5]).first()
    past = History(r["_n"], r["_center"], r["_scale"], r["_total"], np.array(r["_products"]), {0.5: r["_decayed"][0]}, np.array(r["_first"]), np.array(r["_last"]))
    z = (z - z.mean()) / z.std()
    for k in range(1, 5):
        x = np.column_stack([np.ones(25 - k), *[z[k - lag : 25 - lag] for lag in range(k, 0, -1)], z[k:]])
        assert np.allclose(past.cross(k), x.T @ x)
    assert np.isclose(past.decayed[0.5], (0.5 ** np.arange(24, -1, -1) * z).sum())


def test_one_long_series_leaves_a_small_state(spark):
    df = spark.range(300_000).selectExpr("'a' AS id", "int(id) AS t", "sin(id / 50) + pmod(xxhash64(id), 100) / 200 AS y")
    tasks = grid.expand_grid(spark, {"model": ["smoothing"], "alpha": [round(0.01 * i, 2) for i in range(1, 41)]})
    out = grid.run_grid(df, SPEC, tasks, 10).collect()
    assert len(out) == 40 and all(r.status == "success" and r.mae < 1 for r in out)
