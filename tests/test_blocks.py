"""Groups split into blocks give the same rows as groups kept whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom import SeriesSpec
from seriesloom.operators import anomaly, drift, embed, explain, forecast, metrics, reports, runs, statics, stats, windows
from seriesloom.operators.joins import asof_join
from seriesloom.plans.features import build_features
from seriesloom.plans import quantiles
from seriesloom.plans.quantiles import group_quantiles
from seriesloom.plans.ranks import value_table

SPEC = SeriesSpec()


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("hot", 150), ("warm", 30), ("tiny", 2)):
        y = rng.normal(10, 1, n)
        y[rng.random(n) < 0.15] = np.nan
        if name == "hot":
            y[60:75] = np.nan
            y[90:110] = 9.5
        rows += [(name, "u", "raw", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=5 * i), float(v)) for i, v in enumerate(y)]
    pdf = pd.DataFrame(rows, columns=["loto", "unique_id", "ts_type", "ds", "y"])
    out = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None).cast("double"))).cache()
    out.count()
    return out


CASES = {
    "features": lambda d: build_features(d, SPEC, ("base", "hist", "stat")),
    "points": lambda d: anomaly.point_scores(d, SPEC),
    "fill": lambda d: windows.fill_values(d, SPEC, "interpolate"),
    "bfill": lambda d: windows.fill_values(d, SPEC, "bfill"),
    "windows": lambda d: windows.history_windows(d, SPEC, 6).withColumn("window", F.col("window").cast("string")),
    "statics": lambda d: statics.static_features(d, SPEC),
    "ecod": lambda d: anomaly.tail_probability(d, SPEC),
    "knn": lambda d: anomaly.neighbour_scores(d, SPEC),
    "summary": lambda d: embed.window_summary(d, SPEC, rows=8, least_windows=5),
    "ljung": lambda d: stats.ljung_box(d, SPEC.keys, ["ds"], "y", 5),
    "adf": lambda d: stats.adf(d, SPEC.keys, ["ds"], "y"),
    "cv": lambda d: forecast.cross_validation(d, SPEC, {"naive": None, "window_mean": None}, 3, windows=2),
    "interval": lambda d: metrics.conformal_interval(windows.lag_features(d, SPEC, [1]), "y", "lag_1", by=["loto"]),
    "robust_z": lambda d: runs.robust_z(d, "loto", "y", "z"),
    "ranks": lambda d: value_table(d, ["loto"], "y"),
    "quantiles": lambda d: group_quantiles(d, ["loto"], {"a": ("y", 0.1), "b": ("y", 0.5), "c": ("y", 0.93)}),
    "overall": lambda d: group_quantiles(d, [], {"a": ("y", 0.25), "b": ("y", 0.5)}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_blocked_equals_plain(frame, small_blocks, name):
    def run():
        pdf = CASES[name](frame).toPandas()
        return pdf.sort_values([c for c in pdf.columns if c in ("loto", "cutoff", "ds", "step", "y")] or list(pdf.columns)).reset_index(drop=True)

    plain = run()
    small_blocks(80)
    blocked = run()
    pd.testing.assert_frame_equal(plain, blocked[plain.columns], rtol=1e-9, atol=1e-9)


def test_asof_blocked(spark, small_blocks):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": ["a"] * 90 + ["b"] * 5, "t": rng.integers(0, 500, 95), "id": range(95)})
    right = pd.DataFrame({"k": ["a"] * 60 + ["c"] * 3, "t": rng.permutation(600)[:63], "v": rng.normal(size=63)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k").sort_values("id").reset_index(drop=True)
    for rows in (1000, 30):
        small_blocks(rows)
        got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "k", "t", "t", {"v": "v"})
        got = got.toPandas().sort_values("id").reset_index(drop=True)
        np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_drift_of_oversized_groups(frame, small_blocks):
    def run(by):
        return drift.drift(frame.where("hour(ds) < 12"), frame.where("hour(ds) >= 12"), "y", by).toPandas()

    plain = {by: run(by) for by in ((), ("loto",))}
    small_blocks(30)
    for by, want in plain.items():
        key = list(by) or ["reference_n"]
        got = run(by)
        pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), rtol=1e-9, atol=1e-9)


def test_quantiles_of_large_groups_are_exact_and_sort_nothing(spark, small_blocks, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows were sorted")

    monkeypatch.setattr(quantiles, "_by_position", refuse)
    rng = np.random.default_rng(8)
    parts = {"ties": rng.integers(0, 3, 30_000).astype(float), "wide": rng.lognormal(0, 9, 30_001), "zeros": np.where(rng.random(900) < 0.5, -0.0, 0.0), "ends": np.r_[np.full(200, -np.inf), np.arange(300.0), np.full(200, np.inf)]}
    pdf = pd.concat([pd.DataFrame({"k": k if k != "zeros" else None, "x": v, "z": v[::-1] * 2}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf.reset_index(drop=True)).withColumn("z", F.when(F.abs("z") < 1e300, F.col("z"))).repartition(7)
    small_blocks(500)
    probs = (0.0, 0.0001, 0.25, 0.5, 0.93, 1.0)
    wanted = {f"{c}{i}": (c, p) for c in "xz" for i, p in enumerate(probs)}
    got = {r["k"]: r for r in group_quantiles(df, ["k"], wanted).collect()}
    assert set(got) == {"ties", "wide", None, "ends"}
    for k, v in parts.items():
        finite = v[np.isfinite(v)]
        for i, p in enumerate(probs):
            row = got[k if k != "zeros" else None]
            assert row[f"z{i}"] == pytest.approx(np.quantile(finite * 2, p), rel=1e-12)
            if k != "ends" or 0.3 < p < 0.6:
                assert row[f"x{i}"] == pytest.approx(np.quantile(v, p), rel=1e-12)
    empty = group_quantiles(df.where("k = 'wide'").withColumn("x", F.lit(None).cast("double")), [], {"a": ("x", 0.5)}).collect()
    assert [tuple(r) for r in empty] == [(None,)]


def test_asof_of_repeated_times_moves_no_left_row(spark, small_blocks, monkeypatch):
    from seriesloom.operators import joins

    rng = np.random.default_rng(6)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 900), "t": rng.integers(0, 20, 900), "id": range(900)})
    right = pd.DataFrame({"k": ["a"] * 6 + ["b"] * 5, "t": rng.permutation(20)[:11], "v": rng.normal(size=11)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k").sort_values("id")["v"]
    small_blocks(100)
    sizes, plain = [], joins._matched
    monkeypatch.setattr(joins, "_matched", lambda rows, *rest: sizes.append(rows.count()) or plain(rows, *rest))
    nulls = spark.createDataFrame([(None, 3, 900), ("a", None, 901)], "k string, t long, id long")
    got = asof_join(spark.createDataFrame(left).unionByName(nulls), spark.createDataFrame(right), "k", "t", "t", {"v": "w"}).toPandas().sort_values("id")
    assert sizes == [len(left[["k", "t"]].drop_duplicates())] and list(got.columns) == ["k", "t", "id", "w"]
    np.testing.assert_allclose(got["w"].astype(float), [*want, np.nan, np.nan], equal_nan=True)


def counted(df, seen):
    """The frame, counting every row that is computed."""

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(look, df.schema)


def test_summary_computes_its_runs_once(spark, small_blocks):
    small_blocks()
    seen = spark.sparkContext.accumulator(0)
    cols = [F.rand(k).alias(c) for k, c in enumerate(("duration_sec", "throughput", "fail_rate", "gpu_util_avg", "db_share"))]
    df = spark.range(300).select(*cols, (F.col("id") % 3 == 0).alias("is_failed"))
    row = runs.summary_kpis(counted(df, seen)).first()
    assert row["runs"] == 300 and seen.value == 300
    assert row["duration_p90"] == pytest.approx(df.agg(F.percentile("duration_sec", F.lit(0.9))).first()[0])


def test_reports_and_regressions_compute_their_rows_once(spark, small_blocks):
    small_blocks()
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 4).cast("string").alias("b"), (F.col("id") * 7 % 31).cast("double").alias("x"), (F.rand(4) * 9).alias("y"))
    calls = {
        "drilldown": lambda d: reports.drilldown(d, "y", ["a", "b"], 2).collect(),
        "correlations": lambda d: explain.correlation_table(d, ["a", "x"], "y").collect(),
        "proxy": lambda d: explain.proxy_effect(d, "y", "x", ["a"], ["b"]).collect(),
        "hints": lambda d: explain.causal_hints(d, "y", ["x"], ["a"], ["b"]).collect(),
        "forest": lambda d: explain.forest_contribution(d, "y", ["x", "a"], ["b"], "id", trees=2, repeats=1).collect(),
    }
    for name, call in calls.items():
        seen = spark.sparkContext.accumulator(0)
        assert call(counted(rows, seen))
        assert seen.value == 300, name


def test_correlations_of_many_rows(spark, small_blocks):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"u": rng.normal(size=600), "w": rng.integers(0, 5, 600).astype(float)})
    pdf["y"] = (pdf["u"] + pdf["w"] + rng.normal(size=600)).round(1)
    pdf.loc[:50, "u"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("u", F.nanvl("u", F.lit(None).cast("double")))
    small_blocks(100)
    got = {r["feature"]: r for r in explain.correlations(df, ["u", "w"], "y", fill=False).collect()}
    for name in "uw":
        known = pdf[[name, "y"]].dropna()
        assert got[name]["n"] == len(known)
        assert got[name]["pearson"] == pytest.approx(known.corr().iloc[0, 1], rel=1e-9)
        assert got[name]["spearman"] == pytest.approx(known.rank().corr().iloc[0, 1], rel=1e-9)


def test_forecasts_see_the_whole_history(spark, small_blocks):
    r = np.random.default_rng(3)
    y = {"a": np.r_[np.cumsum(r.normal(size=300)) * 5 + 1000, r.normal(size=400)], "b": r.normal(size=9), "c": np.full(40, 7.0), "d": [3.0]}
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), float(v)) for k, values in y.items() for i, v in enumerate(values)]
    df, spec = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "ds", "y"])), SeriesSpec(("k",), "ds", "y")
    models = {"smoothing": {"alpha": 0.01}, "autoregression": None, "drift": {"window": 5}}

    def want(name, past, h):
        m = forecast.get_model(name)
        return m.predict(np.array(past, float), h, m.validate(models[name]))

    def check():
        for row in forecast.cross_validation(df, spec, models, 4, windows=3, step=3).collect():
            at = (row["cutoff"] - pd.Timestamp("2024-01-01")).days
            for name in models:
                assert row[name] == pytest.approx(want(name, y[row["k"]][: at + 1], 4)[row["step"] - 1], rel=1e-6, abs=1e-6)
        for name in models:
            for row in forecast.forecast(df, spec, name, 2, params=models[name]).collect():
                assert row["yhat"] == pytest.approx(want(name, y[row["k"]], 2)[row["step"] - 1], rel=1e-6, abs=1e-6)

    check()
    small_blocks(80)
    check()
    x = np.array([v for v in y["a"][:-4]])
    lags = np.column_stack([np.ones(len(x) - 3), x[:-3], x[1:-2], x[2:-1]])
    beta = np.linalg.lstsq(lags, x[3:], rcond=None)[0]
    got = forecast.cross_validation(df, spec, {"autoregression": None}, 4).where("k = 'a' AND step = 1").first()
    assert got["autoregression"] == pytest.approx(beta[0] + beta[1:] @ x[-3:], abs=1e-6)


@pytest.mark.parametrize("n", [30, 64, 66, 200])
def test_spectral_segments_overlap(spark, n):
    y = np.random.default_rng(n).normal(size=n)
    y[-2] = 30.0
    pdf = pd.DataFrame({"k": "a", "ds": pd.date_range("2024-01-01", periods=n), "y": y})
    out = anomaly.spectral_residual(spark.createDataFrame(pdf), SeriesSpec(("k",), "ds", "y"), segment=64).toPandas().sort_values("ds")
    want = []
    for i in range(n):
        j = min(max((i - 16) // 32, 0), max(-((64 - n) // 32), 0))
        a = min(j * 32, max(n - 64, 0))
        want.append(anomaly.saliency(y[a : a + 64])[i - a])
    score = next(c for c in out.columns if c.endswith("score"))
    assert len(out) == n
    np.testing.assert_allclose(out[score].to_numpy(float)[1:], want[:-1], rtol=1e-9, atol=1e-12)
