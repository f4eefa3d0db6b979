"""Feature semantics on small hand-made frames and against pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom import SeriesSpec
from seriesloom.operators import anomaly, calendar, embed, profile, windows
from seriesloom.operators.prep import ensure_row_id
from seriesloom.plans.features import build_features

SPEC = SeriesSpec()


def series(spark, values, loto="A", uid="U1"):
    rows = [(loto, uid, "raw", datetime(2025, 1, 1) + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "loto string, unique_id string, ts_type string, ds timestamp, y double")


@pytest.fixture(scope="module")
def two(spark):
    return series(spark, range(1, 7)).unionByName(series(spark, range(10, 16), "B", "U2"))


def test_prefix_contract_and_values(two):
    out = build_features(two, SPEC)
    derived = [c for c in out.columns if c not in ("loto", "unique_id", "ts_type", "ds", "y")]
    assert all(c.startswith(("hist_", "stat_", "feat_")) for c in derived)
    pdf = out.toPandas().sort_values(["loto", "ds"])
    a = pdf[pdf.loto == "A"]
    assert a["stat_y_mean"].nunique() == 1 and a["stat_y_mean"].iloc[0] == 3.5
    assert a["hist_lag_1"].isna().iloc[0] and list(a["hist_lag_1"].iloc[1:3]) == [1.0, 2.0]
    assert a["stat_y_trend_slope"].iloc[0] == pytest.approx(1.0)
    assert list(a["feat_row_no_in_group"]) == [1, 2, 3, 4, 5, 6]


def test_spike_shows_one_row_later(spark):
    out = anomaly.point_scores(series(spark, [1, 1, 1, 1.1, 100, 1, 1, 1]), SPEC, rows=5).toPandas().sort_values("ds").reset_index()
    assert out.loc[5, "hist_outlier_iqr_score"] > 0 and out.loc[5, "hist_outlier_flag_iqr"] == 1.0
    assert out.loc[4, "hist_outlier_flag_iqr"] != 1.0


def test_pack_guard_leaves_values_null(two):
    out = embed.minimal_pack(two, SPEC, rows=4, least_windows=999).toPandas()
    assert out["hist_tsfresh_mean"].isna().all()
    assert out["hist_tsfresh_missing_ratio"].notna().all() and out["hist_tsfresh_missing_flag"].notna().all()


@pytest.mark.parametrize("seed", [0, 1])
def test_history_against_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.normal(5, 2, 300)
    y[rng.random(300) < 0.25] = np.nan
    y[100:160] = np.nan
    df = series(spark, [None if np.isnan(v) else v for v in y])
    got = windows.history_features(df, SPEC).toPandas().sort_values("ds").reset_index(drop=True)
    s = pd.Series(y).shift(1)
    want = {
        "hist_lag_1": s, "hist_diff_7": pd.Series(y).diff(7), "hist_roll_mean_7": s.rolling(7).mean(), "hist_roll_std_14": s.rolling(14).std(),
        "hist_roll_max_7": s.rolling(7).max(), "hist_expanding_mean": s.expanding().mean(), "hist_expanding_std": s.expanding().std(),
        "hist_ewm_mean_7": s.ewm(span=7, adjust=False).mean(), "hist_ewm_mean_14": s.ewm(span=14, adjust=False).mean(),
    }
    for name, w in want.items():
        np.testing.assert_allclose(got[name].astype(float), w, rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=name)


def test_future_frame_lengths(spark):
    one = series(spark, [1.0])
    out = calendar.future_frame(one, 3, "D").orderBy("ds").collect()
    assert [r["ds"].day for r in out] == [2, 3, 4]
    assert calendar.future_frame(one.limit(0), 3).count() == 0
    end = spark.createDataFrame([("a", datetime(2024, 1, 31))], "unique_id string, ds timestamp")
    assert [r["ds"].day for r in calendar.future_frame(end, 3, "M").orderBy("ds").collect()] == [29, 31, 30]
    with pytest.raises(ValueError):
        calendar.future_frame(one, 3, "Q")


def test_embedding_ids_and_repeatability(spark):
    df = series(spark, range(1, 7)).unionByName(series(spark, range(10, 16), "B", "U2"))
    df = df.withColumn("row_id", (F.dayofmonth("ds") + F.when(F.col("loto") == "B", 6).otherwise(0)).cast("long"))
    only = spark.createDataFrame([(2,), (4,), (7,)], "loto_y_ts_row_id long")
    out = embed.window_embeddings(df, SPEC, dim=8, rows=4, least=1, only=only)
    assert {r["loto_y_ts_row_id"] for r in out.collect()} <= {2, 4, 7}
    wide = embed.provenance(embed.explode_embedding(embed.window_embeddings(df, SPEC, dim=8, rows=4, least=2), 8, "chronos"), {"dim": 8}, "m", "1", 8)
    assert [c for c in wide.columns if c.startswith("hist_chronos_")] == [f"hist_chronos_{i}" for i in range(1, 9)]
    assert {"y_idx", "embedding_dim", "config_hash", "created_at"} <= set(wide.columns)
    again = [embed.window_embeddings(df.drop("row_id"), SPEC, dim=16, rows=5, least=2, kind="projection").orderBy("loto_y_ts_row_id").collect() for _ in range(2)]
    np.testing.assert_allclose([r["embedding"] for r in again[0]], [r["embedding"] for r in again[1]], atol=1e-6)


def test_row_ids_kept_or_hashed(spark):
    df = series(spark, [1, 2, 2])
    kept = ensure_row_id(df.withColumn("row_id", F.dayofmonth("ds") + 100), SPEC)
    assert {r["loto_y_ts_row_id"] for r in kept.collect()} == {101, 102, 103}
    doubled = df.unionByName(df)
    hashed = [r["loto_y_ts_row_id"] for r in ensure_row_id(doubled, SPEC).collect()]
    assert len(set(hashed)) == 6 and min(hashed) > 0


def test_matrix_profile_against_brute_force(spark):
    rng = np.random.default_rng(1)
    y = np.sin(np.arange(120) / 4) + 0.1 * rng.normal(size=120)
    y[60:64] += 3
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, p long, v double")
    m = 8
    got = profile.nearest_window(df, ["k"], "p", "v", m, block=25).toPandas().set_index("_start")["_dist"]
    w = np.lib.stride_tricks.sliding_window_view(y, m)
    z = (w - w.mean(1, keepdims=True)) / w.std(1, keepdims=True)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    i = np.arange(len(w))
    d[np.abs(i[:, None] - i[None]) <= 2] = np.inf
    np.testing.assert_allclose(got.sort_index(), d.min(1), atol=1e-5)
    assert len(got) == len(w)


def test_discord_flags_against_pandas(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=80)
    df = series(spark, s).withColumnRenamed("y", "sc")
    for limit in (1_000_000, 20):
        spark.conf.set("seriesloom.rowsPerTask", str(limit))
        got = profile.discord_flags(df, SPEC.with_target("sc"), "sc", "flag", 0.9, 10).orderBy("ds").toPandas()["flag"]
        spark.conf.unset("seriesloom.rowsPerTask")
        thr = pd.Series(s).shift(1).expanding(10).quantile(0.9)
        want = np.where(thr.isna(), np.nan, (s >= thr).astype(float))
        np.testing.assert_allclose(got.astype(float), want, equal_nan=True)


def test_lof_against_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=60)
    y[10] = 6.0
    df = series(spark, y)
    k = 5
    out = anomaly.neighbour_scores(df, SPEC, k, "lof", least=5).orderBy("ds").toPandas()["hist_merlion_lof_score"].astype(float)
    d = np.abs(y[:, None] - y[None])
    np.fill_diagonal(d, np.inf)
    nb = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, nb, 1).max(1)
    reach = np.maximum(kd[nb], np.take_along_axis(d, nb, 1))
    lrd = 1 / (reach.mean(1) + 1e-10)
    lof = lrd[nb].mean(1) / lrd
    np.testing.assert_allclose(out.iloc[1:], lof[:-1], rtol=1e-8)


def test_forest_profile_matches_tree_walk():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=200), 9.0]
    starts, scores = anomaly.forest_profile(x, 100, 64, 1)
    at = lambda v: scores[np.searchsorted(starts, v, side="right") - 1]
    assert at(9.0) > 0.6 > at(0.0)
    assert np.all((scores > 0) & (scores <= 1)) and starts[0] == -np.inf


def test_saliency_finds_the_spike():
    x = np.sin(np.arange(200) / 5)
    x[120] += 4
    assert np.argmax(embed_free(x)) in (119, 120, 121)


def embed_free(x):
    return anomaly.saliency(x)


def test_domain_features_on_known_signal():
    t = np.arange(64)
    x = np.sin(2 * np.pi * 8 * t / 64)[None, :]
    f = embed.spectral_features(x, 1.0)
    assert f["Fundamental frequency"][0] == pytest.approx(8 / 64)
    g = embed.statistical_features(x, 1.0)
    assert g["Root mean square"][0] == pytest.approx(np.sqrt(0.5))
    assert embed.temporal_features(np.array([[1.0, 2.0, 3.0, 4.0]]), 1.0)["Slope"][0] == pytest.approx(1.0)


@pytest.mark.parametrize("fill", ["zero", "ffill", "drop"])
def test_prepare_windows(fill):
    x = np.array([[np.nan, np.nan, 1.0, 3.0], [np.nan, np.nan, np.nan, 2.0]])
    out, keep = embed.prepare_windows(x, fill, "zscore", 2)
    assert out.shape == x.shape and keep[0]
    if fill != "ffill":
        assert not keep[1]
