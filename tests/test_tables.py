"""Sources, sinks, preparation, joins, logs, JSON, grids and forecasts on small fixtures."""

import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seriesloom import SeriesSpec
from seriesloom.functions import jsonflat, text
from seriesloom.operators import events, forecast, grid, joins, prep, reports, runs
from seriesloom.operators.windows import latest_per
from seriesloom.sources import readers, runner, writers

SPEC = SeriesSpec(("unique_id",))


def day(n):
    return datetime(2025, 1, n)


def test_loader_names():
    assert readers.loader_name("postgres") == "db_table" and readers.loader_name("ndjson") == "jsonl"
    assert readers.loader_name("query") == "sql" and readers.loader_name("unknown") == "db_table"


def test_files_folders_and_globs(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    (tmp_path / "a.csv").write_text("unique_id,ds,y\nA,2025-01-01,1\n")
    (tmp_path / "nested" / "b.csv").write_text("unique_id,ds,y\nB,2025-01-02,2\n")
    (tmp_path / "c.jsonl").write_text('{"unique_id": "C", "y": 3}\n{"unique_id": "D", "y": 4}\n')
    assert readers.read_files(spark, str(tmp_path / "a.csv"), "csv").count() == 1
    assert readers.read_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "nested")], "csv").count() == 2
    assert readers.read_files(spark, str(tmp_path / "*.csv"), "csv").count() == 1
    assert readers.read_files(spark, str(tmp_path / "nested"), "csv", load_all=False).first()["unique_id"] == "B"
    assert readers.read_files(spark, str(tmp_path / "c.jsonl"), "ndjson").count() == 2
    out = readers.load_dataset(spark, "csv", path=str(tmp_path / "a.csv"), schema="unique_id string, ds string, y double")
    assert out.first()["ds"] == day(1)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        readers.read_source(spark.range(1).withColumnRenamed("id", "y"), SPEC)


def test_standard_columns(spark):
    df = spark.createDataFrame([("s", "2025-01-02", "2"), ("s", "2025-01-01", "1"), ("s", "bad", "3")], "series string, date string, target string")
    out = readers.standard_columns(df).orderBy("ds").collect()
    assert [r["y"] for r in out] == [1.0, 2.0] and out[0]["unique_id"] == "s"
    assert readers.standard_columns(df.drop("series")).first()["unique_id"] == "series_0"


def test_event_log_files(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"ts": "2025-01-01", "level": "INFO"}\nnot json\n{"ts": "2025-01-03", "level": "ERROR"}\n')
    got = readers.read_events(spark, str(tmp_path), last=1).collect()
    assert [r["level"] for r in got] == ["ERROR"]
    assert readers.read_events(spark, str(tmp_path)).count() == 2


def test_write_modes_and_alignment(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    writers.write_table(df, path, "fail")
    writers.write_table(df.select("id"), path, "append")
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.where("name is null").count() == 1 and back.columns == ["id", "name"]
    with pytest.raises(ValueError, match="not in the target"):
        writers.write_table(df.withColumn("extra", F.lit(1)), path, "append")
    with pytest.raises(ValueError):
        writers.write_mode("merge")
    with pytest.raises(Exception):
        writers.write_table(df, path, "fail")
    writers.write_table(df, path, "replace")
    assert spark.read.parquet(path).count() == 1


def test_outputs_and_fast_mode(spark, tmp_path):
    df = spark.range(3)
    p = {k: str(tmp_path / k) for k in ("t", "c", "p", "s")}
    assert writers.write_outputs(df, table_path=p["t"], csv_path=p["c"], parquet_path=p["p"], spark_path=p["s"]) == ["table", "csv", "parquet", "spark"]
    assert spark.read.csv(p["c"], header=True).count() == 3
    assert writers.write_outputs(df, table_path=p["t"], csv_path=str(tmp_path / "x"), fast=True) == ["table"]
    assert not (tmp_path / "x").exists()


def test_partition_replace_and_runner(spark, tmp_path):
    path = str(tmp_path / "g")
    tasks = grid.expand_grid(spark, {"a": [1, 2, 3]}).withColumn("a", F.get_json_object("params", "$.a"))
    for g in ("g1", "g2"):
        writers.replace_partitions(writers.grid_task_rows(tasks, g, ["a"], "task_order"), path, "grid_id")
    writers.replace_partitions(writers.grid_task_rows(tasks.limit(1), "g1", ["a"], "task_order"), path, "grid_id")
    assert {r["grid_id"]: r["count"] for r in spark.read.parquet(path).groupBy("grid_id").count().collect()} == {"g1": 1, "g2": 3}
    out = runner.run_table(spark.range(10), "SELECT id FROM {{source}} WHERE id > 6", sinks=[runner.Sink(str(tmp_path / "o"))])
    assert out.count() == spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_sanitize_and_keep_last(spark):
    rows = [("A", "2025-01-02", 2.0, 1), ("A", "2025-01-02", 3.0, 2), (None, "bad", 1.0, 3), ("B", "bad", 1.0, 4), ("B", "2025-01-01", math.nan, 5)]
    out = prep.sanitize(spark.createDataFrame(rows, "unique_id string, ds string, y double, n int"), "n").collect()
    assert [(r["unique_id"], r["y"]) for r in out] == [("A", 3.0)]
    with pytest.raises(ValueError, match="empty"):
        prep.ensure_not_empty(spark.range(0))


def test_roles(spark):
    df = spark.createDataFrame(
        [("A", day(1), 1.0, 1.0, None, 2.0, None, 1, 5.0, "x"), ("A", day(2), 1.0, 1.0, 3.0, 2.0, None, 1, 5.0, "y")],
        "unique_id string, ds timestamp, y double, feat_calendar double, hist_lag_1 double, stat_group_mean double, lag_7 double, month int, custom double, hist_text string",
    )
    roles = prep.exog_roles(df)
    assert roles == {"futr_exog": ["feat_calendar", "month"], "hist_exog": ["hist_lag_1", "custom"], "stat_exog": ["stat_group_mean"]}
    fit, ahead, _ = prep.model_frames(df, df.select("unique_id", "ds"), roles)
    assert fit.where("hist_lag_1 is null").count() == 0 and ahead.columns == ["unique_id", "ds", "feat_calendar", "month"]


def test_join_keys_and_collisions():
    assert joins.join_keys(["row_id", "unique_id", "ds", "y"], ["row_id", "hist_x"]) == ["row_id"]
    assert joins.join_keys(["unique_id", "ds", "y"], ["unique_id", "ds", "hist_x"]) == ["unique_id", "ds"]
    assert joins.join_keys(["a"], ["b"]) == []
    assert prep.prefix_collision("timesfm", "hist_signal") == "hist_timesfm_signal"
    assert joins.select_tables(["a", "b", "c"], ["a", "b"], ["b"]) == ["a"]
    assert prep.feature_families("hist, STAT") == ("hist", "stat")


def test_unified(spark):
    base = spark.createDataFrame([("A", day(1), 1.0), ("A", day(2), 2.0)], "unique_id string, ds timestamp, y double")
    hist = spark.createDataFrame([("A", day(2), 5.0)], "unique_id string, ds timestamp, hist_signal double")
    exog = spark.createDataFrame([("A", day(2), 1.0), ("A", day(2), 7.0)], "unique_id string, ds timestamp, hist_signal double")
    other = spark.createDataFrame([("x", 2.0)], "other_key string, value double")
    res = joins.unified_dataset(base, ("dataset.hist", hist), {"exog.weather": exog, "exog.other": other})
    rows = res.frame.orderBy("ds").collect()
    assert res.joined == ["dataset.hist", "exog.weather"] and res.keys["dataset.hist"] == ["unique_id", "ds"]
    assert rows[0]["hist_signal"] is None and (rows[1]["hist_signal"], rows[1]["hist_weather_signal"]) == (5.0, 7.0)
    assert res.skipped == [{"table": "exog.other", "reason": "no common join keys"}]
    gone = joins.unified_dataset(base, ("dataset.hist", None))
    assert gone.skipped == [{"table": "dataset.hist", "reason": "table not found"}]


def test_integrity(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1), (None, 2)], "unique_id string, ds int")
    r = prep.integrity(df, ["unique_id", "ts_type"]).first()
    assert (r["missing_group_cols"], r["null_key_rows"], r["duplicate_group_time_rows"], r["ok"]) == ("ts_type", 1, 2, False)
    fine = prep.integrity(df.where("unique_id = 'A'").distinct(), ["unique_id"]).first()
    assert fine["ok"] and fine["group_count"] == 1


def test_run_chain(spark):
    base = spark.createDataFrame(
        [("r1", day(1), "success", "a", "Train x", 10.0, 100, 0), ("r2", day(2), "failed", "a", "train y", 50.0, 10, 5), ("r3", day(3), "success", "b", "eval", 12.0, 90, 0)],
        "run_id string, started_at timestamp, status string, app_name string, command string, duration_sec double, rows_written long, rows_failed long",
    )
    models = spark.createDataFrame([("r1", "m", "ok", '{"backend":"ray","search_algorithm":"tpe"}', 1)], "run_id string, model_name string, model_status string, params_json string, n int")
    meta = runs.model_metadata(base, models, "n").where("run_id = 'r1'").first()
    assert (meta["backend"], meta["search_alg"]) == ("ray", "tpe")
    assert {r["run_id"] for r in runs.filter_runs(base, "2025-01-01", "2025-01-02", command="TRAIN").collect()} == {"r1", "r2"}
    spans = spark.createDataFrame([("r1", "load", 10.0), ("r1", "train", 90.0)], "run_id string, stage_name string, duration_ms double")
    spans = spans.withColumns({"db_time_ms": F.lit(1.0), "gpu_util_avg": F.lit(None).cast("double"), "gpu_mem_used_mb_avg": F.lit(1.0), "exception_type": F.lit(None).cast("string")})
    errs = spark.createDataFrame([("r2", day(2), "E", "msg")], "run_id string, event_ts timestamp, error_type string, error_message string")
    hist = spark.createDataFrame([("r2", day(1), "train", "running"), ("r2", day(3), "end", "failed")], "run_id string, event_ts timestamp, event_type string, status string")
    full = runs.with_aggregates(base, spans, hist, errs)
    got = {r["run_id"]: r for r in full.collect()}
    assert got["r1"]["dominant_stage"] == "train" and got["r2"]["error_events"] == 1 and got["r2"]["history_events"] == 2
    assert got["r2"]["fail_rate"] == pytest.approx(5 / 15) and got["r2"]["is_failed"]
    none = runs.with_aggregates(base, None, None, None)
    assert {r["error_events"] for r in none.collect()} == {0}
    pool = runs.run_metrics(base.withColumn("group_key", F.lit("g")))
    odd = runs.run_anomalies(runs.with_expected(pool, pool, runs.baseline_stats(pool, "group_key"), "group_key"), "group_key")
    assert [r["run_id"] for r in runs.most_anomalous(odd, 1).collect()] == ["r2"]
    ctx = runs.error_context(errs, hist).first()
    assert ctx["prev_event_type"] == "train"
    assert [r["run_id"] for r in runs.completed_runs(hist.withColumn("event_id", F.lit(1)).withColumn("status", F.lit("SUCCESS")), None).collect()] == ["r2"]


def test_text_helpers(spark):
    row = spark.createDataFrame([("Traceback: ModuleNotFoundError", "x password = 'abc' y", "postgresql://u:p@h/db")], "m string, s string, u string").select(
        text.event_level(F.col("m")).alias("l"), text.mask_secrets(F.col("s")).alias("s"), text.mask_secrets(F.col("u")).alias("u"),
        text.normalized_fingerprint(F.lit("A 12"), F.lit(None)).alias("f"),
    ).first()
    assert (row["l"], row["f"]) == ("ERROR", "a <n>")
    assert "abc" not in row["s"] and row["u"] == "postgresql://***:***@h/db"
    assert text.feature_name(" Mean  of 5% ") == "mean_of_5pct" and text.feature_name("") == "feature"


def test_fingerprint_matches_json_dump(spark):
    import hashlib

    df = spark.createDataFrame([("src", "cat", "INFO", 'say "hi"\n')], "source string, category string, level string, message string")
    basis = {"source": "src", "category": "cat", "level": "INFO", "message": 'say "hi"\n', "exception_type": "", "path": ""}
    want = hashlib.sha256(json.dumps(basis, sort_keys=True).encode()).hexdigest()[:16]
    assert df.select(text.stable_fingerprint(df).alias("f")).first()["f"] == want
    both = events.record_events(df.unionByName(df).withColumn("ts", F.lit("t")))
    dup = events.duplicate_events(both).collect()
    assert len(dup) == 1 and dup[0]["count"] == 2


def test_json_flatten_fixture(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1},"nums":[1,2,3],"rows":[{"x":1},{"x":2}],"long":[1,2,3,4,5],"mix":[1,{"y":2}],"n":null}'), (2, "nope")], "id int, j string")
    got = {r["key"]: r["value"] for r in jsonflat.flatten_json(df, ["id"], "j", "root", "dashboard", most=4).collect()}
    assert got["root.a.b"] == "1" and got["root.nums.__len__"] == "3" and float(got["root.nums.__mean__"]) == 2.0
    assert got["root.rows[0].x"] == "1" and got["root.long.__truncated__"] == "true" and "root.long[4]" not in got
    assert json.loads(got["root.mix.__json__"]) == [1, {"y": 2}] and got["root.n"] is None
    assert float(got["root.nums.__std__"]) == pytest.approx(math.sqrt(2 / 3)) and float(got["root.nums.__max__"]) == 3.0
    assert jsonflat.json_columns(df) == ["j"]
    wide = jsonflat.flattened_columns(df, {"j": "p"}, most_keys=2)
    assert len(wide.columns) == 4


def test_grid_expansion(spark):
    space = {"num_samples": [5, 10], "seed": [1, 2], "backend": "optuna"}
    rows = [json.loads(r["params"]) for r in grid.expand_grid(spark, space).orderBy("task_order").collect()]
    assert len(rows) == 4 and rows[1] == {"backend": "optuna", "num_samples": 5, "seed": 2}
    assert grid.expand_grid(spark, {"a": [1, 2, 3], "b": [10, 20]}, max_tasks=2).count() == 2
    assert json.loads(grid.expand_grid(spark, {}).first()["params"]) == {}
    fixed, space = grid.apply_modes({"lr": 1, "drop": 2}, {"k": [1, 1, 2], "z": [3]}, {"lr": "vary", "drop": {"enabled": False}, "z": "fixed"})
    assert fixed == {"z": 3} and space == {"k": [1, 2], "lr": [1]}


def test_signature_matches_canonical_json(spark):
    import hashlib

    params = json.dumps({"a": 1, "b": "x"}, sort_keys=True)
    want = hashlib.sha1(json.dumps({"model_name": "M", "horizon": 7, "params_json": {"a": 1, "b": "x"}}, sort_keys=True).encode()).hexdigest()
    row = spark.createDataFrame([(" M ", 7, params)], "m string, h int, p string").select(grid.combo_signature(F.col("m"), F.col("h"), F.col("p")).alias("s")).first()
    assert row["s"] == want


def test_combination_reasons(spark):
    axes = {"backend": ["optuna", "ray"], "search_alg": ["TPESampler", "BayesOptSearch"], "dataset_input_method": ["db_table", "csv"], "unique_id": ["u", ""], "group_mode": ["loto_unique_id_ts_type"]}
    checked = grid.evaluate_combinations(grid.expand_grid(spark, axes), {"dataset_table": "t"})
    assert checked.count() == 16
    counts = {r["reason"]: r["count"] for r in grid.reason_counts(checked).collect()}
    assert counts["missing_unique_id"] == 8 and counts["backend_search_mismatch"] == 4 and counts["missing_dataset_path"] == 2
    assert checked.where("reason is null").count() == 2


def test_models_and_registry(spark):
    df = spark.createDataFrame([("a", day(i), float(i)) for i in range(1, 21)] + [("b", day(1), 5.0)], "unique_id string, ds timestamp, y double")
    assert "naive" in forecast.list_models()
    with pytest.raises(ValueError):
        forecast.get_model("naive").validate({"x": 1})
    out = forecast.forecast(df, SPEC, "drift", 2).orderBy("unique_id", "step").collect()
    assert [r["yhat"] for r in out] == [21.0, 22.0, 5.0, 5.0]
    ar = forecast.forecast(df, SPEC, "autoregression", 1, params={"order": 1}).where("unique_id = 'a'").first()
    assert ar["yhat"] == pytest.approx(21.0)
    joined, mode = forecast.with_fallback(df.limit(0), df.withColumn("yhat", F.col("y")), SPEC, 2)
    assert mode == "insample_tail_fallback" and joined.count() == 3
    tasks = grid.expand_grid(spark, {"model": ["naive", "nope"]})
    res = grid.run_grid(df, SPEC, tasks, 3)
    got = {(r["unique_id"], r["model_name"]): r["status"] for r in res.collect()}
    assert got == {("a", "naive"): "success", ("a", "nope"): "failed", ("b", "naive"): "failed", ("b", "nope"): "failed"}


def test_report_chain(spark):
    rows = [
        (i % 3, f"r{i}", "failed" if i == 7 else "success", "m", 7, 99 if i == 5 else 10, day(1), day(2), json.dumps({"num_samples": 10, "h": 7}), json.dumps({"mae": 1.0 + i}))
        for i in range(12)
    ]
    df = spark.createDataFrame(rows, "config_id int, run_id string, status string, model_name string, cfg_horizon int, cfg_auto_num_samples int, started_at timestamp, ended_at timestamp, params_json string, metrics_json string")
    flat = reports.flatten_results(df)
    assert reports.target_metric(flat.columns, "mae") == "metrics.mae" and flat.first()["duration_sec"] == 86400.0
    detail = reports.reflection_rows(flat)
    bad = detail.where("status = 'mismatch'").collect()
    assert [(r["run_id"], r["parameter"], r["expected"]) for r in bad] == [("r5", "auto_num_samples", "99")]
    summary = {r["parameter"]: r for r in reports.reflection_summary(detail).collect()}
    assert summary["horizon"]["match_rate"] == 1.0 and summary["model_name"]["missing_actual_rows"] == 12
    facts = {r["insight"]: r for r in reports.key_insights(flat, "metrics.mae").collect()}
    assert facts["best_run"]["subject"] == "r0" and facts["failure_rate"]["value"] == pytest.approx(1 / 12)


def test_latest_per(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {r["v"] for r in latest_per(df, ["k"], ["t"]).collect()} == {"y", "z"}
