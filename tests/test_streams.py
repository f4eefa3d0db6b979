"""Streams driven to completion over small files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom import SeriesSpec
from seriesloom.operators.windows import lag_features
from seriesloom.streaming import streams


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_events_once_per_fingerprint(spark, tmp_path):
    event = {"source": "s", "category": "c", "level": "INFO", "message": "token=abc", "run_id": "r"}
    lines = [json.dumps({**event, "ts": f"2025-01-01T00:00:0{i}"}) for i in range(3)] + ["broken", json.dumps({**event, "category": "d", "ts": "2025-01-01T00:00:09"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    out = streams.unique_events(streams.event_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("uniq").option("checkpointLocation", str(tmp_path / "ck")).start()
    drain(q)
    rows = spark.sql("SELECT * FROM uniq").collect()
    assert sorted(r["category"] for r in rows) == ["c", "d"] and all(r["message"] == "token=***" for r in rows)


def test_window_aggregates_drop_late_samples(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    t0 = datetime(2025, 1, 1)

    def put(name, minutes):
        rows = [json.dumps({"run_id": "r", "metric_key": "cpu", "sampled_at": (t0 + timedelta(minutes=m)).isoformat(), "metric_value": float(m)}) for m in minutes]
        (src / name).write_text("\n".join(rows))

    stream = spark.readStream.schema("run_id string, metric_key string, sampled_at timestamp, metric_value double").json(str(src))
    out = streams.samples_per_window(stream, width="10 minutes", delay="5 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "ck")).start()
    put("a.json", [1, 2, 11])
    q.processAllAvailable()
    put("b.json", [40])
    q.processAllAvailable()
    put("c.json", [3, 41])  # minute 3 lies behind the watermark
    drain(q)
    rows = {r["window_start"].minute: r for r in spark.sql("SELECT * FROM win").collect()}
    assert rows[0]["n"] == 2 and rows[0]["mean"] == 1.5 and rows[10]["n"] == 1


def test_sessions_batch_equals_stream(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [("r", t0 + timedelta(minutes=m)) for m in (0, 10, 20, 100, 105)]
    df = spark.createDataFrame(rows, "run_id string, event_ts timestamp")
    batch = {(r["session_start"], r["events"]) for r in streams.run_sessions(df).collect()}
    assert batch == {(t0, 3), (t0 + timedelta(minutes=100), 2)}
    late = spark.createDataFrame([("r", t0 + timedelta(days=2))], df.schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.run_sessions(stream).writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(q)
    got = {(r["session_start"], r["events"]) for r in spark.sql("SELECT * FROM sess").collect()}
    assert got == batch


def test_feature_append_is_idempotent(spark, tmp_path):
    spec = SeriesSpec(("unique_id",))
    src, table = str(tmp_path / "in"), str(tmp_path / "features")
    schema = "unique_id string, ds timestamp, y double, row_id long"

    def put(ids):
        rows = [("a", datetime(2025, 1, i), float(i), i) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def target(s):
        return s.read.parquet(table) if (tmp_path / "features").exists() else None

    def run(check):
        stream = spark.readStream.schema(schema).parquet(src)
        q = streams.append_features(
            stream, lambda s: s.read.parquet(src), target, lambda d: lag_features(d, spec, [1]), lambda d: d.write.mode("append").parquet(table), spec, "row_id", str(tmp_path / check)
        )
        q.awaitTermination()

    put([1, 2])
    run("ck1")
    put([3])
    run("ck1")
    run("ck2")  # a second consumer that replays everything adds nothing
    got = {r["row_id"]: r["lag_1"] for r in spark.read.parquet(table).collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0}
    assert spark.read.parquet(table).count() == 3


def append_runs(spark, place, batches, build):
    """The written (row_id, lag_1) pairs after batches that arrive one by one, each followed by a second consumer's replay."""
    src, table = f"{place}/in", f"{place}/features"
    schema = "unique_id string, ds timestamp, y double, row_id long"

    def target(s):
        return s.read.parquet(table) if (place / "features").exists() else None

    for rows in batches:
        spark.createDataFrame([(k, datetime(2025, 1, d), float(i), i) for k, d, i in rows], schema).coalesce(1).write.mode("append").parquet(src)
        for check in ("ck1", "ck2"):
            stream = spark.readStream.schema(schema).parquet(src)
            streams.append_features(stream, lambda s: s.read.schema(schema).parquet(src), target, build, lambda d: d.write.mode("append").parquet(table), SeriesSpec(("unique_id",)), "row_id", f"{place}/{check}").awaitTermination()
    out = spark.read.parquet(table)
    assert set(out.columns) == {"unique_id", "ds", "y", "row_id", "lag_1"}
    return sorted((r["row_id"], r["lag_1"]) for r in out.collect())


def test_feature_append_builds_nothing_in_a_replay(spark, tmp_path):
    built = []
    lags = lambda d: built.append(1) or lag_features(d, SeriesSpec(("unique_id",)), [1])
    got = append_runs(spark, tmp_path, [[("a", 1, 1), ("b", 1, 2)], [("a", 2, 3)]], lags)
    assert got == [(1, None), (2, None), (3, 1.0)]
    assert len(built) == 2


def test_feature_append_without_the_mark_compares_ids(spark, tmp_path):
    lags = lambda d: lag_features(d, SeriesSpec(("unique_id",)), [1]).select("unique_id", "ds", "y", "row_id", "lag_1")
    got = append_runs(spark, tmp_path, [[("a", 1, 1), ("b", 1, 2)], [("a", 2, 3)], [("b", 2, 4), ("b", 3, 5)]], lags)
    assert got == [(1, None), (2, None), (3, 1.0), (4, 2.0), (5, 4.0)]


def test_feature_append_keeps_versions_and_null_keys(spark, tmp_path):
    """The last version of an id counts, and a series without a key has a history too."""
    lags = lambda d: lag_features(d, SeriesSpec(("unique_id",)), [1])
    got = append_runs(spark, tmp_path, [[("a", 1, 1), ("a", 5, 1), (None, 1, 2)], [("a", 4, 3), (None, 2, 4), (None, 2, 4)]], lags)
    assert got == [(1, None), (2, None), (3, None), (4, 2.0)]


def test_appended_features_measure_once_and_split_long_series(spark, monkeypatch):
    from seriesloom.catalog import registry, sinks
    from seriesloom.operators import windows

    calls, query, sf = [], registry().queries["stream_appended_features"], "/root/testdata/sf0.001"
    plain, split = sinks.measure, windows.measure
    monkeypatch.setattr(windows, "measure", lambda *a: calls.append(1) or split(*a))
    want = sorted(query(spark, sf).collect())
    assert not calls
    monkeypatch.setattr(sinks, "measure", lambda df, keys: plain(df, keys, 13))
    assert not plain(sinks.ticks(spark, sf), sinks.TICKS.keys, 13).plain
    assert sorted(query(spark, sf).collect()) == want


def test_batch_windows_slide(spark):
    df = spark.createDataFrame([("r", "k", datetime(2025, 1, 1, 0, 4), 1.0)], "run_id string, metric_key string, sampled_at timestamp, metric_value double")
    out = streams.samples_per_window(df, width="10 minutes", slide="5 minutes")
    assert out.agg(F.sum("n")).first()[0] == 2
    with pytest.raises(Exception):
        streams.samples_per_window(df, width="nonsense").collect()
