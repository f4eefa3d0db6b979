"""Nothing is cut by default, and the sinks and joins behave at their edges."""

import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import session
from seriesloom.functions import jsonflat, text
from seriesloom.operators import anomaly, events, explain, grid, joins, reports
from seriesloom.sources import writers
from seriesloom.spec import SeriesSpec


def test_nine_features_and_nine_branches(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 9))
    y = x @ np.arange(1, 10)
    df = spark.createDataFrame([(*map(float, a), float(b), f"g{i % 9}") for i, (a, b) in enumerate(zip(x, y))], [*[f"f{k}" for k in range(9)], "y", "g"])
    names = [f"f{k}" for k in range(9)]
    assert explain.shapley_r2(df, "y", names, orders=10).count() == 9
    assert explain.subset_r2(df, "y", names).count() == 2**9 - 1
    with pytest.raises(ValueError):
        explain.subset_r2(df, "y", [f"f{k}" for k in range(17)])
    tree = reports.drilldown(df, "y", ["g"], max_depth=1).collect()
    assert sum(t.depth == 1 for t in tree) == 9
    assert sum(t.depth == 1 for t in reports.drilldown(df, "y", ["g"], max_depth=1, children=3).collect()) == 3
    assert explain.what_if(df.withColumn("yhat", F.col("y")), names).count() == 9


def test_parameter_with_many_values(spark):
    df = spark.createDataFrame([(i, f"v{i % 21}", float(i % 7)) for i in range(210)], "id int, p string, y double")
    row = explain.parameter_impact(df, ["p"], "y", "id", n_iter=20).first()
    assert row.groups == 21 and row.permutation_pvalue is not None
    row = explain.parameter_impact(df, ["p"], "y", "id", n_iter=20, max_values=20).first()
    assert row.groups == 21 and row.permutation_pvalue is None


def test_json_keeps_every_key_item_and_level(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}
    doc = {f"k{i}": i for i in range(130)} | deep | {"list": list(range(3000))}
    df = spark.createDataFrame([(i, None) for i in range(150)] + [(150, json.dumps(doc))], "id int, j string").repartition(3)
    assert jsonflat.json_columns(df) == ["j"]
    got = {r["key"]: r["value"] for r in jsonflat.flatten_json(df, ["id"], "j", "p", "dashboard").collect()}
    assert got["p.a.b.c.d.e.f.g"] == "1" and got["p.list[2999]"] == "2999" and got["p.list.__max__"] == "2999.0" and got["p.k129"] == "129"
    assert "p.list.__truncated__" not in got
    shallow = {r["key"]: r["value"] for r in jsonflat.flatten_json(df, ["id"], "j", "p", "report", max_depth=2).collect()}
    assert json.loads(shallow["p.a.b.c.__json__"]) == {"d": {"e": {"f": {"g": 1}}}}
    assert len(jsonflat.flattened_columns(df.select("id", F.get_json_object("j", "$").alias("j")), {"j": "p"}, "report").columns) >= 130


def test_whole_messages(spark):
    rows = [(i, "ERROR", "app", "same start " * 40 + str(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, level string, source string, message string")
    assert df.select(text.stable_fingerprint(df).alias("f")).distinct().count() == 3
    assert df.select(text.stable_fingerprint(df, 300).alias("f")).distinct().count() == 1
    assert {len(r.message) for r in events.error_findings(df).collect()} == {len(r[3]) for r in rows}
    letters = [("x" * 400 + c,) for c in "abc"]
    assert spark.createDataFrame(letters, "m string").select(text.normalized_fingerprint(F.col("m")).alias("f")).distinct().count() == 3


def test_csv_appends_twice(spark, tmp_path):
    path = f"{tmp_path}/t"
    for i in range(3):
        writers.write_table(spark.createDataFrame([(i, f"a{i}")], "id int, name string"), path, "append", "csv")
    got = spark.read.option("header", "true").csv(path)
    assert got.columns == ["id", "name"] and sorted(r.id for r in got.collect()) == ["0", "1", "2"]


def test_outputs_to_several_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    names = writers.write_outputs(df, table_path=f"{tmp_path}/t", csv_path=f"{tmp_path}/c", parquet_path=f"{tmp_path}/p")
    assert names == ["table", "csv", "parquet"] and spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_text_ids(spark):
    new, held = spark.createDataFrame([("a-1",), ("a-2",), ("7",)], "id string"), spark.createDataFrame([(7,)], "id int")
    assert sorted(r.id for r in writers.only_missing(new, held, "id").collect()) == ["a-1", "a-2"]
    assert [r.id for r in writers.only_missing(spark.createDataFrame([(7,), (8,)], "id int"), spark.createDataFrame([("x",), ("7",), (None,)], "id string"), "id").collect()] == [8]


def test_asof_ties_and_null_keys(spark):
    left = spark.createDataFrame([("k", 5), (None, 5), ("k", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 5, 9, "nine"), ("k", 5, 10, "ten"), (None, 5, 1, "null")], "k string, t int, eid int, name string")
    got = joins.asof_join(left, right, "k", "t", "t", {"name": "name"}, right_order=["eid"]).collect()
    assert {(r.k, r.t): r.name for r in got} == {("k", 5): "ten", (None, 5): None, ("k", 1): None}


def test_signature_of_a_name_with_quotes(spark):
    import hashlib

    params = json.dumps({"a": 1})
    row = spark.createDataFrame([('say "hi"\\', 3, params)], "m string, h int, p string").select(grid.combo_signature(F.col("m"), F.col("h"), F.col("p")).alias("s")).first()
    want = json.dumps({"horizon": 3, "model_name": 'say "hi"\\', "params_json": "@"}).replace('"@"', params)
    assert row.s == hashlib.sha1(want.encode()).hexdigest()


def test_grid_spreads_goes_on_and_stops(spark):
    spec = SeriesSpec(("id",), "t", "y")
    df = spark.createDataFrame([("a", i, float(i)) for i in range(60)], "id string, t int, y double")
    tasks = grid.expand_grid(spark, {"model": ["window_mean"], "window": list(range(1, 201))})
    full = grid.run_grid(df, spec, tasks, 5)
    assert full.count() == 200
    done = full.where("task_order < 150")
    assert sorted(r.task_order for r in grid.run_grid(df, spec, tasks, 5, done=done).collect()) == list(range(150, 200))
    broken = grid.expand_grid(spark, {"model": ["naive", "nosuch", "drift"]})
    out = {r.task_order: r.status for r in grid.run_grid(df, spec, broken, 5, stop_on_error=True).collect()}
    assert out == {0: "success", 1: "failed"}


def test_forest_draws_from_the_whole_series(spark):
    r = np.random.default_rng(2)
    values = np.concatenate([r.normal(size=5000), [40.0, -35.0]])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "id string, t int, y double")
    spec = SeriesSpec(("id",), "t", "y")
    out = anomaly.isolation_scores(df, spec, trees=50).toPandas().sort_values("t")
    score = [c for c in out.columns if c.startswith("hist_merlion_iforest")]
    assert len(out) == 5002 and score


def test_no_folder_of_its_own_on_a_cluster(monkeypatch):
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.durable(SimpleNamespace(sparkSession=spark))
