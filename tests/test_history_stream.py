"""Streamed history features against the batch build."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from seriesloom import SeriesSpec
from seriesloom.operators.windows import history_features
from seriesloom.streaming.histories import NAMES, history_stream

SPEC = SeriesSpec(("k",), "ds", "y", order_cols=("row_id",))
SCHEMA = "k string, ds timestamp, y double, row_id long"


def rows():
    r = np.random.default_rng(3)
    out = []
    for k, n, base in (("a", 70, 0.0), ("b", 45, 1e6), (None, 9, 5.0)):
        for i in range(n):
            y = None if r.random() < 0.15 else float(base + r.normal())
            out.append((k, datetime(2025, 1, 1) + timedelta(days=i // 2 if k == "b" else i), y, i))
    return out


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = rows()
    parts = [[x for x in data if lo <= x[3] < hi] for lo, hi in ((0, 1), (1, 30), (30, 31), (31, 100))]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        query = history_stream(stream, SPEC).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
        query.trigger(availableNow=True).start().awaitTermination()

    for part in parts[:3]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run()
    spark.createDataFrame(parts[3] + parts[1], SCHEMA).coalesce(1).write.mode("append").parquet(src)  # some come again
    run()
    got = {(r["k"], r["row_id"]): r for r in spark.read.parquet(out).collect()}
    want = {(r["k"], r["row_id"]): r for r in history_features(spark.createDataFrame(data, SCHEMA), SPEC).collect()}
    assert set(got) == set(want) and spark.read.parquet(out).count() == len(data)
    for key, row in want.items():
        for name in NAMES:
            a, b = got[key][name], row[name]
            assert (a is None) == (b is None or math.isnan(b)) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-6)), (key, name, a, b)
