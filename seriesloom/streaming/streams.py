"""Streams of events, metric samples and feature rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import record_events
from ..sources.readers import EVENT_SCHEMA
from ..sources.writers import known_ids, only_missing
from ..spec import SeriesSpec

HELD = "_held"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON-line event files as they arrive; malformed lines are skipped."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).withColumn("ts", F.try_to_timestamp("ts")).where(F.col("ts").isNotNull())


def unique_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each fingerprint once within the watermark; the state holds fingerprints of that span only."""
    return record_events(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def samples_per_window(samples: DataFrame, time: str = "sampled_at", width: str = "1 minute", slide: str | None = None, delay: str = "5 minutes", keys: Sequence[str] = ("run_id", "metric_key"), value: str = "metric_value") -> DataFrame:
    """Count, mean and extremes of metric samples per key and window; later samples than the delay are dropped."""
    held = samples.withWatermark(time, delay) if samples.isStreaming else samples
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = held.groupBy(window.alias("_w"), *keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n", "mean", "min", "max")


def run_sessions(events: DataFrame, time: str = "event_ts", gap: str = "30 minutes", delay: str = "1 hour", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Sessions of a run: events closer than the gap belong together."""
    held = events.withWatermark(time, delay) if events.isStreaming else events
    out = held.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *keys, "events")


def _last_rows(rows: DataFrame, target: DataFrame | None, row_id: str, time_col: str) -> DataFrame:
    """One row per id, the last by time and then by the other values, and whether the target holds the id: one exchange by id."""
    rest = [c for c in rows.columns if c != row_id]
    order = list(dict.fromkeys([*([time_col] if time_col in rest else []), *rest]))
    marked = rows.select(row_id, F.struct(*order).alias("_row"), F.lit(False).alias(HELD))
    if target is not None:
        marked = marked.unionByName(known_ids(target, row_id, rows.schema[row_id].dataType).withColumn(HELD, F.lit(True)), allowMissingColumns=True)
    last = marked.groupBy(row_id).agg(F.max("_row").alias("_row"), F.max(HELD).alias(HELD)).where(F.col("_row").isNotNull())
    return last.select(*[F.col(c) if c == row_id else F.col("_row")[c].alias(c) for c in rows.columns], HELD)


def append_features(
    stream: DataFrame,
    history: Callable[[SparkSession], DataFrame],
    target: Callable[[SparkSession], DataFrame | None],
    build: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame], None],
    spec: SeriesSpec,
    row_id: str,
    checkpoint: str,
    available_now: bool = True,
):
    """Start a query that appends features for new rows only.

    Each batch reads the history of the series it touches, builds their features with the batch included, and writes the
    rows whose id the target lacks. A batch that finds no such id, as in a replay, compares ids and builds nothing. The rows
    given to ``build`` carry the column ``_held`` (the target has the id); features without it are compared by id once more.
    A ``build`` that measures its series computes the rows twice; give it a layout where one is known.
    """

    def handle(batch: DataFrame, _epoch: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        past, held = history(spark), target(spark)
        if held is not None and only_missing(past.select(row_id).unionByName(batch.select(row_id)), held, row_id).isEmpty():
            return
        names = {k: f"_k_{i}" for i, k in enumerate(spec.keys)}
        touched = batch.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct().hint("shuffle_hash")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        past = past.join(touched, same, "left_semi")
        out = build(_last_rows(past.unionByName(batch, allowMissingColumns=True), held, row_id, spec.time_col))
        write(out.where(~F.col(HELD)).drop(HELD) if HELD in out.columns else only_missing(out, held, row_id))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
