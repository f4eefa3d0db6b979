"""Writing feature tables, metrics, forecasts and log rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import keep_last
from ..session import durable

# Write modes.
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_mode(name: str) -> str:
    try:
        return MODES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown write mode: {name}") from None


def align(df: DataFrame, target: T.StructType) -> DataFrame:
    """Shape rows for an append: target order and types, missing columns NULL, unknown columns an error."""
    extra = [c for c in df.columns if c not in target.names]
    if extra:
        raise ValueError(f"columns not in the target table: {extra}")
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields
    ]
    return df.select(*cols)


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", partition_by: Sequence[str] = (), max_rows_per_file: int = 0) -> None:
    """Write or append a table. CSV tables carry a header; an append is shaped to the table that is there."""
    how = write_mode(mode)
    options = {"header": "true"} if fmt == "csv" else {}
    if how == "append":
        spark = df.sparkSession
        try:
            df = align(df, spark.read.options(**options).format(fmt).load(path).schema)
        except Exception as e:  # first append creates the table
            if "PATH_NOT_FOUND" not in str(e):
                raise
    w = df.write.mode(how).options(**options)
    if max_rows_per_file:
        w = w.option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def write_outputs(df: DataFrame, *, table_path: str, csv_path: str | None = None, parquet_path: str | None = None, spark_path: str | None = None, spark_format: str = "parquet", mode: str = "replace", fast: bool = False) -> list[str]:
    """The unified table and, unless ``fast``, its copies. For several sinks the frame is checkpointed once."""
    targets = [("table", table_path, "parquet")]
    if not fast:
        extra = [("csv", csv_path, "csv"), ("parquet", parquet_path, "parquet"), ("spark", spark_path, spark_format)]
        targets += [t for t in extra if t[1]]
    held = durable(df) if len(targets) > 1 else df
    for _, path, fmt in targets:
        w = held.write.mode(write_mode(mode)).format(fmt)
        (w.option("header", "true") if fmt == "csv" else w).save(path)
    return [name for name, _, _ in targets]


def known_ids(target: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    """The target's ids in the given type; those that have no value in it can equal none."""
    return target.select(F.col(key).try_cast(kind).alias(key)).where(F.col(key).isNotNull())


def only_missing(df: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """Rows whose id the target does not hold yet, compared in the type of the new rows' id.

    Apply after windows are built, so histories stay whole.
    """
    if target is None:
        return df
    return df.join(known_ids(target, key, df.schema[key].dataType), key, "left_anti")


def metrics_long(df: DataFrame, run_col: str, metrics: Sequence[str], version: str | None = None) -> DataFrame:
    """Wide metric columns to (run, metric_name, metric_value) rows."""
    keep = [run_col, *([version] if version else [])]
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in metrics])
    )
    return df.select(*keep, pairs.alias("_m")).select(*keep, "_m.metric_name", "_m.metric_value")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest row per key over both inputs; on equal versions the incoming row wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return keep_last(both, list(keys), [version, "_new"]).drop("_new")


def forecast_rows(df: DataFrame, run_id: str, id_col: str = "unique_id", time_col: str = "ds", skip: Sequence[str] = ("cutoff", "y")) -> DataFrame:
    """(run_id, id, time, yhat): the first model column is the forecast."""
    model = next((c for c in df.columns if c not in (id_col, time_col, *skip)), None)
    if model is None:
        raise ValueError(f"forecast has no model column: {df.columns}")
    return df.select(F.lit(run_id).alias("run_id"), id_col, time_col, F.col(model).cast("double").alias("yhat"))


def contribution_rows(df: DataFrame, run_id: str) -> DataFrame:
    """(run_id, feature, importance, method) from an importance table."""
    method = F.col("method") if "method" in df.columns else F.lit("permutation")
    return df.select(
        F.lit(run_id).alias("run_id"),
        F.col("feature").cast("string").alias("feature"),
        F.col("delta_mae_mean").cast("double").alias("importance"),
        method.alias("method"),
    )


def event_rows(df: DataFrame, payload: Sequence[str], keep: Sequence[str], name: str = "payload") -> DataFrame:
    """Log rows whose remaining fields travel as one JSON text column."""
    return df.select(*keep, F.to_json(F.struct(*payload)).alias(name))


def grid_task_rows(df: DataFrame, grid_id: str, params: Sequence[str], order: str) -> DataFrame:
    """Task rows of a grid, ready for a replace of the grid's partition."""
    return df.select(
        F.lit(grid_id).alias("grid_id"),
        F.col(order).cast("long").alias("task_order"),
        F.to_json(F.struct(*sorted(params))).alias("param_values"),
        F.lit("pending").alias("status"),
    )


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Rewrite only the partitions that occur in the frame."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
    w.parquet(path)


def config_text(config: Mapping) -> str:
    return json.dumps(dict(config), sort_keys=True, default=str)
