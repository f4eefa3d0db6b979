"""Reading series tables, files and event lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import SeriesSpec, require_columns

# Names under which a loader may be asked for, and the column names a foreign table may use.
LOADERS = ("db_table", "db_sql", "csv", "parquet", "json", "jsonl")
LOADER_ALIASES = {"postgres": "db_table", "table": "db_table", "query": "sql", "ndjson": "jsonl"}
TIME_NAMES = ("ds", "date", "datetime", "timestamp", "time")
TARGET_NAMES = ("y", "target", "value")
ID_NAMES = ("unique_id", "uid", "series", "id")
OPTIONAL_COLUMNS = ("proc_seconds", "exec_ts", "updated_ts")


def loader_name(value: str | None, default: str = "db_table") -> str:
    """Resolve an alias; unknown names fall back to the default."""
    text = (value or "").strip().lower()
    text = LOADER_ALIASES.get(text, text)
    if text == "sql":
        return "sql"
    return text if text in LOADERS else default


def read_source(table: DataFrame, spec: SeriesSpec, where: str | None = None) -> DataFrame:
    """Only the columns the features need: keys, time, target, and the optional ones that are there.

    The projection and the filter reach the scan, be it Parquet or JDBC.
    """
    require_columns(table, [*spec.keys, spec.time_col, spec.target_col])
    extra = [c for c in table.columns if c in OPTIONAL_COLUMNS or c.endswith("_row_id") or c in spec.order_cols]
    wanted = dict.fromkeys([*spec.keys, spec.time_col, spec.target_col, *extra])
    out = table.where(where) if where else table
    return out.select(*wanted)


def read_range(table: DataFrame, spec: SeriesSpec, start=None, end=None, lotos: Sequence[str] = (), ts_types: Sequence[str] = ()) -> DataFrame:
    """Closed time range and key lists, pushed to the scan."""
    out = table
    if start is not None:
        out = out.where(F.col(spec.time_col) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(spec.time_col) <= F.lit(end))
    if lotos:
        out = out.where(F.col("loto").isin(list(lotos)))
    if ts_types:
        out = out.where(F.col("ts_type").isin(list(ts_types)))
    return read_source(out, spec)


def read_files(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", load_all: bool = True, schema=None) -> DataFrame:
    """A file, a folder (read recursively), a glob or several of them; files may differ in columns.

    ``load_all=False`` reads the first matching file by name.
    """
    fmt = "json" if fmt in ("json", "jsonl", "ndjson") else fmt
    reader = spark.read.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if fmt == "parquet":
        reader = reader.option("mergeSchema", "true")
    paths = [path] if isinstance(path, str) else list(path)
    if not load_all:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        listing = listing.option("pathGlobFilter", f"*.{'json*' if fmt == 'json' else fmt}")
        first = listing.load(paths).select("path").agg(F.min("path")).first()[0]
        if first is None:
            raise FileNotFoundError(f"no {fmt} file under {paths}")
        paths = [first]
    return reader.format(fmt).load(paths)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames that may lack some of each other's columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def load_dataset(
    spark: SparkSession,
    method: str = "db_table",
    *,
    path: str | None = None,
    table: str | None = None,
    sql: str | None = None,
    where: str | None = None,
    jdbc: dict | None = None,
    time_col: str = "ds",
    schema=None,
) -> DataFrame:
    """One entry for every input method; unparsable times become NULL."""
    method = loader_name(method)
    if method in ("csv", "parquet", "json", "jsonl"):
        if not path:
            raise ValueError(f"{method} needs a path")
        out = read_files(spark, path, method, schema=schema)
    elif method in ("db_sql", "sql"):
        if not sql:
            raise ValueError(f"{method} needs a query")
        out = spark.read.format("jdbc").options(**jdbc).option("query", sql).load() if jdbc else spark.sql(sql)
    else:
        if not table:
            raise ValueError("db_table needs a table")
        out = spark.read.format("jdbc").options(**jdbc).option("dbtable", table).load() if jdbc else spark.table(table)
    if where:
        out = out.where(where)
    if time_col in out.columns and out.schema[time_col].dataType.typeName() == "string":
        out = out.withColumn(time_col, F.try_to_timestamp(time_col))
    return out


def read_recent(table: DataFrame, time_col: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by time: a top-k, not a full sort."""
    return table.orderBy(time_col, *ties).limit(int(n))


def standard_columns(df: DataFrame) -> DataFrame:
    """Find the time, target and id columns by their usual names; rows without time or target are dropped."""
    lower = {c.lower(): c for c in df.columns}

    def pick(names):
        return next((lower[n] for n in names if n in lower), None)

    t, y, u = pick(TIME_NAMES), pick(TARGET_NAMES), pick(ID_NAMES)
    if t is None or y is None:
        raise ValueError(f"no time or target column among {df.columns}")
    when = F.try_to_timestamp(F.col(t)) if df.schema[t].dataType.typeName() == "string" else F.col(t)
    value = F.col(y).try_cast("double")
    out = df.select(
        when.alias("ds"),
        F.nanvl(value, F.lit(None).cast("double")).alias("y"),
        (F.col(u).cast("string") if u else F.lit("series_0")).alias("unique_id"),
    )
    return out.dropna(subset=["ds", "y"])


EVENT_SCHEMA = "ts string, source string, category string, level string, message string, run_id string, payload string, exception_type string, path string, fingerprint string"


def parse_event_lines(lines: DataFrame, column: str = "value", schema: str = EVENT_SCHEMA, keep: Sequence[str] = ()) -> DataFrame:
    """JSON event lines as columns; lines that are no JSON object are skipped."""
    parsed = F.from_json(F.col(column), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    looks = F.trim(F.col(column)).startswith("{")
    out = lines.where(looks).select(*keep, parsed.alias("_e")).where(F.col("_e").isNotNull() & F.col("_e._bad").isNull())
    return out.select(*keep, "_e.*").drop("_bad")


def read_events(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Event log in JSON lines; ``last`` keeps the newest events by their time stamp."""
    out = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return out.orderBy(F.col("ts").desc()).limit(max(1, int(last))) if last else out
