"""Filters, checks and clean-up of series frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.quantiles import group_quantiles
from ..plans.series import over_groups
from ..spec import SeriesSpec, require_columns

# Calendar names known for every future date, and the prefixes of derived history columns.
FUTURE_NAMES = (
    "year", "quarter", "month", "weekofyear", "day", "dayofyear", "dayofweek", "is_weekend",
    "dow_sin", "dow_cos", "month_sin", "month_cos", "doy_sin", "doy_cos",
)
HISTORY_PREFIXES = ("lag_", "roll_", "diff_")
FAMILIES = ("base", "hist", "stat", "anomaly")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. An aggregate with partial results, so a key made of copies stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def sanitize(df: DataFrame, order_col: str, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> DataFrame:
    """Rows with id, time and target; one row per (id, time), the last by ``order_col``. Sparse features stay NULL."""
    require_columns(df, [id_col, time_col, target_col, order_col])
    t = F.col(time_col)
    kind = df.schema[time_col].dataType
    if isinstance(kind, T.StringType):
        t = F.try_to_timestamp(t)
    y = F.col(target_col).try_cast("double")
    out = df.withColumns({time_col: t, target_col: F.nanvl(y, F.lit(None).cast("double"))})
    return keep_last(out.dropna(subset=[id_col, time_col, target_col]), [id_col, time_col], [order_col])


def ensure_not_empty(df: DataFrame, what: str = "dataset") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty after filtering required columns")
    return df


def equality_filter(df: DataFrame, wanted: Mapping[str, object]) -> tuple[DataFrame, list[str]]:
    """Keep rows equal to every wanted value; returns the names that are not columns."""
    missing = [c for c in wanted if c not in df.columns]
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if c in df.columns]
    return (df.where(reduce(lambda a, b: a & b, tests)) if tests else df), missing


def filter_report(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows before and after the equality filter, from one scan."""
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if c in df.columns]
    test = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
    missing = [c for c in wanted if c not in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(test).alias("rows_after")
    ).withColumn("missing_filter_cols", F.lit(",".join(missing)))


def in_list(df: DataFrame, column: str, csv: str | None) -> DataFrame:
    """Keep rows whose value, as text, is in a comma-separated list; an empty list keeps everything."""
    values = [v.strip() for v in (csv or "").split(",") if v.strip()]
    if column not in df.columns or not values:
        return df
    return df.where(F.col(column).cast("string").isin(values))


def integrity(df: DataFrame, keys: Sequence[str], time_col: str = "ds") -> DataFrame:
    """One row: missing columns, rows with a NULL key, rows in duplicated (group, time), groups, rows, ``ok``."""
    present = [k for k in keys if k in df.columns]
    missing = [k for k in keys if k not in df.columns]
    has_time = time_col in df.columns
    by = [*present, *([time_col] if has_time else [])]
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in present], F.lit(False))
    per_group = sizes.groupBy(*present).agg(
        F.sum("_n").alias("_rows"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("_dups"),
        F.sum(F.when(null_key, F.col("_n")).otherwise(0)).alias("_nulls"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")

    out = per_group.agg(
        total("_rows").alias("row_count"),
        (F.count(F.lit(1)) if present else F.lit(0)).cast("long").alias("group_count"),
        (total("_nulls") if present else F.lit(0).cast("long")).alias("null_key_rows"),
        (total("_dups") if present and has_time else F.lit(0).cast("long")).alias("duplicate_group_time_rows"),
    )
    ok = (F.col("null_key_rows") == 0) & (F.col("duplicate_group_time_rows") == 0) & F.lit(not missing)
    return out.withColumns({"missing_group_cols": F.lit(",".join(missing)), "ok": ok})


def group_summary(df: DataFrame, keys: Sequence[str], time_col: str = "ds", most: int | None = None) -> DataFrame:
    """Rows and time span per group; ``most`` keeps the first groups by key as a sample report."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time_col).alias("min_time"), F.max(time_col).alias("max_time")
    )
    return out.orderBy(*keys).limit(most) if most else out


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def exog_roles(df: DataFrame, core: Sequence[str] = ("unique_id", "ds", "y")) -> dict[str, list[str]]:
    """Role of each numeric column that holds at least one value: prefix first, then known names, else history."""
    cols = [f.name for f in df.schema if f.name not in core and _numeric(f.dataType)]
    if not cols:
        return {"futr_exog": [], "hist_exog": [], "stat_exog": []}
    row = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    cols = [c for i, c in enumerate(cols) if row[f"c{i}"]]
    feat, hist, stat = ([c for c in cols if c.startswith(p)] for p in ("feat_", "hist_", "stat_"))
    rest = [c for c in cols if not c.startswith(("feat_", "hist_", "stat_"))]
    future = [c for c in rest if c in FUTURE_NAMES]
    derived = [c for c in rest if c not in future and c.startswith(HISTORY_PREFIXES)]
    other = [c for c in rest if c not in future and c not in derived]
    return {"futr_exog": feat + future, "hist_exog": hist + derived + other, "stat_exog": stat}


def exog_role_table(df: DataFrame, core: Sequence[str] = ("unique_id", "ds", "y")) -> DataFrame:
    """(column, role) rows; the list of columns is schema-sized."""
    roles = exog_roles(df, core)
    rows = [(c, r) for r, cols in roles.items() for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def model_frames(df: DataFrame, future: DataFrame | None = None, roles: Mapping[str, Sequence[str]] | None = None, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y"):
    """Training and future frames without gaps: feature NULLs become the column's median (0 when it has none)."""
    required = [id_col, time_col, target_col]
    require_columns(df, required)
    base = df.dropna(subset=required)
    roles = dict(roles or exog_roles(base, required))
    kinds = {f.name: f.dataType for f in base.schema}
    roles = {r: [c for c in dict.fromkeys(cols) if c in kinds and _numeric(kinds[c])] for r, cols in roles.items()}
    used = [c for cols in roles.values() for c in cols]
    fit = base.select(*required, *[F.col(c).cast("double").alias(c) for c in used])
    fills: dict[str, float] = {}
    if used:
        row = group_quantiles(fit, [], {c: (c, 0.5) for c in used}).first()
        fills = {c: (0.0 if row[c] is None else float(row[c])) for c in used}
        fit = fit.fillna(fills)
    ahead = None
    if future is not None:
        cols = {}
        for c in roles.get("futr_exog", []):
            cols[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(fills[c])) if c in future.columns else F.lit(fills[c])
        ahead = future.dropna(subset=[id_col, time_col]).withColumns(cols).select(id_col, time_col, *cols)
    return fit, ahead, roles


def static_frame(df: DataFrame, order: Sequence[str], id_col: str = "unique_id", columns: Sequence[str] | None = None) -> DataFrame:
    """The last known ``stat_*`` values per id."""
    cols = [c for c in (columns or df.columns) if c in df.columns and c != id_col and (columns or c.startswith("stat_"))]
    picked = df.select(id_col, *dict.fromkeys([*cols, *order]))
    return keep_last(picked, [id_col], order).select(id_col, *cols)


def feature_families(csv: str | None) -> tuple[str, ...]:
    names = tuple(dict.fromkeys(v.strip().lower() for v in (csv or "").split(",") if v.strip()))
    unknown = [n for n in names if n not in FAMILIES]
    if unknown:
        raise ValueError(f"unknown feature families: {unknown}")
    return names or ("base", "hist", "stat")


def prefix_projection(df: DataFrame, spec: SeriesSpec, base: bool = True) -> DataFrame:
    """Keys, time and target followed by the ``hist_``, ``stat_`` and ``feat_`` columns only."""
    first = [*spec.keys, spec.time_col, spec.target_col] if base else []
    return df.select(*first, *[c for c in df.columns if c.startswith(("hist_", "stat_", "feat_"))])


def eval_keys(df: DataFrame, order_col: str, id_col: str = "unique_id", time_col: str = "ds") -> DataFrame:
    """Text ids and UTC times without NULLs; the last row per (id, time)."""
    t = F.col(time_col)
    if isinstance(df.schema[time_col].dataType, T.StringType):
        t = F.try_to_timestamp(t)
    out = df.withColumns({id_col: F.col(id_col).cast("string"), time_col: t.cast("timestamp")})
    return keep_last(out.dropna(subset=[id_col, time_col]), [id_col, time_col], [order_col])


def stable_id(*parts: Column) -> Column:
    """Positive 63-bit number from the SHA-1 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    head = F.conv(F.substr(F.sha1(text), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")
    value = (head % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")
    return F.when(value == 0, F.lit(1)).otherwise(value).cast("long")


def ensure_row_id(df: DataFrame, spec: SeriesSpec, configured: str | None = None, source: str | None = None) -> DataFrame:
    """Give every row a numeric ``loto_y_ts_row_id``.

    The first candidate column present is cast; values that are no numbers are hashed with the row's keys and its
    number among equal rows, so the id does not depend on the input order.
    """
    names = [f"{source}_row_id" if source else None, "loto_y_ts_row_id", configured, "row_id", "id", "unique_id"]
    chosen = next((n for n in names if n and n in df.columns), None)
    keyed = [c for c in ("loto", "ts_type", spec.time_col, "unique_id") if c in df.columns]
    if chosen is not None and isinstance(df.schema[chosen].dataType, T.IntegralType):
        return df.withColumn("loto_y_ts_row_id", F.col(chosen).cast("long"))
    group = list(dict.fromkeys([*([chosen] if chosen else []), *keyed]))

    def build(frame, _w):
        hashed = stable_id(F.lit(chosen or ""), *[F.col(c) for c in group], F.col("_pos") + 1)
        number = F.col(chosen).try_cast("double").try_cast("long") if chosen else F.lit(None).cast("long")
        return frame.withColumn("loto_y_ts_row_id", F.coalesce(number, hashed))

    return over_groups(df, group, [*spec.order], build)


def is_success(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))) == "success"


def is_blank(text: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit("")).isNull()


def prefix_collision(table: str, column: str) -> str:
    """``hist_x`` of table ``t`` becomes ``hist_t_x``: the role prefix stays first."""
    for prefix in ("hist_", "stat_", "feat_"):
        if column.startswith(prefix):
            return f"{prefix}{table}_{column[len(prefix):]}"
    return f"{table}_{column}"


def normalize_category(c: Column, allowed: Sequence[str], aliases: Mapping[str, str] | None = None, default: str = "unknown") -> Column:
    """Trimmed lower-case category after aliases; anything not allowed becomes the default."""
    text = F.lower(F.trim(c.cast("string")))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        text = F.coalesce(F.try_element_at(table, text), text)
    return F.when(text.isin(list(allowed)), text).otherwise(F.lit(default))


def present_categories(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The categories that occur, in the given order."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column)).cast("long")
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", rank).where("rank > 0")
