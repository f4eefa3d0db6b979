"""Joins of feature tables and run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.series import BROADCAST_ROWS, Layout, attach, measure, over_groups
from ..session import durable, held
from .prep import keep_last, prefix_collision


@dataclass
class UnifiedResult:
    frame: DataFrame
    joined: list[str] = field(default_factory=list)
    keys: dict[str, list[str]] = field(default_factory=dict)
    skipped: list[dict[str, str]] = field(default_factory=list)


def join_keys(left: Sequence[str], right: Sequence[str], id_col: str = "unique_id", time_col: str = "ds") -> list[str]:
    """A shared row id if there is one, else id and time plus the optional group columns both sides have."""
    both = set(left) & set(right)
    for name in ("loto_y_ts_row_id", "row_id"):
        if name in both:
            return [name]
    if id_col in both and time_col in both:
        return [id_col, time_col, *[c for c in ("loto", "ts_type") if c in both]]
    return []


def select_tables(names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    return [n for n in names if (not include or n in include) and n not in exclude]


def unified_dataset(
    base: DataFrame,
    history: tuple[str, DataFrame | None] | None = None,
    exog: Mapping[str, DataFrame] | None = None,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    id_col: str = "unique_id",
    time_col: str = "ds",
) -> UnifiedResult:
    """Left join the history table and every chosen feature table onto the base.

    Each right side is first reduced to its last row per key, so no join multiplies rows. Tables without common keys
    are reported, not guessed at. Columns that are already there are renamed after their table.
    """
    result = UnifiedResult(base)
    tables: list[tuple[str, DataFrame | None]] = [history] if history else []
    exog = dict(exog or {})
    tables += [(n, exog[n]) for n in select_tables(list(exog), include, exclude)]
    for name, table in tables:
        if table is None:
            result.skipped.append({"table": name, "reason": "table not found"})
            continue
        keys = join_keys(result.frame.columns, table.columns, id_col, time_col)
        if not keys:
            result.skipped.append({"table": name, "reason": "no common join keys"})
            continue
        short = name.split(".")[-1]
        taken = set(result.frame.columns) - set(keys)
        values = [c for c in table.columns if c not in keys and c not in (id_col, time_col, "loto", "ts_type", "y")]
        order = [c for c in (time_col, *values) if c in table.columns and c not in keys] or values
        right = keep_last(table.select(*keys, *dict.fromkeys([*values, *order])), keys, order) if order else table.select(*keys).distinct()
        renamed = {c: prefix_collision(short, c) for c in values if c in taken}
        right = right.select(*keys, *values).withColumnsRenamed(renamed)
        result.frame = result.frame.join(right, keys, "left")
        result.joined.append(name)
        result.keys[name] = keys
    return result


def last_per_key(df: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """The right side of a feature join: one row per key, the last by time and then by the other values."""
    rest = [c for c in df.columns if c not in keys]
    order = list(dict.fromkeys([*([time_col] if time_col in rest else []), *rest]))
    return keep_last(df, keys, order)


def actual_forecast(actual: DataFrame, forecast: DataFrame, model_col: str, id_col: str = "unique_id", time_col: str = "ds", target_col: str = "y") -> DataFrame:
    left = actual.select(id_col, time_col, target_col)
    return left.join(forecast.select(id_col, time_col, model_col), [id_col, time_col], "inner")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    take: Mapping[str, str],
    right_order: Sequence[str] = (),
    layout: Layout | None = None,
) -> DataFrame:
    """Give each left row the latest right row of the same key with ``right_time <= left_time``.

    Both sides are laid into one ordered sequence per key and the last right row is carried forward: one exchange, no
    inequality join, and a key of any size is split into blocks. ``take`` maps right columns to output names. Of right rows at
    one time the last by ``right_order`` counts, compared in the columns' own types. A NULL key or time matches nothing.

    Where keys are too large for one task but left rows share few (key, time) pairs, the pairs are matched in their place and the
    matches broadcast back, so no left row is moved.
    """
    if layout is None:
        layout = measure(right.select(F.col(key).alias(key)).unionByName(left.select(F.col(key).alias(key))), [key])
    if not layout.plain:
        pairs = held(left.where(F.col(key).isNotNull() & F.col(left_time).isNotNull()).select(F.col(key).alias("_ak"), F.col(left_time).alias("_at")).distinct()) if _repeats(left, key, left_time) else None
        if pairs is not None:
            few = right.where(F.col(right_time).isNotNull() & F.col(key).isNotNull()).withColumnRenamed(key, "_ak")
            hits = durable(_matched(pairs, few, "_ak", "_at", right_time, take, right_order, None))
            kept = left.select(*left.columns, F.col(key).alias("_lk"), F.col(left_time).alias("_lt"))
            out = hits.select(F.col("_ak").alias("_lk"), F.col("_at").alias("_lt"), F.struct(*[F.col(n) for n in take.values()]).alias("_hit"))
            joined = attach(kept, out, ["_lk", "_lt"], hits.count())
            return joined.select(*[F.col(c) for c in left.columns], *[F.col("_hit")[n].alias(n) for n in take.values()])
    return _matched(left, right, key, left_time, right_time, take, right_order, layout)


def _repeats(left: DataFrame, key: str, time: str) -> bool:
    """Whether distinct (key, time) pairs are few: at most a quarter of the rows, and a table small enough to broadcast."""
    n, pairs = left.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(F.col(key), F.col(time)))).first()
    return pairs <= min(n / 4, BROADCAST_ROWS / 2)


def _matched(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, take: Mapping[str, str], right_order: Sequence[str], layout: Layout | None) -> DataFrame:
    fields = [F.col(c).alias(n) for c, n in take.items()]
    tie = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(right_order)]) if right_order else None
    row = F.struct(*[F.col(c) for c in left.columns])
    left_side = left.select(
        F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row")
    )
    hit = F.struct(*fields)
    right_side = right.where(F.col(right_time).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), hit.alias("_hit"), *([tie.alias("_tie")] if tie is not None else [])
    )
    both = right_side.unionByName(left_side, allowMissingColumns=True)
    order = ["_t", "_side", *(["_tie"] if tie is not None else [])]
    matched = over_groups(
        both, [key], order, lambda f, _w: f.withColumn("_got", F.col("_seen")), carry={"_seen": F.col("_hit")}, layout=layout
    )
    got = F.when(F.col("_t").isNotNull(), F.col("_got"))
    return matched.where("_side = 1").select("_row.*", *[got[n].alias(n) for n in take.values()])
