"""Ordered work inside groups of any size.

A window ``partitionBy(keys)`` sends a whole group to one task. That is the best plan while groups are
small, and no plan at all when one group holds a third of the table. ``over_groups`` measures the groups
first (one partial aggregate over the key columns) and then runs

* ordinary groups through one plain window: one exchange, one sort;
* oversized groups through *blocks*: a range exchange gives every row its exact position in the group, the
  group is cut into blocks of equal row counts, and each block receives copies of the few neighbouring rows its
  frames can reach (the halo). What a frame cannot carry (sums over all earlier rows, last value seen, whole
  group aggregates) comes from one small row per block.

Both paths run the same ``build`` function, so a feature is written once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import durable, rows_per_task

PLACED = "_placed"
MAX_LISTED_GROUPS = 10_000
BROADCAST_ROWS = 1_000_000

Build = Callable[[DataFrame, WindowSpec], DataFrame]


@dataclass(frozen=True)
class Layout:
    """Result of measuring a frame: which groups are too large for one task."""

    limit: int
    hot: DataFrame | None  # key columns of the oversized groups, None when there are none
    hot_groups: int  # how many there are, or an upper bound
    hot_rows: int
    everything: bool = False  # every group of the frame is to be treated as oversized
    order: tuple[str, ...] = ()  # the frame carries exact positions for this order

    @property
    def plain(self) -> bool:
        return self.hot is None and not self.everything


def measure(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> Layout:
    """Find groups above the row limit. Reads the key columns only and aggregates before the exchange."""
    spark = df.sparkSession
    limit = limit or rows_per_task(spark)
    if not keys:
        n = df.count()
        return Layout(limit, None, 1, n, everything=n > limit)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    rows = sizes.limit(MAX_LISTED_GROUPS + 1).collect()
    if not rows:
        return Layout(limit, None, 0, 0)
    if len(rows) > MAX_LISTED_GROUPS:
        n = df.count()
        return Layout(limit, None, n, n, everything=True)
    total = sum(r["_n"] for r in rows)
    if total == df.count():  # no ordinary group: nothing to split, and the frame is read once
        return Layout(limit, None, len(rows), total, everything=True)
    hot = spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], df.select(*keys).schema)
    return Layout(limit, hot, len(rows), total)


def split(df: DataFrame, keys: Sequence[str], layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(ordinary rows, rows of oversized groups); the key list is bounded by ``MAX_LISTED_GROUPS``."""
    names = {k: f"_k_{i}" for i, k in enumerate(keys)}
    hot = F.broadcast(layout.hot.withColumnsRenamed(names))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return df.join(hot, cond, "left_anti"), df.join(hot, cond, "left_semi")


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Left join per-group values on null-safe keys; broadcast only when ``rows`` is known to be small."""
    names = {k: f"_k_{i}" for i, k in enumerate(keys)}
    side = small.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in small.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys], F.lit(True))
    side = F.broadcast(side) if rows <= BROADCAST_ROWS else side
    return df.join(side, cond, "left").drop(*names.values())


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, layout: Layout, rows: int | None = None) -> DataFrame:
    """Add ``_pos``: the row's 0-based place inside its group, without sorting any group in one task.

    A range exchange on (keys, order) spreads a large group over many partitions in order. The sorted result
    is made durable so that the partition borders used for counting and for numbering are the same ones.
    """
    rows = layout.hot_rows if rows is None else rows
    parts = max(2, math.ceil(4 * rows / layout.limit))
    by = [F.col(k) for k in keys] + [o if isinstance(o, Column) else F.col(o) for o in order]
    ranged = (
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ranged = durable(ranged).withColumn("_part", F.shiftright("_mid", 33))
    runs = ranged.groupBy(*keys, "_part").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_pos_shift"))
    out = attach(ranged, runs, [*keys, "_part"], parts + layout.hot_groups)
    return out.withColumn("_pos", F.col("_mid") + F.col("_pos_shift")).drop("_mid", "_part", "_pos_shift")


def over_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    build: Build,
    *,
    back: int = 0,
    ahead: int = 0,
    running: Mapping[str, Column] | None = None,
    whole: Mapping[str, Column] | None = None,
    carry: Mapping[str, Column] | None = None,
    carry_back: Mapping[str, Column] | None = None,
    moments: Mapping[str, Column] | None = None,
    layout: Layout | None = None,
    fresh: bool = False,
) -> DataFrame:
    """Run ``build(frame, window)`` over ordered groups.

    The frame offers ``_pos`` (0-based row number) and the named helper columns:

    running     sum over all strictly earlier rows (NULL counts as 0)
    whole       aggregate over the whole group
    carry       last non-NULL value up to and including the row
    carry_back  first non-NULL value at or after the row
    moments     ``<name>_n``, ``<name>_mean``, ``<name>_m2`` (sum of squared deviations) over strictly earlier rows

    ``back``/``ahead`` state how many rows the frames in ``build`` may reach. Helper columns are dropped. ``fresh`` must be
    set when rows were filtered out since the frame was measured, so that carried positions are not trusted.
    """
    running, whole = dict(running or {}), dict(whole or {})
    carry, carry_back, moments = dict(carry or {}), dict(carry_back or {}), dict(moments or {})
    layout = layout or measure(df, keys)
    helpers = ["_pos", *running, *whole, *carry, *carry_back]
    helpers += [f"{n}_{part}" for n in moments for part in ("n", "mean", "m2")]

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        group = Window.partitionBy(*keys)
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        onward = w.rowsBetween(0, Window.unboundedFollowing)
        cols = {"_pos": F.row_number().over(w) - 1}
        cols |= {n: F.coalesce(F.sum(e).over(past), F.lit(0)) for n, e in running.items()}
        cols |= {n: e.over(group) for n, e in whole.items()}
        cols |= {n: F.last(e, ignorenulls=True).over(upto) for n, e in carry.items()}
        cols |= {n: F.first(e, ignorenulls=True).over(onward) for n, e in carry_back.items()}
        for n, e in moments.items():
            cols |= {
                f"{n}_n": F.count(e).over(past),
                f"{n}_mean": F.avg(e).over(past),
                f"{n}_m2": F.var_pop(e).over(past) * F.count(e).over(past),
            }
        return build(part.withColumns(cols), w).drop(*helpers)

    if layout.plain:
        return plain(df)

    def blocked(part: DataFrame) -> DataFrame:
        out = _blocked(part, keys, order, build, back, ahead, running, whole, carry, carry_back, moments, layout, fresh)
        return out.drop(*helpers)

    if layout.everything:
        return blocked(df)
    cold, hot = split(df, keys, layout)
    return plain(cold).unionByName(blocked(hot))


def by_size(operator):
    """Run a many-step operator ``(df, spec, ..., layout)`` separately on ordinary and on oversized series.

    The split happens once, and the oversized part gets its row positions once; the steps inside reuse both.
    """

    @wraps(operator)
    def run(df: DataFrame, spec, *args, layout: Layout | None = None, **kw) -> DataFrame:
        layout = layout or measure(df, spec.keys)
        if layout.plain or layout.everything and layout.order:
            return operator(df, spec, *args, layout=layout, **kw)
        order = tuple(spec.order)
        pure = replace(layout, hot=None, everything=True, order=order)

        def large(part: DataFrame) -> DataFrame:
            placed = positions(part, spec.keys, order, layout).withColumnRenamed("_pos", PLACED)
            return operator(placed, spec, *args, layout=pure, **kw).drop(PLACED)

        if layout.everything:
            return large(df)
        cold, hot = split(df, spec.keys, layout)
        small = operator(cold, spec, *args, layout=replace(layout, hot=None, hot_groups=0, hot_rows=0), **kw)
        return small.unionByName(large(hot))

    return run


def _blocked(df, keys, order, build, back, ahead, running, whole, carry, carry_back, moments, layout, fresh) -> DataFrame:
    size = max(layout.limit // 4, back, ahead, 1)
    if not fresh and layout.order and tuple(order) == layout.order and PLACED in df.columns:
        placed = df.withColumn("_pos", F.col(PLACED))
    else:
        placed = positions(df, keys, order, layout)
    placed = placed.withColumn("_home", F.floor(F.col("_pos") / size))

    # One row per (group, block): what the block adds to running sums, and its last / first values.
    blocks = math.ceil(layout.hot_rows / size) + layout.hot_groups
    summary = [F.sum(e).alias(f"_s_{n}") for n, e in running.items()]
    summary += [F.max_by(e, F.when(e.isNotNull(), F.col("_pos"))).alias(f"_l_{n}") for n, e in carry.items()]
    summary += [F.min_by(e, F.when(e.isNotNull(), F.col("_pos"))).alias(f"_f_{n}") for n, e in carry_back.items()]
    for n, e in moments.items():
        summary += [F.count(e).alias(f"_mn_{n}"), F.avg(e).alias(f"_mm_{n}"), F.var_pop(e).alias(f"_mv_{n}")]
    border = None
    if summary:
        per_block = placed.groupBy(*keys, "_home").agg(*summary)
        w = Window.partitionBy(*keys).orderBy("_home")
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        later = w.rowsBetween(1, Window.unboundedFollowing)
        group = Window.partitionBy(*keys)
        for n in moments:
            total = F.sum(f"_mn_{n}").over(group)
            per_block = per_block.withColumn(f"_mc_{n}", F.sum(F.col(f"_mn_{n}") * F.col(f"_mm_{n}")).over(group) / total)
        pooled = []
        for n in moments:
            # Pool the earlier blocks around the group mean, which keeps the squared sums well conditioned.
            cnt, mean, var = F.col(f"_mn_{n}"), F.coalesce(F.col(f"_mm_{n}"), F.lit(0.0)), F.coalesce(F.col(f"_mv_{n}"), F.lit(0.0))
            center = F.coalesce(F.col(f"_mc_{n}"), F.lit(0.0))
            n0 = F.coalesce(F.sum(cnt).over(earlier), F.lit(0))
            s1 = F.coalesce(F.sum(cnt * (mean - center)).over(earlier), F.lit(0.0))
            s2 = F.coalesce(F.sum(cnt * (var + (mean - center) * (mean - center))).over(earlier), F.lit(0.0))
            shift = F.try_divide(s1, n0)
            pooled += [n0.alias(f"_mn_{n}"), (center + shift).alias(f"_mm_{n}"), (s2 - s1 * shift).alias(f"_mv_{n}")]
        border = per_block.select(
            *keys,
            F.col("_home").alias("_blk"),
            *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in running],
            *[F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in carry],
            *[F.first(f"_f_{n}", ignorenulls=True).over(later).alias(f"_f_{n}") for n in carry_back],
            *pooled,
        )

    offset = F.col("_pos") - F.col("_home") * size
    targets = [F.col("_home")]
    if back:
        targets.append(F.when(offset >= size - back, F.col("_home") + 1))
    if ahead:
        targets.append(F.when(offset < ahead, F.col("_home") - 1))
    frame = placed.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))))
    frame = frame.withColumn("_own", F.col("_blk") == F.col("_home"))
    if border is not None:
        frame = attach(frame, border, [*keys, "_blk"], blocks)
    if whole:
        stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in whole.items()])
        frame = attach(frame, stats, keys, layout.hot_groups)

    w = Window.partitionBy(*keys, "_blk").orderBy("_pos")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    own = F.col("_own")
    cols = {
        n: F.col(f"_s_{n}") + F.coalesce(F.sum(F.when(own, e)).over(past), F.lit(0)) for n, e in running.items()
    }
    cols |= {n: F.coalesce(F.last(F.when(own, e), ignorenulls=True).over(upto), F.col(f"_l_{n}")) for n, e in carry.items()}
    cols |= {n: F.coalesce(F.first(F.when(own, e), ignorenulls=True).over(onward), F.col(f"_f_{n}")) for n, e in carry_back.items()}
    for n, e in moments.items():
        mine = F.when(own, e)
        na, ma, qa = F.col(f"_mn_{n}"), F.col(f"_mm_{n}"), F.coalesce(F.col(f"_mv_{n}"), F.lit(0.0))
        nb = F.count(mine).over(past)
        mb, qb = F.avg(mine).over(past), F.coalesce(F.var_pop(mine).over(past), F.lit(0.0)) * nb
        both = na + nb
        delta = F.when((na > 0) & (nb > 0), mb - ma).otherwise(F.lit(0.0))
        cols |= {
            f"{n}_n": both,
            f"{n}_mean": F.when(na == 0, mb).otherwise(ma + delta * nb / both),
            f"{n}_m2": F.when(both > 0, qa + qb + delta * delta * na * nb / both),
        }
    if cols:
        frame = frame.withColumns(cols)
    extra = [f"_s_{n}" for n in running] + [f"_l_{n}" for n in carry] + [f"_f_{n}" for n in carry_back]
    extra += [f"_m{part}_{n}" for n in moments for part in "nmv"]
    return build(frame, w).where("_own").drop("_own", "_blk", "_home", *extra)
