"""Exact quantiles per group.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Ordinary groups use it; for
oversized ones a sketch first brackets each order statistic, and counting what lies below and inside the brackets
then gives it exactly: two passes for all columns and quantiles together, nothing is sorted. Brackets that miss, which
the counts show, leave their quantiles to exact row positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import rows_per_task
from .series import MAX_LISTED_GROUPS, Layout, attach, measure, positions, split

#: Rows from which a group's quantiles are bracketed; buffers of so many values are slow long before they are too large.
BUFFERED_ROWS = 200_000
#: A sketch's rank error is at most one in so many rows.
ACCURACY = 10_000


def quantile_layout(df: DataFrame, keys: Sequence[str]) -> Layout:
    return measure(df, keys, min(rows_per_task(df.sparkSession), BUFFERED_ROWS))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    layout: Layout | None = None,
) -> DataFrame:
    """One row per group with ``name -> quantile p of column`` (linear interpolation, NULLs ignored)."""
    keys = list(keys)
    layout = layout or quantile_layout(df, keys)

    def builtin(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(*[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()])

    if layout.plain:
        return builtin(df)
    if layout.everything:
        return _oversized(df, keys, wanted, layout)
    cold, hot = split(df, keys, layout)
    return builtin(cold).unionByName(_oversized(hot, keys, wanted, layout))


def _oversized(df: DataFrame, keys, wanted, layout: Layout) -> DataFrame:
    if layout.hot_groups > MAX_LISTED_GROUPS:
        return _by_position(df, keys, wanted, layout)
    rows = _bracketed(df, keys, wanted)
    if rows is None:
        return _by_position(df, keys, wanted, layout)
    return df.sparkSession.createDataFrame(rows, _typed(df, keys, [T.StructField(n, T.DoubleType()) for n in wanted]))


def _typed(df: DataFrame, keys, fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*(df.select(*keys).schema.fields if keys else []), *fields])


def _bracketed(df: DataFrame, keys, wanted) -> list[tuple] | None:
    """One tuple (keys, quantiles) a group, for at most ``MAX_LISTED_GROUPS`` groups; None when a bracket misses its ranks."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    names = {c: [n for n, (own, _) in wanted.items() if own == c] for c in columns}
    at = {c: f"_q{i}" for i, c in enumerate(columns)}
    spot = {n: i for i, n in enumerate(wanted)}
    # -0.0 counts as 0.0 in every comparison, so it may not be a value of its own.
    values = df.select(*keys, *[(F.col(c).cast("double") + F.lit(0.0)).alias(at[c]) for c in columns])
    sketch = []
    for c in columns:
        probs = {n: float(wanted[n][1]) for n in names[c]}
        ends = [e for p in probs.values() for e in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
        edges = F.percentile_approx(at[c], ends, ACCURACY)  # one sketch a column
        for i, (n, p) in enumerate(probs.items()):
            low = F.lit(float("-inf")) if p <= 2 / ACCURACY else F.get(edges, 2 * i)
            high = F.lit(float("nan")) if p >= 1 - 2 / ACCURACY else F.get(edges, 2 * i + 1)
            sketch.append(F.struct(low.alias("l"), high.alias("h")).alias(f"_b{spot[n]}"))
    groups = values.groupBy(*keys).agg(*sketch).collect()
    if not groups:
        return []
    bound = T.StructType([T.StructField("l", T.DoubleType()), T.StructField("h", T.DoubleType())])
    fields = [*[T.StructField(f"_b{i}", bound) for i in spot.values()], T.StructField("_bg", T.IntegerType())]
    brackets = df.sparkSession.createDataFrame([(*g, place) for place, g in enumerate(groups)], _typed(df, keys, fields))
    placed = attach(values, brackets, keys, len(groups)) if keys else values.crossJoin(F.broadcast(brackets))

    # 0 below, 1 inside, 2 above, NULL without a value; only what is inside keeps its value. Few distinct rows are left, with the
    # greatest value below and the least one above for ranks right next to a bracket.
    codes, kept = [], []
    for n, (c, _) in wanted.items():
        v, b = F.col(at[c]), F.col(f"_b{spot[n]}")
        side = F.when(v < b["l"], 0).when(v <= b["h"], 1).when(v.isNotNull(), 2)
        codes.append(side.alias(f"_s{spot[n]}"))
        kept.append(F.when((v >= b["l"]) & (v <= b["h"]), v).alias(f"_v{spot[n]}"))
    spots = list(spot.values())
    ends = [f(at[c]).alias(f"_{name}{at[c]}") for c in columns for name, f in (("max", F.max), ("min", F.min))]
    counted = placed.select("_bg", *at.values(), *codes, *kept).groupBy("_bg", *[f"_s{i}" for i in spots], *[f"_v{i}" for i in spots]).agg(F.count(F.lit(1)).alias("_c"), *ends)
    entries = []
    for n, (c, _) in wanted.items():
        i = spot[n]
        entries.append(F.struct(F.lit(i).alias("i"), F.col(f"_s{i}").alias("s"), F.col(f"_v{i}").alias("v"), F.col(f"_max{at[c]}").alias("a"), F.col(f"_min{at[c]}").alias("b")))
    long = counted.select("_bg", "_c", F.explode(F.array(*entries)).alias("_e")).select("_bg", "_c", "_e.*")
    long = long.groupBy("_bg", "i", "s", "v").agg(F.sum("_c").alias("_c"), F.max("a").alias("a"), F.min("b").alias("b"))
    group = Window.partitionBy("_bg", "i")
    known = long.where(F.col("s").isNotNull()).withColumns(
        {"_n": F.sum("_c").over(group), "_before": F.sum("_c").over(group.orderBy("s", "v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")}
    )
    probs = F.array(*[F.lit(float(p)) for _, p in wanted.values()])
    rank = F.get(probs, F.col("i")) * (F.col("_n") - 1)

    def pick(r):
        s, first, last = F.col("s"), F.col("_before"), F.col("_before") + F.col("_c") - 1
        inside = F.when((s == 1) & (first <= r) & (r <= last), F.col("v"))
        return F.max(F.coalesce(inside, F.when((s == 0) & (r == last), F.col("a")), F.when((s == 2) & (r == first), F.col("b"))))

    found = known.groupBy("_bg", "i").agg(pick(F.floor(rank)).alias("lo"), pick(F.ceil(rank)).alias("hi"), F.max(rank - F.floor(rank)).alias("part"))
    out = [[*(g[k] for k in keys), *[None] * len(wanted)] for g in groups]
    for r in found.collect():
        if r["lo"] is None or r["hi"] is None:
            return None
        out[r["_bg"]][len(keys) + r["i"]] = r["lo"] + (r["hi"] - r["lo"]) * r["part"]
    return [tuple(row) for row in out]


def _by_position(df: DataFrame, keys, wanted, layout: Layout) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_group_rows"))
    groups = layout.hot_groups
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        probs = {n: p for n, (c, p) in wanted.items() if c == column}
        values = df.select(*keys, F.col(column).cast("double").alias("_v")).where("_v is not null")
        sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        placed = attach(positions(values, keys, ["_v"], layout), sizes, keys, groups)
        picks = []
        for name, p in probs.items():
            rank = F.lit(float(p)) * (F.col("_n") - 1)
            low, high = F.floor(rank), F.ceil(rank)
            lo = F.max(F.when(F.col("_pos") == low, F.col("_v")))
            hi = F.max(F.when(F.col("_pos") == high, F.col("_v")))
            part = F.max(rank - low)
            picks.append((lo + (hi - lo) * part).alias(name))
        out = attach(out, placed.groupBy(*keys).agg(*picks), keys, groups)
    return out.select(*keys, *wanted)


def with_group_quantiles(df: DataFrame, keys: Sequence[str], wanted, layout: Layout | None = None) -> DataFrame:
    """Put the group's quantiles on each of its rows."""
    keys = list(keys)
    layout = layout or quantile_layout(df, keys)
    if not keys:
        row = group_quantiles(df, keys, wanted, layout).first()
        return df.withColumns({n: F.lit(row[n]).cast("double") for n in wanted})

    def in_place(part: DataFrame) -> DataFrame:
        g = Window.partitionBy(*keys)
        return part.withColumns({n: F.percentile(c, F.lit(p)).over(g) for n, (c, p) in wanted.items()})

    if layout.plain:
        return in_place(df)
    if layout.everything:
        return attach(df, _oversized(df, keys, wanted, layout), keys, layout.hot_groups)
    cold, hot = split(df, keys, layout)
    return in_place(cold).unionByName(attach(hot, _oversized(hot, keys, wanted, layout), keys, layout.hot_groups))
