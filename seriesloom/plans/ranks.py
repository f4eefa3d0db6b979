"""Ranks and empirical distribution functions from value counts.

Counting equal values first shrinks the data before anything is ordered and makes a value that fills a third
of the table a single row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Layout, attach, measure, over_groups, split


def value_table(df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (group, distinct value): ``_c`` rows, ``_before`` rows with a smaller value.

    ``counts`` adds conditional counts; each gets its own ``<name>`` and ``<name>_before``.
    """
    keys = list(keys)
    counts = dict(counts or {})
    table = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_c"), *[F.sum(e.cast("long")).alias(n) for n, e in counts.items()])
    )
    running = {"_r": F.col("_c")} | {f"_r_{n}": F.col(n) for n in counts}

    def build(frame, _w):
        return frame.withColumns({"_before": F.col("_r")} | {f"{n}_before": F.col(f"_r_{n}") for n in counts})

    return over_groups(table, keys, [value], build, running=running)


def average_rank() -> Column:
    """1-based rank of a value-table row, ties sharing their mean rank."""
    return F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)


def tail_counts(df: DataFrame, keys, value: str, layout: Layout | None = None) -> DataFrame:
    """Add ``_le`` / ``_ge`` (group values at or below / above the row's value) and ``_n``."""
    layout = layout or measure(df, keys)
    v = F.col(value)

    def plain(part: DataFrame) -> DataFrame:
        g = Window.partitionBy(*keys)
        return part.withColumns(
            {
                "_le": F.when(v.isNotNull(), F.count(v).over(g.orderBy(v.asc()))),
                "_ge": F.when(v.isNotNull(), F.count(v).over(g.orderBy(v.desc()))),
                "_n": F.count(v).over(g),
            }
        )

    def counted(part: DataFrame) -> DataFrame:
        table = value_table(part, keys, value)
        sizes = part.groupBy(*keys).agg(F.count(v).alias("_n"))
        table = table.select(*keys, value, (F.col("_before") + F.col("_c")).alias("_le"), F.col("_before"))
        out = attach(attach(part, table, [*keys, value], layout.hot_rows), sizes, keys, layout.hot_groups)
        return out.withColumn("_ge", F.col("_n") - F.col("_before")).drop("_before")

    if layout.plain:
        return plain(df)
    if layout.everything:
        return counted(df)
    cold, hot = split(df, keys, layout)
    return plain(cold).unionByName(counted(hot))


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, layout: Layout | None = None) -> DataFrame:
    """Add the 1-based rank of the row's value in its group, ties sharing their mean rank."""
    counted = tail_counts(df, keys, value, layout)
    rank = (F.col("_le") + F.col("_n") - F.col("_ge") + 1) / F.lit(2.0)
    return counted.withColumn(name, rank).drop("_le", "_ge", "_n")
