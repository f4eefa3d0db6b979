"""Value objects that name the columns of a long series table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns hold the series key, the time, the target and the tie-break order.

    ``order_cols`` makes the row order total when two rows of a series share a time. Operators that
    say "first" or "last" mean the order ``(time_col, *order_cols)``.
    """

    group_cols: tuple[str, ...] = ("loto", "unique_id", "ts_type")
    time_col: str = "ds"
    target_col: str = "y"
    order_cols: tuple[str, ...] = ()

    @property
    def keys(self) -> list[str]:
        return list(self.group_cols)

    @property
    def order(self) -> list[str]:
        return [self.time_col, *self.order_cols]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def order_struct(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def with_target(self, name: str) -> "SeriesSpec":
        return replace(self, target_col=name)


def clean_target(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Cast the target to double with every unparsable or NaN value turned into NULL."""
    y = F.col(spec.target_col).try_cast("double")
    return df.withColumn(spec.target_col, F.nanvl(y, F.lit(None).cast("double")))


def require_columns(df: DataFrame, names) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
