"""What a whole history leaves for models that see all of it: sums that add up over any cut of its rows.

One pass over ordered rows gives every series a state of fixed size, whatever its length; any number of model settings is then
answered from the states alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SeriesSpec
from .series import Layout, measure, over_groups


@dataclass(frozen=True)
class History:
    """The state of one series; values are centred and scaled.

    ``products[d]`` sums the products of values ``d`` rows apart, ``decayed[rate]`` sums values weighted by ``rate ** age``, where
    the last value has age 0. ``first`` holds the oldest values in time order, ``last`` the newest ones, newest first.
    """

    n: int
    center: float
    scale: float
    total: float
    products: np.ndarray
    decayed: dict[float, float]
    first: np.ndarray
    last: np.ndarray

    def cross(self, k: int) -> np.ndarray:
        """The products of (1, lags from far to near, value) summed over all rows that have ``k`` rows before them.

        A product of two lags runs over the whole history but for a few rows at its ends, which the first and the last values give.
        """
        out = np.zeros((k + 2, k + 2))
        out[0, 0] = self.n - k
        for a in range(k + 1):
            out[0, k + 1 - a] = self.total - self.first[: k - a].sum() - self.last[:a].sum()
            for b in range(a, k + 1):
                d = b - a
                head = (self.first[d : k - a] * self.first[: max(k - a - d, 0)]).sum()
                tail = (self.last[:a] * self.last[d : a + d]).sum()
                out[k + 1 - b, k + 1 - a] = self.products[d] - head - tail
        return np.triu(out) + np.triu(out, 1).T


def histories(df: DataFrame, spec: SeriesSpec, lags: int, rates: Sequence[float], hold: int = 0, layout: Layout | None = None) -> DataFrame:
    """(keys, _n, _center, _scale, _total, _products, _decayed, _first, _last) of the observed rows but the last ``hold`` of each series."""
    lags = max(lags, 1)
    y = F.col(spec.target_col).cast("double")
    seen = df.where(y.isNotNull())
    from_end = F.col("_n") - 1 - F.col("_pos")

    def build(frame, w):
        scale = F.when(F.col("_spread") > 0, F.col("_spread")).otherwise(1.0)
        frame = frame.withColumns({"_age": from_end - hold, "_place": F.col("_pos"), "_c": F.col("_middle"), "_d": scale, "_z": (y - F.col("_middle")) / scale})
        return frame.withColumns({f"_z{k}": F.lag("_z", k).over(w) for k in range(1, lags + 1)})

    whole = {"_n": F.count(F.lit(1)), "_middle": F.avg(y), "_spread": F.stddev_pop(y)}
    rows = over_groups(seen, spec.keys, spec.order, build, back=lags, whole=whole, layout=layout or measure(df, spec.keys), fresh=True).where("_age >= 0")
    z, age = F.col("_z"), F.col("_age")
    at = lambda column, i: F.sum(F.when(F.col(column) == i, z).otherwise(0.0))
    return rows.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("_c").alias("_center"),
        F.first("_d").alias("_scale"),
        F.sum(z).alias("_total"),
        F.array(F.sum(z * z), *[F.sum(F.coalesce(z * F.col(f"_z{k}"), F.lit(0.0))) for k in range(1, lags + 1)]).alias("_products"),
        F.array(*[F.sum(F.pow(F.lit(float(r)), age) * z) for r in rates]).cast("array<double>").alias("_decayed"),
        F.array(*[at("_place", i) for i in range(lags)]).alias("_first"),
        F.array(*[at("_age", i) for i in range(lags)]).alias("_last"),
    )
