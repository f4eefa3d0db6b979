"""Cross-product matrices of many rows, summed where the rows are.

Every Arrow batch is reduced to one small matrix per key before anything is exchanged, so the size of a group
does not matter. Regressions are then solved from the matrices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "gram") -> DataFrame:
    """(keys, n, gram): the flattened matrix X'X of the columns per group. Rows must hold no NULLs."""
    keys, cols = list(keys), list(cols)
    d = len(cols)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = pdf[cols].to_numpy(dtype=float)
            if keys:
                codes = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            else:
                codes = np.zeros(len(pdf), int)
            order = np.argsort(codes, kind="stable")
            starts = np.r_[0, np.flatnonzero(np.diff(codes[order])) + 1]
            rows = []
            for s, e in zip(starts, np.r_[starts[1:], len(order)]):
                part = x[order[s:e]]
                rows.append((order[s], e - s, (part.T @ part).ravel()))
            out = pdf[keys].iloc[[r[0] for r in rows]].reset_index(drop=True) if keys else pd.DataFrame(index=range(len(rows)))
            out["n"] = [r[1] for r in rows]
            out[name] = [r[2] for r in rows]
            yield out

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema] if keys else []
    parts = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(
        partial, ", ".join([*types, "n long", f"`{name}` array<double>"])
    )
    # d * d sums per group with partial aggregation; the matrix is put together again from its d * d entries.
    cells = parts.select(*keys, "n", F.posexplode(name).alias("_i", "_v")).groupBy(*keys, "_i").agg(
        F.sum("_v").alias("_v"), F.sum("n").alias("n")
    )
    packed = cells.groupBy(*keys).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_c"))
    del d
    return packed.select(*keys, "n", F.transform("_c", lambda c: c["_v"]).alias(name))


def solve(g: np.ndarray, target: int, on: Sequence[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, residual sum of squares, inverse of X'X) of the target column regressed on others."""
    on = list(on)
    xx, xy, yy = g[np.ix_(on, on)], g[on, target], g[target, target]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    unit = xx / np.outer(scale, scale)
    inv = np.linalg.pinv(unit, rcond=1e-13, hermitian=True)
    beta = inv @ (xy / scale) / scale
    rss = float(max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0))
    return beta, rss, inv / np.outer(scale, scale)
