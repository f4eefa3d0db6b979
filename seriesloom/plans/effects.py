"""Least squares with categories of any number of values: their dummies are projected out by group sums.

A regression on numeric columns and on categories leaves the same coefficients and residuals as a regression of what the
categories don't explain of each column (the theorem of Frisch, Waugh and Lovell). No dummy column is ever made:

* without a category, columns are centred;
* one category is projected out by its group means;
* of several, rows first collapse to distinct combinations of values (cells). The normal equations of all values, ``D'D g = D'x`` for
  every column x at once, are solved from the cells: densely for at most ``DENSE`` values, else by preconditioned conjugate
  gradients, whose products are two joins and two group sums of tables, whatever the number of values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .grams import gram
from .series import attach

#: Values of several categories whose normal equations are one small matrix, 8 MB at most.
DENSE = 1000
#: Rounds of conjugate gradients at most, and the share of the first residual at which they end.
ROUNDS, TOLERANCE = 1000, 1e-11
#: Random signs per row from which leverages are estimated where the normal equations are not dense: a relative error of 10 %.
PROBES, PROBES_AT_ONCE = 200, 20


def level(column: str) -> Column:
    """A category's value as text; NULL is a value."""
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


@dataclass(frozen=True)
class Absorbed:
    """Cross products of columns after the categories (and the intercept) are projected out."""

    n: int
    gram: np.ndarray
    #: Dummy columns a design matrix would have, next to the intercept.
    dummies: int


class Effects:
    """Rows whose categories can be projected out of the given numeric columns (without NULLs)."""

    def __init__(self, df: DataFrame, categories: Sequence[str], cols: Sequence[str]):
        self.cols, self.categories = list(cols), list(categories)
        first = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in self.cols]).first()
        self.n, self.means = int(first[0]), [float(m or 0.0) for m in first[1:]]
        centred = [(F.col(c).cast("double") - F.lit(m)).alias(c) for c, m in zip(self.cols, self.means)]
        self.rows = df.select(*[level(c).alias(f"_g{i}") for i, c in enumerate(self.categories)], *centred, *[c for c in df.columns if c not in {*self.cols}])
        raw = gram(self.rows, [], self.cols).first()
        self.raw = np.array(raw["gram"], float).reshape(len(self.cols), -1) if raw else np.zeros((len(self.cols),) * 2)
        self._cells: dict[tuple, Cells] = {}
        self._absorbed: dict[tuple, Absorbed] = {}

    def _of(self, chosen: Sequence[str]) -> list[str]:
        return [f"_g{self.categories.index(c)}" for c in chosen]

    def cells(self, chosen: Sequence[str]) -> Cells:
        key = tuple(chosen)
        if key not in self._cells:
            self._cells[key] = Cells(self.rows, self._of(chosen), self.cols)
        return self._cells[key]

    def absorbed(self, chosen: Sequence[str]) -> Absorbed:
        key = tuple(chosen)
        if key not in self._absorbed:
            self._absorbed[key] = self._project(chosen)
        return self._absorbed[key]

    def _project(self, chosen: Sequence[str]) -> Absorbed:
        if not chosen:
            return Absorbed(self.n, self.raw, 0)
        if len(chosen) == 1:
            sums = self.rows.groupBy(*self._of(chosen)).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in self.cols])
            between = gram(sums.select(*[(F.col(c) / F.sqrt("_n")).alias(c) for c in self.cols]), [], self.cols).first()  # its n counts values
            return Absorbed(self.n, self.raw - np.array(between["gram"], float).reshape(self.raw.shape), int(between["n"]) - 1)
        cells = self.cells(chosen)
        fit = cells.products()
        return Absorbed(self.n, self.raw - (fit + fit.T) / 2, cells.levels - len(chosen))

    def residuals(self, chosen: Sequence[str], leverage: str = "_h") -> DataFrame:
        """The rows with what the categories leave of each column, and each row's leverage from the categories and the intercept."""
        if not chosen:
            return self.rows.withColumn(leverage, F.lit(1.0 / max(self.n, 1)))
        names = self._of(chosen)
        if len(chosen) == 1:
            means = self.rows.groupBy(*names).agg((1.0 / F.count(F.lit(1))).alias(leverage), *[F.avg(c).alias(f"_m_{c}") for c in self.cols])
            means = durable(means)
            joined = attach(self.rows, means, names, means.count())
            return joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in self.cols}).drop(*[f"_m_{c}" for c in self.cols])
        cells = self.cells(chosen)
        fitted = attach(self.rows, durable(cells.fitted(leverage)), names, cells.cells.count())
        return fitted.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in self.cols}).drop(*[f"_m_{c}" for c in self.cols])


class Cells:
    """Distinct combinations of the values of several categories, with the sums of their rows."""

    def __init__(self, rows: DataFrame, names: list[str], cols: list[str]):
        self.names, self.cols = names, cols
        sums = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s{j}") for j, c in enumerate(cols)])
        self.cells = durable(sums.withColumn("_cell", F.monotonically_increasing_id()))
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(n).alias("_l")) for i, n in enumerate(names)])).alias("_p")
        self.long = durable(self.cells.select("_cell", "_n", *[f"_s{j}" for j in range(len(cols))], pairs).select("*", "_p.*").drop("_p"))
        self.levels = self.long.select("_c", "_l").distinct().count()
        self.dense = self.levels <= DENSE
        self._solved: DataFrame | None = None

    def _right(self, sides: Sequence[str]) -> DataFrame:
        """(_c, _l, _d, one column a side): rows of each value, and the sides' sums over them."""
        return self.long.groupBy("_c", "_l").agg(F.sum("_n").alias("_d"), *[F.sum(s).alias(s) for s in sides])

    def solved(self) -> DataFrame:
        """(_c, _l, _s<j>, _x<j>): right sides and solutions of all columns."""
        if self._solved is None:
            sides = [f"_s{j}" for j in range(len(self.cols))]
            self._solved = durable(self._dense(sides)[0] if self.dense else conjugate_gradients(self.long, self._right(sides), sides))
        return self._solved

    def _dense(self, sides: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
        numbered = durable(self._right(sides).withColumn("_id", F.row_number().over(Window.orderBy("_c", "_l")) - 1))  # at most DENSE rows
        placed = self.long.select("_cell", "_n", "_c", "_l").join(numbered.select("_c", "_l", "_id"), ["_c", "_l"])
        met = placed.select("_cell", "_n", F.col("_id").alias("_a")).join(placed.select("_cell", F.col("_id").alias("_b")), "_cell")
        matrix = np.zeros((self.levels, self.levels))
        for r in met.groupBy("_a", "_b").agg(F.sum("_n").alias("v")).collect():  # at most DENSE * DENSE numbers
            matrix[r["_a"], r["_b"]] = r["v"]
        inverse = np.linalg.pinv(matrix, rcond=1e-12, hermitian=True)
        right = np.zeros((self.levels, len(sides)))
        for r in numbered.collect():
            right[r["_id"]] = [r[s] for s in sides]
        found = inverse @ right
        out = [(i, *map(float, row)) for i, row in enumerate(found)]
        x = self.long.sparkSession.createDataFrame(out, ", ".join(["_id int", *[f"_x{j} double" for j in range(len(sides))]]))
        return numbered.join(x, "_id"), inverse

    def products(self) -> np.ndarray:
        """What the categories explain of the columns' cross products."""
        d = len(self.cols)
        row = self.solved().agg(*[F.sum(F.col(f"_s{i}") * F.col(f"_x{j}")).alias(f"v{i}_{j}") for i in range(d) for j in range(d)]).first()
        return np.array([[row[f"v{i}_{j}"] for j in range(d)] for i in range(d)], float)

    def fitted(self, leverage: str) -> DataFrame:
        """Per cell the fitted value of each column (``_m_<column>``) and the leverage of a row there."""
        x = [f"_x{j}" for j in range(len(self.cols))]
        sums = self.long.select("_cell", "_c", "_l").join(self.solved().select("_c", "_l", *x), ["_c", "_l"]).groupBy("_cell").agg(*[F.sum(c).alias(f"_m_{n}") for c, n in zip(x, self.cols)])
        return self.cells.select("_cell", *self.names).join(sums, "_cell").join(self._leverages(leverage), "_cell").drop("_cell")

    def _leverages(self, name: str) -> DataFrame:
        if self.dense:
            numbered, inverse = self._dense(["_n"])
            ids = self.long.select("_cell", "_c", "_l").join(numbered.select("_c", "_l", "_id"), ["_c", "_l"]).groupBy("_cell").agg(F.collect_list("_id").alias("_ids"))

            def look(batches):
                for pdf in batches:
                    yield pdf.assign(**{name: [float(inverse[np.ix_(i, i)].sum()) for i in (np.asarray(v) for v in pdf["_ids"])]})[["_cell", name]]

            return ids.mapInPandas(look, f"_cell long, `{name}` double")
        # the squared fit of random signs is the leverage, on average
        totals = []
        for first in range(0, PROBES, PROBES_AT_ONCE):
            sides = [f"_r{b}" for b in range(first, min(first + PROBES_AT_ONCE, PROBES))]

            def signs(batches, sides=sides, first=first):
                for pdf in batches:
                    for at, (cell, n) in enumerate(zip(pdf["_cell"], pdf["_n"])):
                        draw = np.random.default_rng((first, int(cell))).binomial(int(n), 0.5, len(sides))
                        pdf.loc[pdf.index[at], sides] = 2.0 * draw - n
                    yield pdf

            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.cells.select("_cell", "_n").schema)
            drawn = durable(self.cells.select("_cell", "_n").mapInPandas(signs, ", ".join([kinds, *[f"{s} double" for s in sides]])))
            long = self.long.select("_cell", "_c", "_l").join(drawn, "_cell")
            right = long.groupBy("_c", "_l").agg(F.sum("_n").alias("_d"), *[F.sum(s).alias(s) for s in sides])
            x = conjugate_gradients(self.long, right, sides)
            fit = self.long.select("_cell", "_c", "_l").join(x, ["_c", "_l"]).groupBy("_cell").agg(*[F.sum(f"_x{j}").alias(f"_f{j}") for j in range(len(sides))])
            totals.append(fit.select("_cell", reduce(lambda a, b: a + b, [F.col(f"_f{j}") * F.col(f"_f{j}") for j in range(len(sides))]).alias("_q")))
        every = reduce(DataFrame.unionByName, totals)
        return every.groupBy("_cell").agg(F.least(F.sum("_q") / PROBES, F.lit(1.0)).alias(name))


def conjugate_gradients(long: DataFrame, right: DataFrame, sides: Sequence[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(_c, _l, sides, _x<j>): solutions g of ``D'D g = side`` for all sides at once.

    ``long`` has a row per cell and category (_cell, _n, _c, _l), ``right`` one per value: its rows ``_d`` and the sides. The state is a
    table with one row a value; a round writes it once, and only sums of it come to the driver.
    """
    k = range(len(sides))
    places = long.select("_cell", "_n", "_c", "_l")
    state = durable(right.select("_c", "_l", "_d", *sides, *[F.lit(0.0).alias(f"_x{j}") for j in k], *[F.col(s).cast("double").alias(f"_r{j}_") for j, s in enumerate(sides)], *[(F.col(s) / F.col("_d")).alias(f"_p{j}") for j, s in enumerate(sides)]))
    rz = np.array(state.agg(*[F.sum(F.col(f"_r{j}_") * F.col(f"_r{j}_") / F.col("_d")) for j in k]).first(), float)
    start = np.maximum(rz, 1e-300)
    for _ in range(rounds):
        if (rz <= tolerance**2 * start).all():
            break
        total = places.join(state.select("_c", "_l", *[f"_p{j}" for j in k]), ["_c", "_l"]).groupBy("_cell").agg(*[F.sum(f"_p{j}").alias(f"_t{j}") for j in k])
        product = places.join(total, "_cell").groupBy("_c", "_l").agg(*[F.sum(F.col("_n") * F.col(f"_t{j}")).alias(f"_q{j}") for j in k])
        state = durable(state.join(product, ["_c", "_l"]))
        bend = np.array(state.agg(*[F.sum(F.col(f"_p{j}") * F.col(f"_q{j}")) for j in k]).first(), float)
        go = (rz > tolerance**2 * start) & (bend > 0)
        step = np.where(go, rz / np.where(go, bend, 1.0), 0.0)
        rest = [F.col(f"_r{j}_") - F.lit(float(step[j])) * F.col(f"_q{j}") for j in k]
        new = np.array(state.agg(*[F.sum(r * r / F.col("_d")) for r in rest]).first(), float)
        turn = np.where(go, new / np.where(rz > 0, rz, 1.0), 0.0)
        rz = np.where(go, new, 0.0)
        state = state.select(
            "_c", "_l", "_d", *sides,
            *[(F.col(f"_x{j}") + F.lit(float(step[j])) * F.col(f"_p{j}")).alias(f"_x{j}") for j in k],
            *[r.alias(f"_r{j}_") for j, r in zip(k, rest)],
            *[(rest[j] / F.col("_d") + F.lit(float(turn[j])) * F.col(f"_p{j}")).alias(f"_p{j}") for j in k],
        )
    return state.select("_c", "_l", "_d", *sides, *[f"_x{j}" for j in k])
