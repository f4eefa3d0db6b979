"""Distribution shift between a reference and a current sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import p_value
from ..plans.quantiles import group_quantiles
from ..plans.ranks import value_table
from .windows import latest_per

EPS = 1e-8
LEAST = 20


def _sides(reference: DataFrame, current: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    both = reference.select(*by, F.col(value).alias("_v"), F.lit(0).alias("_side")).unionByName(
        current.select(*by, F.col(value).alias("_v"), F.lit(1).alias("_side"))
    )
    v = F.col("_v")
    # A constant key stands for "no grouping", so both cases share one plan shape.
    out = both.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return out.withColumn("_all", F.lit(1)) if not by else out


def drift(reference: DataFrame, current: DataFrame, value: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Counts, means, mean shift, population stability index and two-sample KS per group.

    PSI uses the reference's quantile edges (duplicates removed, last bin closed, values outside dropped). PSI and KS need
    20 values on each side. The KS p-value is the asymptotic one.
    """
    by = list(by)
    rows = _sides(reference, current, value, by)
    keys = by or ["_all"]
    ref, cur = F.col("_side") == 0, F.col("_side") == 1
    level = rows.groupBy(*keys).agg(
        F.count_if(ref).alias("reference_n"),
        F.count_if(cur).alias("current_n"),
        F.avg(F.when(ref, F.col("_v"))).alias("reference_mean"),
        F.avg(F.when(cur, F.col("_v"))).alias("current_mean"),
    )
    b = max(4, min(50, int(bins)))
    names = [f"_e{i}" for i in range(b + 1)]
    edges = group_quantiles(rows.where(ref), keys, {n: ("_v", i / b) for i, n in enumerate(names)})
    edges = edges.select(*keys, F.sort_array(F.array_distinct(F.array(*names))).alias("_edges"))

    # Counting equal values first makes the joined side as small as the number of distinct values.
    table = value_table(rows, keys, "_v", {"_nr": ref, "_nc": cur})
    placed = table.join(edges, keys, "left")
    v, e = F.col("_v"), F.col("_edges")
    inside = (v >= F.element_at(e, 1)) & (v <= F.element_at(e, -1))
    slot = F.least(F.size(F.filter(e, lambda x: x <= v)), F.size(e) - 1)
    binned = placed.where(inside).groupBy(*keys, slot.alias("_bin")).agg(F.sum("_nr").alias("r"), F.sum("_nc").alias("c"), F.max(F.size(e)).alias("_k"))
    g = Window.partitionBy(*keys)
    shares = binned.withColumns(
        {
            "pr": F.greatest(F.col("r") / F.greatest(F.sum("r").over(g), F.lit(1)), F.lit(EPS)),
            "pc": F.greatest(F.col("c") / F.greatest(F.sum("c").over(g), F.lit(1)), F.lit(EPS)),
        }
    )
    total = F.sum((F.col("pc") - F.col("pr")) * F.log(F.col("pc") / F.col("pr")))
    # Bins that neither side fills never show up in the table; both shares are EPS there and add nothing.
    psi = shares.groupBy(*keys).agg(F.when(F.max("_k") >= 3, total).alias("psi"))

    fr = (F.col("_nr_before") + F.col("_nr"))
    fc = (F.col("_nc_before") + F.col("_nc"))
    gaps = table.join(level.select(*keys, "reference_n", "current_n"), keys)
    ks = gaps.groupBy(*keys).agg(
        F.max(F.abs(F.try_divide(fr, F.col("reference_n")) - F.try_divide(fc, F.col("current_n")))).alias("ks_stat")
    )
    out = level.join(psi, keys, "left").join(ks, keys, "left")
    enough = (F.col("reference_n") >= LEAST) & (F.col("current_n") >= LEAST)
    n, m = F.col("reference_n"), F.col("current_n")
    out = out.withColumns(
        {
            "ok": (n > 0) & (m > 0),
            "mean_shift": F.col("current_mean") - F.col("reference_mean"),
            "psi": F.when(enough, F.col("psi")),
            "ks_stat": F.when(enough, F.col("ks_stat")),
        }
    )
    scaled = F.col("ks_stat") * F.sqrt(n * m / (n + m))
    out = out.withColumn("ks_pvalue", p_value("kolmogorov", scaled))
    return out.drop("_all") if not by else out


def latest_two(evaluations: DataFrame, dataset: str, created: str, eval_id: str) -> DataFrame:
    """The newest and the one before of every dataset's evaluations, as ``_age`` 1 and 2."""
    w = Window.partitionBy(dataset).orderBy(F.col(created).desc(), F.col(eval_id).desc())
    heads = evaluations.select(dataset, created, eval_id).distinct()
    return heads.withColumn("_age", F.row_number().over(w)).where("_age <= 2")


def latest_evaluation(evaluations: DataFrame, dataset: str = "dataset_id", created: str = "created_at", eval_id: str = "eval_id") -> DataFrame:
    return latest_per(evaluations, [dataset], [created, eval_id])


def evaluation_drift(rows: DataFrame, dataset: str = "dataset_id", created: str = "created_at", eval_id: str = "eval_id", values: Sequence[str] = ("y_true", "y_pred", "residual")) -> DataFrame:
    """Drift of each value between a dataset's latest evaluation and the one before it."""
    ages = latest_two(rows, dataset, created, eval_id)
    aged = rows.join(ages.select(dataset, eval_id, "_age"), [dataset, eval_id])
    pairs = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])
    long = aged.select(dataset, "_age", F.explode(pairs).alias("_p")).select(dataset, "_age", "_p.*")
    return drift(long.where("_age = 2"), long.where("_age = 1"), "value", [dataset, "measure"])
