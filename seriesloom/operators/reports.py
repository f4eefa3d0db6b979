"""Reports over the results of many runs: overview, settings audit, drill-down, graphs, insights, forecast contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonflat import flattened_columns
from ..session import durable, held
from .explain import attribution_summary, correlations, lag_correlations, what_if
from .metrics import conformal_interval, interval_summary, point_summary, residual_summary
from .stats import ljung_box

# Where a setting is expected and where the run reports it, in order of preference.
REFLECTION = {
    "horizon": (("cfg_horizon", "meta_horizon", "horizon"), ("params.h", "params.horizon", "params.auto_h")),
    "model_name": (("cfg_model_name", "meta_model_name", "model_name"), ("params.model_name", "params.auto_cls_model", "params.alias")),
    "auto_num_samples": (("cfg_auto_num_samples", "meta_auto_num_samples"), ("params.num_samples", "params.auto_num_samples")),
    "auto_backend": (("cfg_auto_backend", "meta_auto_backend"), ("params.backend", "params.auto_backend")),
    "auto_loss": (("cfg_auto_loss", "meta_auto_loss"), ("params.loss_name", "params.auto_loss")),
    "auto_valid_loss": (("cfg_auto_valid_loss", "meta_auto_valid_loss"), ("params.valid_loss_name", "params.auto_valid_loss")),
    "auto_search_alg": (("cfg_auto_search_alg", "meta_auto_search_alg"), ("params.search_alg_name", "params.auto_search_alg")),
    "auto_cpus": (("cfg_auto_cpus", "meta_auto_cpus"), ("params.cpus", "params.auto_cpus")),
    "auto_gpus": (("cfg_auto_gpus", "meta_auto_gpus"), ("params.gpus", "params.auto_gpus")),
    "auto_refit_with_val": (("cfg_auto_refit_with_val", "meta_auto_refit_with_val"), ("params.refit_with_val", "params.auto_refit_with_val")),
    "auto_verbose": (("cfg_auto_verbose", "meta_auto_verbose"), ("params.verbose", "params.auto_verbose")),
}
JSON_PREFIXES = {
    "params_json": "params",
    "metrics_json": "metrics",
    "diagnostics_json": "diagnostics",
    "explain_json": "explain",
    "exog_json": "exog",
    "model_save_json": "save",
    "model_load_json": "load",
    "model_analyze_json": "analyze",
}


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def flatten_results(results: DataFrame) -> DataFrame:
    """Run results with their JSON columns as dotted text columns and the duration in seconds.

    The names found in the JSON become columns; their number is bounded by what the runs log.
    """
    out = results
    if "started_at" in out.columns and "ended_at" in out.columns:
        secs = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1e6)
        out = out.withColumn("duration_sec", secs)
    return flattened_columns(out, {c: p for c, p in JSON_PREFIXES.items() if c in results.columns}, "report", None)


def overview(results: DataFrame) -> DataFrame:
    """Rows, columns, distinct configurations, runs and models, and the creation span, in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(results.columns)).alias("columns")]
    for name, column in (("config_count", "config_id"), ("run_count", "run_id"), ("model_count", "model_name")):
        aggs.append((F.count_distinct(column) if column in results.columns else F.lit(0).cast("long")).alias(name))
    if "created_at" in results.columns:
        aggs += [F.min("created_at").alias("created_at_min"), F.max("created_at").alias("created_at_max")]
    return results.agg(*aggs)


def status_table(results: DataFrame) -> DataFrame:
    return results.groupBy(F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def target_metric(columns: Sequence[str], wanted: str | None) -> str | None:
    """Resolve a metric name against the flattened columns."""
    raw = (wanted or "").strip()
    options = [raw, f"metrics.{raw}", "metrics.mae", "metrics.rmse", "metrics.smape", "metrics.mape"]
    found = next((c for c in options if c and c in columns), None)
    return found or next(iter(sorted(c for c in columns if c.startswith("metrics."))), None)


# --- settings audit --------------------------------------------------------------------------------------------------------


def normal_text(c: Column) -> Column:
    """Trimmed text, NULL when empty; true and false in lower case."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.when(F.lower(text).isin("true", "false"), F.lower(text)).otherwise(text)


def values_match(expected: Column, actual: Column, atol: float = 1e-9, rtol: float = 1e-6) -> Column:
    """Equal as numbers within tolerance, as truth values when either side is one, else as text."""
    e, a = normal_text(expected), normal_text(actual)
    en, an = e.try_cast("double"), a.try_cast("double")
    is_bool = e.isin("true", "false") | a.isin("true", "false")

    def truth(text: Column, number: Column) -> Column:
        return F.when(text == "true", True).when(text == "false", False).otherwise(F.coalesce(number != 0, F.lit(True)))

    close = F.abs(en - an) <= F.greatest(F.lit(atol), rtol * F.greatest(F.abs(en), F.abs(an), F.lit(1.0)))
    same = F.when(is_bool, truth(e, en) == truth(a, an)).when(en.isNotNull() & an.isNotNull(), close).otherwise(e == a)
    return F.when(e.isNull() | a.isNull(), F.lit(False)).otherwise(same)


def first_known(columns: Sequence[str], present: Sequence[str]) -> Column:
    """The first candidate that holds a value, with its column name."""
    options = []
    for c in columns:
        if c in present:
            v = normal_text(quoted(c))
            options.append(F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(c).alias("source"))))
    empty = F.lit(None).cast("struct<value:string,source:string>")
    return F.coalesce(*options, empty) if options else empty


def reflection_rows(results: DataFrame, ids: Sequence[str] = ("run_id", "config_id"), spec: Mapping = REFLECTION) -> DataFrame:
    """One row per run and setting that is expected: what was asked, what the run reports, and the verdict."""
    cols = results.columns
    pairs = [
        F.struct(F.lit(p).alias("parameter"), first_known(want, cols).alias("e"), first_known(have, cols).alias("a"))
        for p, (want, have) in spec.items()
    ]
    keep = [c for c in ids if c in cols]
    rows = results.select(*keep, F.explode(F.array(*pairs)).alias("_p")).where(F.col("_p.e").isNotNull())
    e, a = F.col("_p.e"), F.col("_p.a")
    status = F.when(a.isNull(), "missing_actual").when(values_match(e["value"], a["value"]), "match").otherwise("mismatch")
    return rows.select(
        *keep, F.col("_p.parameter").alias("parameter"), e["source"].alias("expected_col"), e["value"].alias("expected"),
        a["source"].alias("actual_col"), a["value"].alias("actual"), status.alias("status"),
    )


def reflection_summary(rows: DataFrame) -> DataFrame:
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    out = rows.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("compared_rows"), n("match").alias("matched_rows"), n("mismatch").alias("mismatched_rows"), n("missing_actual").alias("missing_actual_rows")
    )
    return out.withColumns(
        {
            "match_rate": F.col("matched_rows") / F.col("compared_rows"),
            "mismatch_rate": (F.col("mismatched_rows") + F.col("missing_actual_rows")) / F.col("compared_rows"),
        }
    )


# --- drill-down ------------------------------------------------------------------------------------------------------------


def drilldown(results: DataFrame, target: str, ranked: Sequence[str], max_depth: int = 3, least: int = 5, children: int | None = None) -> DataFrame:
    """Tree of groups: every node splits by the first ranked parameter with at least two large enough values.

    The results are read once: rows of equal parameters collapse to cells of counts, sums and squares. Level by level the cells
    carry the path of their node, one aggregate describes all nodes of a level and one more counts all candidate splits, so the
    number of jobs depends on the depth and never on the number of nodes. ``children`` keeps only the largest branches of a node.
    """
    places = [f"_p{i}" for i in range(len(ranked))]
    rows = results.select(*[quoted(p).cast("string").alias(c) for c, p in zip(places, ranked)], quoted(target).try_cast("double").alias("_y"))
    n, mean = F.count("_y"), F.avg("_y")
    rows = held(rows.groupBy(*places).agg(F.count(F.lit(1)).alias("_all"), n.alias("_n"), F.sum("_y").alias("_s"), mean.alias("_m"), (F.var_pop("_y") * n).alias("_m2")))
    # squares are pooled around one value near all means, which keeps the difference below well conditioned
    middle = rows.agg(F.avg(F.when(F.abs("_m") < float("inf"), F.col("_m")))).first()[0] or 0.0
    rows = rows.withColumn("node", F.lit("root"))
    off = F.col("_m") - F.lit(middle)
    found = None
    for depth in range(max_depth + 1):
        known = F.sum("_n")
        squares = F.sum("_m2") + F.sum(F.col("_n") * off * off) - known * F.pow(F.sum(F.col("_n") * off) / known, F.lit(2))
        level = rows.groupBy("node").agg(
            F.lit(depth).alias("depth"), F.sum("_all").alias("rows"), F.when(known > 0, F.sum("_s") / known).alias("target_mean"),
            F.coalesce(F.when(known > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (known - 1))), F.lit(0.0)).alias("target_std"),
        )
        if depth == max_depth or not ranked:
            found = level.withColumn("split_parameter", F.lit(None).cast("string")) if found is None else found.unionByName(level.withColumn("split_parameter", F.lit(None).cast("string")))
            break
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_p{i}").alias("v")) for i in range(len(ranked))])
        counts = (
            rows.where(F.col("_n") > 0)
            .select("node", "_n", F.explode(pairs).alias("_q"))
            .where(F.col("_q.v").isNotNull())
            .groupBy("node", "_q.i", "_q.v")
            .agg(F.sum("_n").alias("c"))
            .where(F.col("c") >= least)
        )
        usable = level.where(F.col("rows") >= 2 * least).select("node")
        splits = counts.groupBy("node", "i").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").groupBy("node").agg(F.min("i").alias("i"))
        splits = splits.join(usable, "node", "left_semi")
        names = F.array(*[F.lit(p) for p in ranked])
        described = level.join(splits, "node", "left").withColumn("split_parameter", F.get(names, F.col("i"))).drop("i")
        found = described if found is None else found.unionByName(described)
        chosen = counts.join(splits, ["node", "i"])
        if children is not None:
            w = Window.partitionBy("node").orderBy(F.col("c").desc(), "v")
            chosen = chosen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= children)
        # the next level's nodes stay a table; the optimizer broadcasts it while it is small
        table = durable(chosen.select("node", F.col("i").alias("_i"), F.col("v").alias("_v")))
        if table.isEmpty():
            break
        value = F.get(F.array(*[F.col(f"_p{i}") for i in range(len(ranked))]), F.col("_i"))
        label = F.concat("node", F.lit("/"), F.get(names, F.col("_i")), F.lit("="), F.col("_v"))
        rows = rows.join(table, "node").where(value == F.col("_v")).withColumn("node", label).drop("_i", "_v")
    return found


# --- graphs and insights ---------------------------------------------------------------------------------------------------


def impact_graph(impact: DataFrame) -> DataFrame:
    """Centralities of the star around the target: every parameter is one spoke."""
    n = max(1, impact.count())
    effect = F.coalesce(F.col("effect_abs").try_cast("double"), F.lit(0.0))
    boost = F.when(F.coalesce(F.col("is_significant"), F.lit(False)), 1.2).otherwise(1.0)
    return impact.select(
        F.col("parameter").cast("string").alias("node"), effect.alias("weighted_degree"), F.lit(1.0 / n).alias("degree_centrality"), (effect * boost).alias("bridge_score")
    )


def relation_graph(model_name: str, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, centrality) of the star that ties a model to its metrics, features and resources.

    ``scores`` has columns kind, name, weight. In a star the hub lies on every path between two spokes.
    """
    hub = f"model:{model_name}"
    node = F.concat_ws(":", "kind", "name")
    edges = scores.select(F.lit(hub).alias("source"), node.alias("target"), F.abs("weight").alias("weight"), "kind")
    n = scores.count()
    spokes = edges.select(F.col("target").alias("node"), F.lit(1.0 / max(n, 1)).alias("degree_centrality"), F.lit(0.0).alias("betweenness"))
    center = scores.sparkSession.createDataFrame([(hub, 1.0 if n else 0.0, 1.0 if n > 1 else 0.0)], spokes.schema)
    return edges, center.unionByName(spokes)


def key_insights(results: DataFrame, target: str, impact: DataFrame | None = None, reflection: DataFrame | None = None, higher_is_better: bool = False) -> DataFrame:
    """The few facts a reader wants first, as (rank, insight, subject, value) rows."""
    y = quoted(target).try_cast("double")
    pick = F.max_by if higher_is_better else F.min_by
    best = (F.max if higher_is_better else F.min)(y)
    head = results.agg(
        F.avg((F.col("status") == "failed").cast("double")).alias("failed"), pick(F.col("run_id").cast("string"), F.when(y.isNotNull(), F.struct(y, F.col("run_id")))).alias("run"), best.alias("y")
    )
    rows = [
        head.select(F.lit(1).alias("rank"), F.lit("failure_rate").alias("insight"), F.lit("status").alias("subject"), F.col("failed").alias("value")),
        head.select(F.lit(2).alias("rank"), F.lit("best_run").alias("insight"), F.col("run").alias("subject"), F.col("y").alias("value")),
    ]
    if impact is not None:
        top = impact.orderBy(F.col("is_significant").desc(), F.col("effect_abs").desc(), "parameter").limit(1)
        rows.append(top.select(F.lit(3).alias("rank"), F.lit("top_parameter").alias("insight"), F.col("parameter").alias("subject"), F.col("effect_abs").alias("value")))
    if reflection is not None:
        worst = reflection.orderBy(F.col("mismatch_rate").desc(), F.col("compared_rows").desc(), "parameter").limit(1)
        rows.append(worst.select(F.lit(4).alias("rank"), F.lit("worst_reflection").alias("insight"), F.col("parameter").alias("subject"), F.col("mismatch_rate").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where(F.col("subject").isNotNull())


def forecast_contract(rows: DataFrame, y: str, p: str, features: Sequence[str], keys: Sequence[str], order: Sequence[str], coverage: float = 0.9, top_k: int | None = None, lags: int = 10, *, points: int) -> DataFrame:
    """Everything about one set of forecasts in a single record: points, interval, attribution, what-if, residuals."""
    full = [*keys, *[c for c in order if c not in keys]]
    known = rows.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    point = point_summary(known, p, order=full, first=points)
    interval = interval_summary(conformal_interval(known, y, p, coverage), y)
    residual = residual_summary(known, y, p)
    lb = ljung_box(known.withColumn("_res", F.col(y) - F.col(p)), [], full, "_res", lags, least=max(12, lags + 2), clip=False)
    top = attribution_summary(correlations(known, features, y), lag_correlations(known, features, keys, order, y), top_k=top_k)
    moves = what_if(known, features, p)
    one = F.lit(1).alias("_one")

    def packed(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.struct(*frame.columns).alias(name), one)

    def listed(frame: DataFrame, name: str) -> DataFrame:
        return frame.agg(F.sort_array(F.collect_list(F.struct(*frame.columns))).alias(name)).withColumn("_one", F.lit(1))

    out = packed(point, "point_forecast").join(packed(interval, "prediction_interval"), "_one").join(packed(residual, "residual_diagnostics"), "_one")
    out = out.join(packed(lb, "ljung_box"), "_one").join(listed(top, "attribution"), "_one").join(listed(moves, "what_if"), "_one")
    return out.drop("_one")
