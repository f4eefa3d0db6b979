"""Parameter grids: expansion, validation, signatures, seeded rounds, and the grid run over every series."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.histories import History, histories
from ..plans.series import BROADCAST_ROWS, attach, measure
from ..session import durable
from ..spec import SeriesSpec
from .forecast import get_model, recent_values
from .metrics import metric_columns
from .prep import is_blank, is_success

# The codes of the checks. Each is given with the parameters that decide it.
REASONS = {
    "missing_unique_id": ("group_mode", "unique_id"),
    "backend_search_mismatch": ("backend", "search_alg"),
    "model_backend_requirement": ("model", "backend"),
    "missing_dataset_table": ("dataset_input_method", "dataset_table"),
    "missing_dataset_sql": ("dataset_input_method", "dataset_sql"),
    "missing_dataset_path": ("dataset_input_method", "dataset_path"),
    "fit_val_size_too_small": ("horizon", "fit_val_size"),
    "duplicate_combination": (),
}
SEARCH_BY_BACKEND = {
    "optuna": ("RandomSampler", "TPESampler", "CmaEsSampler", "NSGAIISampler"),
    "ray": ("BasicVariantGenerator", "OptunaSearch", "HyperOptSearch", "BayesOptSearch"),
}
NEEDS_ID = ("loto_unique_id_ts_type",)
RAY_ONLY_MODELS = ("AutoHINT",)
NO_VALUE = ("", "none", "null", "(none)")
#: Decay rates summed in one pass over the histories, and tasks answered together (on average).
RATES, BUCKET = 128, 64


def normalize_space(space: Mapping) -> dict[str, list]:
    """Scalars become one-value lists; repeated values are dropped."""
    out = {}
    for k, v in space.items():
        values = v if isinstance(v, list) else [v]
        seen: dict[str, object] = {}
        for x in values:
            seen.setdefault(json.dumps(x, sort_keys=True, default=str), x)
        out[str(k)] = list(seen.values())
    return out


def apply_modes(fixed: Mapping | None, space: Mapping | None, modes: Mapping | None) -> tuple[dict, dict[str, list]]:
    """Move parameters between the fixed set and the grid, or drop them, as their mode says."""
    fixed, space = dict(fixed or {}), normalize_space(space or {})
    for name, raw in (modes or {}).items():
        rule = {"mode": raw} if isinstance(raw, str) else {"mode": "vary" if raw else "fixed"} if isinstance(raw, bool) else dict(raw)
        mode = str(rule.get("mode") or ("vary" if rule.get("variable") else "fixed")).strip().lower()
        if not rule.get("enabled", True):
            fixed.pop(name, None)
            space.pop(name, None)
        elif mode in ("vary", "variable", "grid", "search"):
            values = rule.get("values") or ([rule["value"]] if "value" in rule else space.get(name) or ([fixed[name]] if name in fixed else []))
            fixed.pop(name, None)
            if values:
                space[name] = normalize_space({name: list(values)})[name]
        else:
            known = space.pop(name, None)
            if "value" in rule:
                fixed[name] = rule["value"]
            elif name not in fixed and known:
                fixed[name] = known[0]
    return fixed, space


def expand_grid(spark: SparkSession, space: Mapping, max_tasks: int | None = None, fixed: Mapping | None = None) -> DataFrame:
    """(task_order, params JSON) rows of the full product, keys in sorted order, the last key changing fastest.

    The product is never formed in memory: a task's number, read in mixed radix, names its values.
    """
    space = normalize_space(space)
    keys = sorted(space)
    total = 1
    for k in keys:
        total *= len(space[k])
    n = total if max_tasks is None else min(total, int(max_tasks))
    tasks = spark.range(n).withColumnRenamed("id", "task_order")
    values, stride = {}, total
    for k in keys:
        stride //= len(space[k])
        at = F.floor(F.col("task_order") / F.lit(stride)) % len(space[k])
        values[k] = F.element_at(F.array(*[F.lit(json.dumps(v, sort_keys=True)) for v in space[k]]), (at + 1).cast("int"))
    for k, v in (fixed or {}).items():
        values.setdefault(k, F.lit(json.dumps(v, sort_keys=True)))
    body = [F.concat(F.lit(json.dumps(k) + ": "), values[k]) for k in sorted(values)]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *body), F.lit("}")) if body else F.lit("{}")
    return tasks.select("task_order", text.alias("params"))


def param(name: str) -> Column:
    return F.get_json_object("params", f"$.{name}")


def evaluate_combinations(grid: DataFrame, defaults: Mapping | None = None) -> DataFrame:
    """Every combination with the first reason that rules it out (NULL when it is usable)."""
    defaults = {k: str(v) for k, v in (defaults or {}).items()}

    def value(name: str) -> Column:
        own = F.trim(param(name))
        return F.coalesce(F.when(~F.lower(own).isin(list(NO_VALUE)), own), F.lit(defaults.get(name)).cast("string"))

    backend, search = value("backend"), value("search_alg")
    allowed = F.lit(False)
    for b, names in SEARCH_BY_BACKEND.items():
        allowed = allowed | ((backend == b) & search.isin(list(names)))
    method = F.coalesce(value("dataset_input_method"), F.lit("db_table"))
    horizon = F.coalesce(value("horizon"), value("h")).try_cast("int")
    val_size = value("fit_val_size").try_cast("int")
    model = F.coalesce(value("model"), F.lit(""))
    checks = {
        "missing_unique_id": F.coalesce(value("group_mode"), F.lit("")).isin(list(NEEDS_ID)) & value("unique_id").isNull(),
        "model_backend_requirement": model.isin(list(RAY_ONLY_MODELS)) & backend.isNotNull() & (backend != "ray"),
        "backend_search_mismatch": backend.isNotNull() & search.isNotNull() & ~allowed,
        "missing_dataset_table": (method == "db_table") & value("dataset_table").isNull(),
        "missing_dataset_sql": (method == "db_sql") & value("dataset_sql").isNull(),
        "missing_dataset_path": method.isin("csv", "parquet", "json") & value("dataset_path").isNull(),
        "fit_val_size_too_small": horizon.isNotNull() & val_size.isNotNull() & (val_size != 0) & (val_size < horizon),
    }
    reason = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()])
    checked = grid.withColumn("reason", reason)
    # the first task of each parameter text, combined before the exchange; every later one repeats it
    first = grid.where(F.col("params").isNotNull()).groupBy("params").agg(F.min("task_order").alias("_first"))
    repeat = F.col("reason").isNull() & (F.col("task_order") > F.col("_first"))
    out = checked.join(first, "params", "left").withColumn("reason", F.when(repeat, "duplicate_combination").otherwise(F.col("reason")))
    return out.select(*grid.columns, "reason")


def reason_counts(checked: DataFrame) -> DataFrame:
    """How many combinations each reason rules out, with the parameters that decide it, most frequent first."""
    decided = F.create_map(*[x for name, by in REASONS.items() for x in (F.lit(name), F.lit(", ".join(by)))])
    out = checked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("parameters", F.try_element_at(decided, F.col("reason"))).orderBy(F.col("count").desc(), "reason")


def combo_signature(model: Column, horizon: Column, params: Column) -> Column:
    """SHA-1 of the canonical JSON of model, horizon and parameters. ``params`` is JSON text with sorted keys."""
    named = F.to_json(F.struct(F.trim(F.coalesce(model, F.lit(""))).alias("v")))
    raw = F.concat(
        F.lit('{"horizon": '), F.greatest(F.coalesce(horizon, F.lit(1)), F.lit(1)).cast("string"), F.lit(', "model_name": '),
        F.substr(named, F.lit(6), F.length(named) - 6), F.lit(', "params_json": '), params, F.lit("}"),
    )
    return F.sha1(raw)


def succeeded_signatures(results: DataFrame) -> DataFrame:
    """Signatures of finished work: the stored one and the one recomputed from model, horizon and parameters."""
    ok = results.where(is_success(F.col("status")) & is_blank(F.col("error_message")))
    stored = F.nullif(F.lower(F.trim(F.get_json_object("diagnostics_json", "$.combo_signature"))), F.lit(""))
    computed = combo_signature(F.col("model_name"), F.col("horizon"), F.col("params_json"))
    sig = F.explode(F.array_compact(F.array(stored, computed)))
    return ok.select(sig.alias("signature")).distinct()


def skip_done(tasks: DataFrame, done: DataFrame, signature: str = "signature") -> DataFrame:
    return tasks.join(done.select(F.col("signature").alias(signature)), signature, "left_anti")


def skip_prefix_done(tasks: DataFrame, run_ids: DataFrame, signature: str = "signature") -> DataFrame:
    """Drop tasks whose signature's first ten digits end the id of a finished run."""
    prefix = F.substr(F.regexp_extract(F.lower(F.col("run_id")), "_([0-9a-f]{10,40})$", 1), F.lit(1), F.lit(10))
    done = run_ids.select(prefix.alias("_p")).where("_p <> ''").distinct()
    return tasks.withColumn("_p", F.substr(signature, F.lit(1), F.lit(10))).join(done, "_p", "left_anti").drop("_p")


def seeded_rounds(tasks: DataFrame, depth: int, seed: int = 1, step: int = 1) -> DataFrame:
    """Repeat every task once per depth with its own seed."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max(1, int(depth)) - 1)))
    return tasks.withColumn("depth", rounds).withColumn("seed", F.lit(seed) + F.col("depth") * F.lit(step))


def pending_tasks(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """The tasks without a successful result: where an interrupted grid goes on."""
    done = results.where(is_success(F.col("status"))).select("task_order").distinct()
    return tasks.join(done, "task_order", "left_anti")


def _needs(tasks: DataFrame, h: int, model: str | None) -> DataFrame:
    """Adds what each task's model looks at: how many past values, or how many lags and which decay rates of the whole history.

    Tasks that can't be understood need one value.
    """

    def look(batches):
        for pdf in batches:
            out = []
            for text in pdf["params"]:
                p, need = json.loads(text), (1, 0, [])
                try:
                    m = get_model(str(p.pop("model", model) or "naive"))
                    settings = m.validate(p)
                    if m.family is not None and m.whole(settings):
                        need = (1, int(m.family.lags(settings)), [float(r) for r in m.family.rates(settings)])
                    else:
                        need = (max(1, m.reach(settings, h)), 0, [])
                except (ValueError, TypeError):
                    pass
                out.append(need)
            yield pdf.assign(**{name: [x[i] for x in out] for i, name in enumerate(("_reach", "_lags", "_rates"))})

    return tasks.mapInPandas(look, "task_order long, params string, _reach long, _lags long, _rates array<double>")


def _answers(rows: DataFrame, keys: Sequence[str], h: int, model: str | None, rates: Sequence[float]) -> DataFrame:
    """The holdout points of every task of every row; a row holds a series' last values, its history if asked for, and some tasks."""

    def history(row) -> History | None:
        if row["_n"] is None:
            return None
        decayed = dict(zip(rates, row["_decayed"], strict=True))
        return History(int(row["_n"]), row["_center"], row["_scale"], row["_total"], *(np.array(row[c], float) for c in ("_products",)), decayed, *(np.array(row[c], float) for c in ("_first", "_last")))

    def answered(row, tasks):
        y = np.array(row["_recent"], float)
        past = history(row) if "_n" in row else None
        for order, text in tasks:
            p = json.loads(text)
            name = str(p.pop("model", model) or "naive")
            try:
                m = get_model(name)
                settings = m.validate(p)
                if len(y) <= h:
                    raise ValueError("series is shorter than the holdout")
                if m.family is not None and m.whole(settings):
                    guess = m.family.predict(past, h, settings)
                else:
                    need = m.reach(settings, h) + h
                    guess = m.predict(y[-need : len(y) - h], h, settings)
                yield from ((order, name, "success", None, s + 1, y[len(y) - h + s], float(guess[s])) for s in range(h))
            except Exception as e:  # a failed task is a result, not the end of the grid
                yield order, name, "failed", f"{type(e).__name__}: {e}", None, None, None

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    schema = f"{types}, task_order long, model_name string, status string, error_message string, step long, y double, yhat double"
    names = ["task_order", "model_name", "status", "error_message", "step", "y", "yhat"]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                values = row.to_pylist()[0]
                out = list(answered(values, [(t["task_order"], t["params"]) for t in values["_tasks"]]))
                cells = list(zip(*out, strict=True))
                same = [row.column(k).take(pa.array(np.zeros(len(out), np.int64))) for k in keys]
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(cells, kinds, strict=True))], names=[*keys, *names])

    return rows.mapInArrow(run, schema)


def run_grid(df: DataFrame, spec: SeriesSpec, tasks: DataFrame, h: int, model: str | None = None, done: DataFrame | None = None, stop_on_error: bool = False) -> DataFrame:
    """One result per (task, series): metrics of the last ``h`` observed rows, or the error that stopped it.

    ``tasks`` carries ``task_order``, ``params`` JSON (with ``model`` unless one is given). A series contributes the tail of its values
    that windowed models reach, and, for the models of the whole history, one state of sums from one pass over its rows, from which
    all their settings are answered; no array holds a series. Tasks are dealt in buckets of bounded size, and every (series, bucket)
    pair is a row of its own. ``done`` holds earlier results, whose successful tasks are left out. With ``stop_on_error`` no
    task behind the first failing one has a result.
    """
    tasks = tasks.select(F.col("task_order").cast("long").alias("task_order"), "params")
    if done is not None:
        tasks = pending_tasks(tasks, done)
    keys = spec.keys
    ready = durable(_needs(tasks, h, model))
    reach, lags, total = ready.agg(F.max("_reach"), F.max("_lags"), F.count(F.lit(1))).first()
    rates = sorted(r[0] for r in ready.select(F.explode("_rates")).distinct().collect())  # values of the caller's own grid
    recent = durable(recent_values(df, spec, (reach or 1) + h).drop("_last"))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = max(1, recent.count())
    layout = measure(df, keys) if lags else None
    points = None
    for first in range(0, max(1, len(rates)), RATES):
        group = rates[first : first + RATES]
        asks = F.exists("_rates", lambda r: r.isin(group)) if group else F.lit(False)
        mine = ready.where(asks | (F.size("_rates") == 0) if first == 0 else asks)
        left = recent
        if lags:
            left = durable(attach(recent, histories(df, spec, lags, group, h, layout), keys, BROADCAST_ROWS + 1))
        buckets = max(-(-total // BUCKET), min(total, -(-2 * spread // series)), 1)
        right = mine.groupBy(F.pmod(F.xxhash64("task_order"), F.lit(buckets)).cast("int").alias("_b")).agg(F.collect_list(F.struct("task_order", "params")).alias("_tasks"))
        pairs = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(right, "_b").repartition(spread, *keys, "_b").drop("_b")
        part = _answers(pairs, keys, h, model, group)
        points = part if points is None else points.unionByName(part)
    out = points.groupBy(*keys, "task_order", "model_name", "status", "error_message").agg(
        F.count("step").alias("n"), *[c.alias(k) for k, c in metric_columns(F.col("y"), F.col("yhat")).items()]
    )
    if stop_on_error:
        out = durable(out)
        first = out.where("status = 'failed'").agg(F.min("task_order").alias("_stop"))
        out = out.join(F.broadcast(first), F.col("_stop").isNull() | (F.col("task_order") <= F.col("_stop"))).drop("_stop")
    return out


def rank_tasks(results: DataFrame, metric: str = "mae") -> DataFrame:
    """Mean metric and failures per task, best first."""
    agg = results.groupBy("task_order", "model_name").agg(
        F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(metric).alias(metric)
    )
    return agg.orderBy(F.col(metric).asc_nulls_last(), "task_order")


def task_status(tasks: DataFrame, events: DataFrame, keys: Sequence[str] = ("grid_id", "task_id"), order: str = "event_ts") -> DataFrame:
    """The state of every task: pending until its latest event says otherwise."""
    latest = events.groupBy(*keys).agg(F.max_by("status", order).alias("_s"), F.min(order).alias("started_at"), F.max(order).alias("updated_at"))
    return tasks.join(latest, list(keys), "left").withColumn("status", F.coalesce("_s", F.lit("pending"))).drop("_s")


def status_counts(tasks: DataFrame, grid: str = "grid_id") -> DataFrame:
    return tasks.groupBy(grid, "status").agg(F.count(F.lit(1)).alias("n"))
