"""Run analytics, event logs and JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonflat, text
from ..operators import events as ev
from ..operators import runs as ra
from ..operators.joins import asof_join
from ..session import held
from .views import ERRORS_SQL, HISTORY_SQL, RUNS_SQL, SPANS_SQL, errors, history, r, runs, spans, table

METRIC_SQL = RUNS_SQL + """, m AS (SELECT *, CAST(coalesce(rows_written, 0) AS DOUBLE) AS w, CAST(coalesce(rows_failed, 0) AS DOUBLE) AS f FROM runs),
  rm AS (SELECT *, w + f AS rows_total, CASE WHEN w + f > 0 THEN f / (w + f) ELSE 0 END AS fail_rate,
         CASE WHEN duration_sec > 0 THEN w / duration_sec END AS throughput, status = 'failed' AS is_failed FROM m)"""
STAGE_TOTAL_SQL = """, ps AS (SELECT run_id, stage_name, sum(duration_ms) AS d FROM spans GROUP BY 1, 2),
  dom AS (SELECT run_id, stage_name AS dominant_stage, d AS dominant_stage_duration_ms, row_number() OVER (PARTITION BY run_id ORDER BY d DESC, stage_name) AS rn FROM ps),
  st AS (SELECT run_id, sum(duration_ms) AS stage_duration_ms, sum(db_time_ms) AS db_time_ms, avg(gpu_util_avg) AS gpu_util_avg,
         avg(gpu_mem_used_mb_avg) AS gpu_mem_used_mb_avg, count(exception_type) AS stage_exception_count FROM spans GROUP BY 1)"""


def register(reg) -> None:
    _runs(reg)
    _baselines(reg)
    _logs(reg)
    _json(reg)


def _rounded(df, names, n=6):
    return df.withColumns({c: r(c, n) for c in names})


def _runs(reg) -> None:
    @reg.add(
        "run_metrics",
        f"WITH {METRIC_SQL} SELECT run_id, status, rows_total, round(fail_rate, 6) + 0.0 AS fail_rate, round(throughput, 4) + 0.0 AS throughput, is_failed FROM rm",
    )
    def _(spark, sf):
        out = ra.run_metrics(runs(spark, sf))
        return out.select("run_id", "status", "rows_total", r("fail_rate").alias("fail_rate"), r("throughput", 4).alias("throughput"), "is_failed")

    @reg.add(
        "filtered_runs",
        f"""WITH {RUNS_SQL} SELECT run_id, status FROM runs WHERE started_at >= TIMESTAMP '1996-01-01' AND CAST(started_at AS DATE) <= DATE '1999-12-31'
        AND status IN ('failed', 'success') AND app_name IN ('1-URGENT', '2-HIGH') AND lower(command) LIKE '%seg mach%'""",
    )
    def _(spark, sf):
        out = ra.filter_runs(runs(spark, sf), "1996-01-01", "1999-12-31", ["failed", "success"], ["1-URGENT", "2-HIGH"], [], " SEG mach ")
        return ra.newest_first(out).select("run_id", "status")

    meta = """SELECT o_orderkey AS run_id, model_name, backend, search_alg FROM orders LEFT JOIN (
        SELECT user_id AS run_id, arg_min(event_type, event_id) AS model_name, CASE WHEN user_id % 2 = 0 THEN 'ray' END AS backend,
        CASE WHEN user_id % 3 = 0 THEN 'tpe' WHEN user_id % 3 = 1 THEN 'random' END AS search_alg FROM events GROUP BY user_id) m ON o_orderkey = m.run_id"""

    @reg.add("run_model_metadata", meta)
    def _(spark, sf):
        u = F.col("user_id")
        params = F.to_json(F.struct(F.when(u % 2 == 0, "ray").alias("backend"), F.when(u % 3 == 0, "tpe").alias("search_alg"), F.when(u % 3 == 1, "random").alias("search_algorithm")))
        models = table(spark, sf, "events").select(u.alias("run_id"), F.col("event_type").alias("model_name"), F.lit("ok").alias("model_status"), params.alias("params_json"), "event_id")
        rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
        return ra.model_metadata(rows, models, "event_id").select("run_id", "model_name", "backend", "search_alg")

    cols = "stage_duration_ms, round(db_time_ms, 4) + 0.0 AS db_time_ms, round(gpu_util_avg, 6) + 0.0 AS gpu_util_avg, round(gpu_mem_used_mb_avg, 6) + 0.0 AS gpu_mem_used_mb_avg, stage_exception_count, dominant_stage, dominant_stage_duration_ms"

    @reg.add("stage_totals", f"WITH {SPANS_SQL}{STAGE_TOTAL_SQL} SELECT st.run_id, {cols} FROM st JOIN dom ON st.run_id = dom.run_id AND rn = 1")
    def _(spark, sf):
        out = ra.stage_totals(spans(spark, sf)).withColumn("db_time_ms", r("db_time_ms", 4))
        return _rounded(out, ["gpu_util_avg", "gpu_mem_used_mb_avg"])

    modal = """SELECT run_id, count(*) AS {n}, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S') AS {last}, (SELECT v FROM (SELECT {v} AS v, count(*) AS c FROM {t} i WHERE i.run_id = o.run_id GROUP BY 1) ORDER BY c DESC, v LIMIT 1) AS {mode} FROM {t} o GROUP BY run_id"""

    @reg.add("history_totals", f"WITH {HISTORY_SQL} " + modal.format(n="history_events", last="last_event_ts", v="event_type", t="history", mode="last_event_type"))
    def _(spark, sf):
        return ra.history_totals(history(spark, sf)).withColumn("last_event_ts", F.date_format("last_event_ts", "yyyy-MM-dd HH:mm:ss"))

    @reg.add("error_totals", f"WITH {ERRORS_SQL} " + modal.format(n="error_events", last="last_error_ts", v="error_type", t="errors", mode="top_error_type"))
    def _(spark, sf):
        return ra.error_totals(errors(spark, sf)).withColumn("last_error_ts", F.date_format("last_error_ts", "yyyy-MM-dd HH:mm:ss"))

    @reg.add(
        "runs_with_aggregates",
        f"""WITH {METRIC_SQL}, {SPANS_SQL}{STAGE_TOTAL_SQL}, {HISTORY_SQL}, {ERRORS_SQL},
        h AS (SELECT run_id, count(*) AS history_events FROM history GROUP BY 1), e AS (SELECT run_id, count(*) AS error_events FROM errors GROUP BY 1)
        SELECT rm.run_id, round(fail_rate, 6) + 0.0 AS fail_rate, round(db_time_ms / (duration_sec * 1000), 6) + 0.0 AS db_share, dominant_stage, CAST(history_events AS DOUBLE) AS history_events, CAST(error_events AS DOUBLE) AS error_events
        FROM rm LEFT JOIN st USING (run_id) LEFT JOIN (SELECT * FROM dom WHERE rn = 1) d USING (run_id) LEFT JOIN h USING (run_id) LEFT JOIN e USING (run_id)""",
    )
    def _(spark, sf):
        out = ra.with_aggregates(runs(spark, sf), spans(spark, sf), history(spark, sf), errors(spark, sf))
        return out.select("run_id", r("fail_rate").alias("fail_rate"), r("db_share").alias("db_share"), "dominant_stage", *[F.col(c).cast("double").alias(c) for c in ("history_events", "error_events")])

    @reg.add(
        "error_context",
        f"""WITH {HISTORY_SQL}, {ERRORS_SQL} SELECT e.event_id, e.run_id, e.error_type, strftime(h.event_ts, '%Y-%m-%d %H:%M:%S') AS prev_event_ts,
        h.event_type AS prev_event_type, h.status AS prev_status FROM errors e ASOF LEFT JOIN history h ON e.run_id = h.run_id AND e.event_ts >= h.event_ts""",
    )
    def _(spark, sf):
        out = ra.error_context(errors(spark, sf), history(spark, sf))
        return out.select("event_id", "run_id", "error_type", F.date_format("prev_event_ts", "yyyy-MM-dd HH:mm:ss").alias("prev_event_ts"), "prev_event_type", "prev_status")

    @reg.add(
        "asof_orders",
        """SELECT l_orderkey, l_linenumber, o.o_orderkey AS prev_order FROM lineitem l ASOF LEFT JOIN
        (SELECT o_orderstatus, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON CASE WHEN l_returnflag = 'N' THEN 'O' WHEN l_returnflag = 'R' THEN 'F' ELSE 'P' END = o.o_orderstatus AND l.l_shipdate >= o.o_orderdate""",
    )
    def _(spark, sf):
        flag = F.when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == "R", "F").otherwise("P")
        left = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("k"), "l_shipdate")
        right = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
        return asof_join(left, right, "k", "l_shipdate", "o_orderdate", {"o_orderkey": "prev_order"}).select("l_orderkey", "l_linenumber", "prev_order")

    @reg.add(
        "completed_runs",
        f"""WITH {HISTORY_SQL}, {ERRORS_SQL}, l AS (SELECT run_id, arg_max(status, event_id) AS status FROM history GROUP BY 1),
        x AS (SELECT DISTINCT run_id FROM errors WHERE event_ts >= TIMESTAMP '2024-01-29' AND stage = 'fit')
        SELECT run_id FROM l WHERE status = 'success' AND NOT EXISTS (SELECT 1 FROM x WHERE x.run_id = l.run_id)""",
    )
    def _(spark, sf):
        bad = errors(spark, sf).where("event_ts >= '2024-01-29' AND stage = 'fit'")
        return ra.completed_runs(history(spark, sf), bad)

    @reg.add("stages_of_runs", f"WITH {SPANS_SQL}, {RUNS_SQL} SELECT run_id, span_no, duration_ms FROM spans WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'failed')")
    def _(spark, sf):
        chosen = ra.filter_runs(runs(spark, sf), status=["failed"])
        return ra.normalize_frame(spans(spark, sf), chosen, ["duration_ms", "db_time_ms"]).select("run_id", "span_no", "duration_ms")

    @reg.add(
        "model_resources",
        f"""WITH {RUNS_SQL}, e AS (SELECT *, started_at + to_seconds(CAST(duration_sec AS BIGINT)) AS ended_at FROM runs),
        x AS (SELECT model_name, (epoch_us(coalesce(CASE WHEN status <> 'running' THEN ended_at END, TIMESTAMP '2002-01-01')) - epoch_us(started_at)) / 1e6 AS s, coalesce(rows_written, 0) AS w, coalesce(rows_failed, 0) AS f FROM e)
        SELECT model_name, count(*) AS run_count, round(avg(s), 2) + 0.0 AS avg_duration_sec, round(avg(w), 3) + 0.0 AS avg_rows_written, round(avg(f), 3) + 0.0 AS avg_rows_failed,
        round(avg(w) / avg(s), 8) + 0.0 AS efficiency_score FROM x GROUP BY 1""",
    )
    def _(spark, sf):
        x = runs(spark, sf)
        secs = F.unix_micros(F.col("started_at").cast("timestamp")) + F.col("duration_sec") * 1000000
        x = x.withColumn("ended_at", F.when(F.col("status") != "running", F.timestamp_micros(secs.cast("long"))))
        out = ra.model_resources(x.select("run_id", "model_name"), x, F.lit("2002-01-01 00:00:00").cast("timestamp"))
        return out.select("model_name", "run_count", r("avg_duration_sec", 2).alias("avg_duration_sec"), *[r(c, 3).alias(c) for c in ("avg_rows_written", "avg_rows_failed")], r("efficiency_score", 8).alias("efficiency_score"))

    @reg.add(
        "resource_features",
        f"""WITH {RUNS_SQL}, {SPANS_SQL}{STAGE_TOTAL_SQL} SELECT o_orderkey AS run_id, r.duration_sec, st.stage_duration_ms FROM orders LEFT JOIN runs r ON o_orderkey = r.run_id LEFT JOIN st ON o_orderkey = st.run_id""",
    )
    def _(spark, sf):
        base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
        return ra.with_resources(base, runs(spark, sf).select("run_id", "duration_sec"), ra.stage_totals(spans(spark, sf)).select("run_id", "stage_duration_ms"))

    @reg.add(
        "stage_pareto",
        f"""WITH {SPANS_SQL}, a AS (SELECT stage_name, count(stage_name) AS count, sum(duration_ms) AS total_duration_ms, avg(duration_ms) AS avg_duration_ms, sum(db_time_ms) AS total_db_time_ms,
        avg(gpu_util_avg) AS avg_gpu_util, avg(gpu_mem_used_mb_avg) AS avg_gpu_mem_mb, count(exception_type) AS exception_count FROM spans GROUP BY 1)
        SELECT stage_name, count, total_duration_ms, round(avg_duration_ms, 4) + 0.0 AS avg_duration_ms, round(total_db_time_ms, 2) + 0.0 AS total_db_time_ms, round(avg_gpu_util, 5) + 0.0 AS avg_gpu_util, round(avg_gpu_mem_mb, 5) + 0.0 AS avg_gpu_mem_mb,
        exception_count, round(total_duration_ms / sum(total_duration_ms) OVER (), 6) + 0.0 AS stage_share, round(sum(total_duration_ms) OVER (ORDER BY total_duration_ms DESC, stage_name) / sum(total_duration_ms) OVER (), 6) + 0.0 AS cum_share,
        round(total_db_time_ms / total_duration_ms, 6) + 0.0 AS db_share FROM a""",
    )
    def _(spark, sf):
        out = ra.stage_pareto(spans(spark, sf))
        out = out.withColumns({"avg_duration_ms": r("avg_duration_ms", 4), "total_db_time_ms": r("total_db_time_ms", 2)})
        return _rounded(_rounded(out, ["avg_gpu_util", "avg_gpu_mem_mb"], 5), ["stage_share", "cum_share", "db_share"])

    @reg.add("run_stage_share", f"WITH {SPANS_SQL}, a AS (SELECT run_id, stage_name, sum(duration_ms) AS duration_ms FROM spans GROUP BY 1, 2) SELECT *, round(duration_ms / sum(duration_ms) OVER (PARTITION BY run_id), 6) + 0.0 AS stage_share FROM a")
    def _(spark, sf):
        return _rounded(ra.run_stage_share(spans(spark, sf)), ["stage_share"])

    @reg.add("error_frequency", f"WITH {ERRORS_SQL} SELECT 'type' AS kind, error_type AS name, count(*) AS size FROM errors GROUP BY 2 UNION ALL SELECT 'stage', stage, count(*) FROM errors GROUP BY 2")
    def _(spark, sf):
        e = errors(spark, sf)
        kinds = [ra.frequency(e, c).select(F.lit(k).alias("kind"), F.col(c).alias("name"), "size") for k, c in (("type", "error_type"), ("stage", "stage"))]
        return kinds[0].unionByName(kinds[1])

    @reg.add(
        "group_comparison",
        f"WITH {METRIC_SQL} SELECT model_name, count(throughput) AS n, round(avg(throughput), 4) + 0.0 AS mean, round(stddev_samp(throughput), 4) + 0.0 AS std, round(quantile_cont(throughput, 0.5), 4) + 0.0 AS p50, round(quantile_cont(throughput, 0.9), 4) + 0.0 AS p90 FROM rm GROUP BY 1",
    )
    def _(spark, sf):
        return _rounded(ra.group_comparison(ra.run_metrics(runs(spark, sf)), "model_name", "throughput"), ["mean", "std", "p50", "p90"], 4)

    @reg.add("accuracy_by_model", "SELECT event_type AS model_name, count(value) AS samples, round(avg(value), 6) + 0.0 AS mean_value, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.9), 6) + 0.0 AS p90 FROM events GROUP BY 1")
    def _(spark, sf):
        rows = table(spark, sf, "events").select(F.col("event_type").alias("model_name"), "value")
        return _rounded(ra.accuracy_by_model(rows), ["mean_value", "p50", "p90"])

    @reg.add(
        "summary_kpis",
        f"""WITH {METRIC_SQL}, {SPANS_SQL}{STAGE_TOTAL_SQL}, a AS (SELECT rm.*, gpu_util_avg, db_time_ms / (duration_sec * 1000) AS db_share FROM rm LEFT JOIN st USING (run_id))
        SELECT count(*) AS runs, round((1 - avg(CAST(is_failed AS DOUBLE))) * 100, 6) + 0.0 AS success_pct, round(quantile_cont(duration_sec, 0.5), 6) + 0.0 AS duration_p50, round(quantile_cont(duration_sec, 0.9), 6) + 0.0 AS duration_p90,
        round(quantile_cont(throughput, 0.5), 4) + 0.0 AS throughput_p50, round(quantile_cont(fail_rate, 0.9), 6) + 0.0 AS fail_rate_p90, round(quantile_cont(gpu_util_avg, 0.5), 5) + 0.0 AS gpu_util_p50, round(quantile_cont(db_share, 0.5), 6) + 0.0 AS db_share_p50 FROM a""",
    )
    def _(spark, sf):
        out = ra.summary_kpis(ra.with_aggregates(runs(spark, sf), spans(spark, sf), None, None))
        out = _rounded(out, ["success_pct", "duration_p50", "duration_p90", "fail_rate_p90", "db_share_p50"])
        return out.withColumns({"throughput_p50": r("throughput_p50", 4), "gpu_util_p50": r("gpu_util_p50", 5)})

    @reg.add(
        "resource_summary",
        "SELECT l_suppkey AS run_id, count(*) AS sample_count, max(l_quantity) AS cpu_max, round(avg(l_quantity), 6) + 0.0 AS cpu_mean, max(l_extendedprice) AS rss_max, round(avg(l_extendedprice), 4) + 0.0 AS rss_mean FROM lineitem GROUP BY 1",
    )
    def _(spark, sf):
        out = ra.resource_summary(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "run_id"), ["run_id"], {"cpu": "l_quantity", "rss": "l_extendedprice"})
        return out.withColumns({"cpu_mean": r("cpu_mean"), "rss_mean": r("rss_mean", 4)})


BASE_SQL = METRIC_SQL + """, bs AS (SELECT model_name, count(run_id) AS baseline_n, quantile_cont(duration_sec, 0.5) AS d50, quantile_cont(duration_sec, 0.9) AS d90,
  quantile_cont(throughput, 0.5) AS t50, quantile_cont(fail_rate, 0.5) AS f50 FROM {pool} GROUP BY 1)"""
ANOM_SQL = BASE_SQL.format(pool="rm") + """, z0 AS (SELECT rm.*, bs.d50, duration_sec / d50 AS ratio, quantile_cont(duration_sec, 0.5) OVER g AS md, quantile_cont(throughput, 0.5) OVER g AS mt,
  quantile_cont(duration_sec, 0.25) OVER g AS q1, quantile_cont(duration_sec, 0.75) OVER g AS q3 FROM rm LEFT JOIN bs USING (model_name) WINDOW g AS (PARTITION BY model_name)),
  z1 AS (SELECT *, quantile_cont(abs(duration_sec - md), 0.5) OVER g AS xd, quantile_cont(abs(throughput - mt), 0.5) OVER g AS xt FROM z0 WINDOW g AS (PARTITION BY model_name)),
  z2 AS (SELECT *, (duration_sec - md) / (1.4826 * nullif(xd, 0)) AS drz, (throughput - mt) / (1.4826 * nullif(xt, 0)) AS trz, coalesce(duration_sec > q3 + 1.5 * (q3 - q1), false) AS high FROM z1),
  z3 AS (SELECT *, coalesce(abs(drz), 0) + coalesce(abs(trz), 0) + CASE WHEN high THEN 1.0 ELSE 0.0 END AS anomaly_score,
    coalesce(abs(drz) >= 3, false) OR coalesce(trz <= -3, false) OR high OR coalesce(ratio >= 1.8, false) AS anomaly_flag FROM z2)"""


def _anomalous(spark, sf):
    x = held(ra.run_metrics(runs(spark, sf)).select("run_id", "model_name", "duration_sec", "throughput", "fail_rate"))
    x = ra.with_expected(x, x, ra.baseline_stats(x, "model_name"), "model_name")
    return ra.run_anomalies(x, "model_name")


def _baselines(reg) -> None:
    pool = "(SELECT * FROM rm ORDER BY started_at DESC, run_id LIMIT 2000)"

    @reg.add(
        "baseline_stats",
        f"WITH {BASE_SQL.format(pool=pool)} SELECT model_name, baseline_n, round(d50, 6) + 0.0 AS expected_duration_p50, round(d90, 6) + 0.0 AS expected_duration_p90, round(t50, 4) + 0.0 AS expected_throughput_p50, round(f50, 6) + 0.0 AS expected_fail_rate_p50 FROM bs",
    )
    def _(spark, sf):
        x = runs(spark, sf)
        out = ra.baseline_stats(ra.baseline_pool(x, x, latest=2000), "model_name")
        out = _rounded(out, ["expected_duration_p50", "expected_duration_p90", "expected_fail_rate_p50"]).withColumn("expected_throughput_p50", r("expected_throughput_p50", 4))
        return out.drop("expected_gpu_util_p50", "expected_db_share_p50")

    recent = "(SELECT * FROM rm WHERE started_at >= TIMESTAMP '2000-01-01')"

    @reg.add(
        "expected_values",
        f"""WITH {BASE_SQL.format(pool=recent)}, g AS (SELECT quantile_cont(duration_sec, 0.5) AS gd, quantile_cont(throughput, 0.5) AS gt FROM {recent})
        SELECT run_id, round(duration_sec - coalesce(d50, gd), 6) + 0.0 AS duration_vs_expected, round(duration_sec / coalesce(d50, gd), 6) + 0.0 AS duration_ratio_vs_expected, round(throughput / coalesce(t50, gt), 6) + 0.0 AS throughput_ratio_vs_expected FROM rm LEFT JOIN bs USING (model_name), g""",
    )
    def _(spark, sf):
        x = runs(spark, sf)
        pool_ = ra.baseline_pool(x, x, latest=None, days=366, end="2001-01-01")
        out = ra.with_expected(ra.run_metrics(x), pool_, ra.baseline_stats(pool_, "model_name"), "model_name")
        names = ["duration_vs_expected", "duration_ratio_vs_expected", "throughput_ratio_vs_expected"]
        return out.select("run_id", *[r(n).alias(n) for n in names])

    @reg.add("run_anomalies", f"WITH {ANOM_SQL} SELECT run_id, round(drz, 6) + 0.0 AS duration_rz, round(trz, 6) + 0.0 AS throughput_rz, high AS duration_iqr_high, round(anomaly_score, 6) + 0.0 AS anomaly_score, anomaly_flag FROM z3")
    def _(spark, sf):
        out = _anomalous(spark, sf)
        return out.select("run_id", *[r(n).alias(n) for n in ("duration_rz", "throughput_rz", "anomaly_score")], "duration_iqr_high", "anomaly_flag")

    ranked = {
        "slowest_runs": (ra.slowest, "duration_sec DESC NULLS LAST, run_id", ""),
        "least_efficient_runs": (ra.least_efficient, "throughput ASC NULLS LAST, run_id", ""),
        "most_anomalous_runs": (ra.most_anomalous, "anomaly_score DESC, run_id", "WHERE anomaly_flag"),
    }
    for name, (fn, order, where) in ranked.items():

        def top(spark, sf, fn=fn):
            return fn(_anomalous(spark, sf), 50).select("run_id")

        reg.add(name, f"WITH {ANOM_SQL} SELECT run_id FROM z3 {where} ORDER BY {order} LIMIT 50")(top)

    @reg.add(
        "failed_runs_first",
        f"WITH {METRIC_SQL}, {ERRORS_SQL}, e AS (SELECT run_id, count(*) AS error_events FROM errors GROUP BY 1) SELECT run_id FROM rm LEFT JOIN e USING (run_id) ORDER BY is_failed DESC, error_events DESC NULLS LAST, duration_sec DESC NULLS LAST, run_id LIMIT 50",
    )
    def _(spark, sf):
        return ra.failed_first(ra.with_aggregates(runs(spark, sf), None, None, errors(spark, sf)), 50).select("run_id")

    @reg.add(
        "idle_gpu_runs",
        f"WITH {METRIC_SQL}, {SPANS_SQL}{STAGE_TOTAL_SQL} SELECT run_id FROM rm JOIN st USING (run_id) WHERE duration_sec >= (SELECT quantile_cont(duration_sec, 0.75) FROM rm) AND gpu_util_avg < 40",
    )
    def _(spark, sf):
        return ra.idle_gpu_runs(ra.with_aggregates(runs(spark, sf), spans(spark, sf), None, None), 40.0).select("run_id")

    @reg.add("comparable_groups", f"WITH {RUNS_SQL} SELECT model_name, count(*) AS size FROM runs GROUP BY 1 HAVING count(*) >= 5 ORDER BY size DESC, model_name LIMIT 2")
    def _(spark, sf):
        return ra.comparable_groups(runs(spark, sf), "model_name", 5, 2)

    @reg.add(
        "recommendations",
        f"""WITH {ANOM_SQL}, {SPANS_SQL}, {ERRORS_SQL}{STAGE_TOTAL_SQL}, a AS (SELECT z3.*, gpu_util_avg, db_time_ms / (duration_sec * 1000) AS db_share FROM z3 LEFT JOIN st USING (run_id)),
        sh AS (SELECT stage_name, sum(duration_ms) AS d, sum(duration_ms) / sum(sum(duration_ms)) OVER () AS share FROM spans GROUP BY 1), top AS (SELECT stage_name, share FROM sh ORDER BY d DESC, stage_name LIMIT 1),
        er AS (SELECT error_type FROM errors WHERE error_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, error_type LIMIT 1),
        k AS (SELECT quantile_cont(db_share, 0.5) AS db, quantile_cont(duration_sec, 0.5) AS dur, quantile_cont(gpu_util_avg, 0.5) AS gpu, avg(CAST(is_failed AS DOUBLE)) AS fail, count(*) FILTER (anomaly_flag) AS odd FROM a),
        f AS (SELECT 0 AS p, 'database_share' AS rule, 'high' AS priority, NULL::VARCHAR AS subject, db::DOUBLE AS value, 0.35::DOUBLE AS bound FROM k WHERE db >= 0.35
          UNION ALL SELECT 0, 'stage_concentration', 'high', stage_name, share, 0.5 FROM top WHERE share >= 0.5 UNION ALL SELECT 0, 'failure_share', 'high', (SELECT error_type FROM er), fail, 0.1 FROM k WHERE fail >= 0.1
          UNION ALL SELECT 1, 'gpu_underuse', 'medium', NULL, gpu, 25 FROM k WHERE gpu < 25 AND dur > 0 UNION ALL SELECT 1, 'departures', 'medium', NULL, odd, 1 FROM k WHERE odd >= 1),
        g AS (SELECT * FROM f UNION ALL SELECT 2, 'nothing_found', 'low', NULL, NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM f))
        SELECT CAST(row_number() OVER (ORDER BY p, rule) - 1 AS INT) AS rank, priority, rule, subject, round(value, 5) + 0.0 AS value, bound FROM g""",
    )
    def _(spark, sf):
        x = held(ra.with_aggregates(runs(spark, sf), spans(spark, sf), None, errors(spark, sf)).select("run_id", "model_name", "duration_sec", "throughput", "fail_rate", "gpu_util_avg", "db_share", "is_failed"))
        x = ra.run_anomalies(ra.with_expected(x, x, ra.baseline_stats(x, "model_name"), "model_name"), "model_name")
        out = ra.recommendations(x, ra.stage_pareto(spans(spark, sf)), errors(spark, sf))
        return out.withColumn("value", r("value", 5))

    post = """, c AS (SELECT model_name, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1),
      p AS (SELECT *, success + failed AS n, (1.0 + success) / (2.0 + success + failed) AS m, sqrt((1.0 + success) * (1.0 + failed) / (pow(2.0 + success + failed, 2) * (3.0 + success + failed))) AS sd FROM c)
      SELECT model_name, success, failed, n, round(m, 6) + 0.0 AS posterior_mean, round(greatest(0.0, m - 1.96 * sd), 6) + 0.0 AS posterior_ci_low_95, round(least(1.0, m + 1.96 * sd), 6) + 0.0 AS posterior_ci_high_95 FROM p"""

    @reg.add("beta_posterior", f"WITH {RUNS_SQL}{post}")
    def _(spark, sf):
        return _rounded(ra.beta_posterior(runs(spark, sf)), ["posterior_mean", "posterior_ci_low_95", "posterior_ci_high_95"])

    @reg.add("metric_samples", "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts)) / 1e6, 6) + 0.0 AS gap_sec FROM events")
    def _(spark, sf):
        m = table(spark, sf, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("metric_key"), F.col("ts").alias("sampled_at"))
        return ra.metric_gaps(m).select("event_id", r("gap_sec").alias("gap_sec"))

    @reg.add("selected_metric", "SELECT event_id, value AS metric_value FROM events WHERE user_id = 7 AND event_type = 'view'")
    def _(spark, sf):
        m = table(spark, sf, "events").select("event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("metric_key"), F.col("ts").alias("sampled_at"), F.col("value").alias("metric_value"))
        return ra.selected_metric(m, 7, "view").select("event_id", "metric_value")

    deltas = """WITH c AS (SELECT user_id AS run_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts) AS cpu FROM events),
      s AS (SELECT event_id, user_id AS run_id, ts - INTERVAL 6 HOUR AS a, ts + INTERVAL 6 HOUR AS b FROM events)
      SELECT s.event_id, round(y.cpu - x.cpu, 4) + 0.0 AS cpu_delta FROM s ASOF LEFT JOIN c x ON s.run_id = x.run_id AND s.a >= x.ts ASOF LEFT JOIN c y ON s.run_id = y.run_id AND s.b >= y.ts"""

    @reg.add("span_deltas", deltas)
    def _(spark, sf):
        from ..plans.series import over_groups

        e = table(spark, sf, "events")
        total = over_groups(e, ["user_id"], ["ts"], lambda f, _w: f.withColumn("metric_value", F.col("_before") + F.col("value")), running={"_before": F.col("value")})
        metrics = total.select(F.col("user_id").alias("run_id"), F.lit("cpu").alias("metric_key"), F.col("ts").alias("sampled_at"), "metric_value")
        six = F.expr("INTERVAL 6 HOURS")
        sp = e.select("event_id", F.col("user_id").alias("run_id"), (F.col("ts") - six).alias("started_at"), (F.col("ts") + six).alias("ended_at"))
        return ra.span_deltas(sp, metrics, ["cpu"]).select("event_id", r("cpu_delta", 4).alias("cpu_delta"))

    @reg.add(
        "config_checks",
        """SELECT o_orderkey, unnest(['status', 'customer']) AS check, unnest([o_orderstatus, CAST(o_custkey AS VARCHAR)]) AS expected, unnest([CASE WHEN o_orderkey % 3 > 0 THEN 'F' END, CAST(o_custkey - o_orderkey % 2 AS VARCHAR)]) AS actual,
        unnest([CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderstatus = 'F' AS VARCHAR) END, CAST(o_orderkey % 2 = 0 AS VARCHAR)]) AS ok FROM orders""",
    )
    def _(spark, sf):
        k = F.col("o_orderkey")
        t = table(spark, sf, "orders").withColumns({"s2": F.when(k % 3 > 0, "F"), "c2": F.col("o_custkey") - k % 2})
        return ra.config_checks(t, ["o_orderkey"], {"status": ("o_orderstatus", "s2", False), "customer": ("o_custkey", "c2", True)}).withColumn("ok", F.col("ok").cast("string"))


LEVEL_SQL = """CASE WHEN regexp_matches(t, 'traceback|exception|modulenotfounderror|error:| failed|timeout') THEN 'ERROR' WHEN regexp_matches(t, 'warning|warn|deprecated|retry') THEN 'WARNING'
  WHEN regexp_matches(t, 'success|passed|no issues identified|all checks passed') THEN 'OK' ELSE 'INFO' END"""
MESSAGE_SQL = """CASE event_type WHEN 'error' THEN 'Job failed: Timeout after ' || user_id || 's, password=abc' || user_id WHEN 'view' THEN 'retry ' || event_id WHEN 'purchase' THEN 'All checks passed'
  WHEN 'click' THEN 'connect postgresql://bob:pw' || user_id || '@db/x' ELSE 'step ' || event_id END"""


def _messages(spark, sf):
    e = table(spark, sf, "events")
    t, u, i = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    msg = (
        F.when(t == "error", F.concat(F.lit("Job failed: Timeout after "), u, F.lit("s, password=abc"), u))
        .when(t == "view", F.concat(F.lit("retry "), i))
        .when(t == "purchase", "All checks passed")
        .when(t == "click", F.concat(F.lit("connect postgresql://bob:pw"), u, F.lit("@db/x")))
        .otherwise(F.concat(F.lit("step "), i))
    )
    return e.select("event_id", "ts", F.lit("app").alias("source"), t.alias("category"), msg.alias("message"), u.alias("run_id"))


def _logs(reg) -> None:
    masked = f"regexp_replace(regexp_replace({MESSAGE_SQL}, '(?i)(password|passwd|pwd|token|secret|api[_-]?key)\\s*[:=]\\s*[''\"]?([^''\"\\s]+)', '\\1=***', 'g'), 'postgresql://[^:\\s]+:[^@\\s]+@', 'postgresql://***:***@', 'g')"

    @reg.add("masked_messages", f"SELECT event_id, {masked} AS message FROM events")
    def _(spark, sf):
        return _messages(spark, sf).select("event_id", text.mask_secrets(F.col("message")).alias("message"))

    @reg.add("masked_conversations", "SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)(password|passwd|pwd|token|secret|api[_-]?key)\\s*[:=]\\s*[''\"]?([^''\"\\s]+)', '\\1=***', 'g'), 'postgresql://[^:\\s]+:[^@\\s]+@', 'postgresql://***:***@', 'g') AS text FROM conversations")
    def _(spark, sf):
        return table(spark, sf, "conversations").select("conv_id", "turn", text.mask_secrets(F.col("text")).alias("text"))

    @reg.add("event_levels", f"SELECT event_id, {LEVEL_SQL} AS level FROM (SELECT event_id, lower('app' || chr(10) || {MESSAGE_SQL}) AS t FROM events)")
    def _(spark, sf):
        return _messages(spark, sf).select("event_id", text.event_level(F.col("message"), F.col("source")).alias("level"))

    fp = """substr(sha256('{"category": "' || event_type || '", "exception_type": "", "level": "' || level || '", "message": "' || message || '", "path": "", "source": "app"}'), 1, 16)"""
    recorded = f"WITH e AS (SELECT event_id, ts, event_type, user_id, {masked} AS message, lower('app' || chr(10) || {MESSAGE_SQL}) AS t FROM events), f AS (SELECT *, {LEVEL_SQL} AS level FROM e), g AS (SELECT *, {fp} AS fingerprint FROM f)"

    @reg.add("event_fingerprints", f"{recorded} SELECT event_id, level, message, fingerprint FROM g")
    def _(spark, sf):
        return ev.record_events(_messages(spark, sf)).select("event_id", "level", "message", "fingerprint")

    @reg.add(
        "duplicate_events",
        f"{recorded} SELECT fingerprint, count(*) AS count, min(event_id) AS first_seen, max(event_id) AS last_seen, arg_min(message, event_id) AS message, arg_min(level, event_id) AS level FROM g GROUP BY 1 HAVING count(*) >= 2",
    )
    def _(spark, sf):
        out = ev.duplicate_events(ev.record_events(_messages(spark, sf)), 2, order="event_id")
        return out.select("fingerprint", "count", "first_seen", "last_seen", "message", "level")

    @reg.add("error_findings", f"{recorded} SELECT event_id, level, message FROM g WHERE level = 'ERROR'")
    def _(spark, sf):
        return ev.error_findings(ev.record_events(_messages(spark, sf))).select("event_id", "level", "message")

    @reg.add(
        "event_summary",
        f"{recorded} SELECT CASE grouping(level) * 2 + grouping(event_type) WHEN 1 THEN 'level' WHEN 2 THEN 'category' ELSE 'all' END AS scope, coalesce(level, event_type, '') AS name, count(*) AS count, max(event_id) AS latest FROM g GROUP BY GROUPING SETS ((level), (event_type), ())",
    )
    def _(spark, sf):
        return ev.event_summary(ev.record_events(_messages(spark, sf)), order="event_id")

    @reg.add("normalized_fingerprints", f"SELECT event_id, 'app|' || event_type || '|' || regexp_replace(lower(trim({MESSAGE_SQL})), '\\d+', '<n>', 'g') AS fp FROM events")
    def _(spark, sf):
        m = _messages(spark, sf)
        return m.select("event_id", text.normalized_fingerprint(F.col("source"), F.col("category"), F.lit(None), F.col("message")).alias("fp"))

    @reg.add(
        "log_patterns",
        f"""WITH m AS (SELECT {MESSAGE_SQL} AS l FROM events) SELECT 0::BIGINT AS traceback, 0::BIGINT AS module_missing, 0::BIGINT AS db_auth,
        CAST(sum(len(regexp_extract_all(l, '(?i)timed?\\s*out|TimeoutError|not ready'))) AS BIGINT) AS timeout, 0::BIGINT AS exception FROM m""",
    )
    def _(spark, sf):
        return text.log_pattern_counts(_messages(spark, sf), "message")

    @reg.add("log_top_lines", f"SELECT event_id, {MESSAGE_SQL} AS message FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20")
    def _(spark, sf):
        return text.log_top_lines(_messages(spark, sf), "event_id", "message").select("event_id", "message")


def _json(reg) -> None:
    @reg.add("json_field", "SELECT event_id, coalesce(json_extract_string(props, '$.os'), json_extract_string(props, '$.k')) AS value FROM events")
    def _(spark, sf):
        return table(spark, sf, "events").select("event_id", jsonflat.field("props", "$.os", "$.k").alias("value"))

    doc = "'{\"a\":{\"b\":' || user_id || ',\"c\":{\"d\":\"x' || event_type || '\"}},\"nums\":[1,2,' || event_id || '],\"rows\":[{\"x\":1},{\"x\":' || user_id || '}],\"flag\":true}'"

    def nested(spark, sf):
        u, i, t = F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_type")
        body = F.concat(F.lit('{"a":{"b":'), u, F.lit(',"c":{"d":"x'), t, F.lit('"}},"nums":[1,2,'), i, F.lit('],"rows":[{"x":1},{"x":'), u, F.lit('}],"flag":true}'))
        return table(spark, sf, "events").select("event_id", body.alias("payload"))

    mean_sql = "(3.0 + event_id) / 3"
    std_sql = f"sqrt((pow(1 - {mean_sql}, 2) + pow(2 - {mean_sql}, 2) + pow(event_id - {mean_sql}, 2)) / 3)"

    def shown(out):
        """Texts, and statistics as numbers."""
        statistic = F.col("key").rlike("__(mean|std|min|max)__$")
        number = F.when(statistic, r(F.col("value").cast("double")))
        return out.select("event_id", "key", F.when(~statistic, F.col("value")).alias("value"), number.alias("number"))

    @reg.add(
        "json_flatten_report",
        f"""WITH d AS (SELECT event_id, user_id, event_type, {doc} AS p FROM events) SELECT event_id, unnest(['p.a.b', 'p.a.c.d', 'p.nums.__len__', 'p.rows.__len__', 'p.flag']) AS key,
        unnest([json_extract_string(p, '$.a.b'), json_extract_string(p, '$.a.c.d'), '3', '2', 'true']) AS value, CAST(NULL AS DOUBLE) AS number FROM d
        UNION ALL SELECT event_id, unnest(['p.nums.__mean__', 'p.nums.__std__']), NULL, unnest([round({mean_sql}, 6) + 0.0, round({std_sql}, 6) + 0.0]) FROM events""",
    )
    def _(spark, sf):
        return shown(jsonflat.flatten_json(nested(spark, sf), ["event_id"], "payload", "p"))

    @reg.add(
        "json_list_statistics",
        """SELECT event_id, round((3.0 + event_id) / 3, 6) + 0.0 AS mean, round(sqrt((pow(1 - (3.0 + event_id) / 3, 2) + pow(2 - (3.0 + event_id) / 3, 2) + pow(event_id - (3.0 + event_id) / 3, 2)) / 3), 6) + 0.0 AS std FROM events""",
    )
    def _(spark, sf):
        out = jsonflat.flatten_json(nested(spark, sf), ["event_id"], "payload", "p")
        num = F.col("value").cast("double")
        agg = out.where(F.col("key").rlike("__(mean|std)__")).groupBy("event_id").agg(
            F.max(F.when(F.col("key") == "p.nums.__mean__", num)).alias("mean"), F.max(F.when(F.col("key") == "p.nums.__std__", num)).alias("std")
        )
        return agg.select("event_id", r("mean").alias("mean"), r("std").alias("std"))

    @reg.add(
        "json_flatten_dashboard",
        f"""SELECT event_id, unnest(['root.a.b', 'root.a.c.d', 'root.nums.__len__', 'root.nums[0]', 'root.nums[1]', 'root.nums[2]', 'root.rows.__len__', 'root.rows[0].x', 'root.rows[1].x', 'root.flag']) AS key,
        unnest([CAST(user_id AS VARCHAR), 'x' || event_type, '3', '1', '2', CAST(event_id AS VARCHAR), '2', '1', CAST(user_id AS VARCHAR), 'true']) AS value, CAST(NULL AS DOUBLE) AS number FROM events
        UNION ALL SELECT event_id, unnest(['root.nums.__mean__', 'root.nums.__std__', 'root.nums.__min__', 'root.nums.__max__']), NULL,
        unnest([round({mean_sql}, 6) + 0.0, round({std_sql}, 6) + 0.0, CAST(least(1, event_id) AS DOUBLE), CAST(greatest(2, event_id) AS DOUBLE)]) FROM events""",
    )
    def _(spark, sf):
        return shown(jsonflat.flatten_json(nested(spark, sf), ["event_id"], "payload", "root", "dashboard"))

    @reg.add("json_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
    def _(spark, sf):
        e = table(spark, sf, "events")
        found = jsonflat.json_columns(e)
        out = jsonflat.flattened_columns(e, {c: c for c in found})
        return out.select("event_id", F.col("`props.k`").alias("k"))

    @reg.add("metric_entries", "SELECT event_id, 'k' AS metric, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events")
    def _(spark, sf):
        return jsonflat.metric_rows(table(spark, sf, "events"), ["event_id"], "props")

    @reg.add("analysis_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS depth FROM events")
    def _(spark, sf):
        out = jsonflat.analysis_columns(table(spark, sf, "events"), ["k"], ["depth"], "props", "props")
        return out.select("event_id", F.col("`metric.k`").alias("mae"), F.col("`param.depth`").alias("depth"))
