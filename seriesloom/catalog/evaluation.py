"""Forecast accuracy, drift, statistical tests, explanations, grids, reports and window streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, explain, forecast, grid, metrics, reports, stats
from ..operators.windows import prepare_dataset
from ..streaming import streams
from .views import FORECASTS_SQL, GAPPY_SQL, RUNS_SQL, SERIES, SERIES_SQL, TICKS, TICKS_SQL, chi2_sql, day, f_sql, forecasts, gappy, kolmogorov_sql, normal2_sql, r, runs, series, t2_sql, table, ticks

KEYS = ["loto", "unique_id"]
DAY_SQL = "strftime(ds, '%Y-%m-%d') AS ds"


def _rounded(df, names, n=6):
    return df.withColumns({c: r(F.col(f"`{c}`"), n) for c in names})


def register(reg) -> None:
    _metrics(reg)
    _drift(reg)
    _tests(reg)
    _explain(reg)
    _grids(reg)
    _reports(reg)
    _streams(reg)


METRICS = ["mae", "rmse", "mape", "smape"]
METRIC_SQL = """round(avg(abs(y - yhat)), 6) + 0.0 AS mae, round(sqrt(avg(pow(y - yhat, 2))), 6) + 0.0 AS rmse, round(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100, 6) + 0.0 AS mape,
  round(avg(CASE WHEN abs(y) + abs(yhat) <> 0 THEN abs(y - yhat) / ((abs(y) + abs(yhat)) / 2) END) * 100, 6) + 0.0 AS smape"""


def _metrics(reg) -> None:
    @reg.add("accuracy", f"WITH {FORECASTS_SQL} SELECT loto, count(yhat) AS n, {METRIC_SQL} FROM (SELECT * FROM forecasts WHERE yhat IS NOT NULL) GROUP BY 1")
    def _(spark, sf):
        return _rounded(metrics.accuracy(forecasts(spark, sf), by=["loto"]), METRICS)

    @reg.add(
        "accuracy_floor",
        f"""WITH {FORECASTS_SQL} SELECT loto, unique_id, count(yhat) AS n, round(avg(abs(yhat - y)), 6) + 0.0 AS "MAE", round(sqrt(avg(pow(yhat - y, 2))), 6) + 0.0 AS "RMSE",
        round(avg(abs(yhat - y) / abs(y)) * 100, 6) + 0.0 AS "MAPE(%)", round(avg(abs(yhat - y) / ((abs(y) + abs(yhat)) / 2)) * 100, 6) + 0.0 AS "sMAPE(%)" FROM forecasts GROUP BY 1, 2""",
    )
    def _(spark, sf):
        return _rounded(metrics.accuracy(forecasts(spark, sf), by=KEYS, floor=True), ["MAE", "RMSE", "MAPE(%)", "sMAPE(%)"])

    @reg.add(
        "step_accuracy",
        f"""WITH {FORECASTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds) AS step FROM forecasts),
        b AS (SELECT *, ((step - 1) // 100) * 100 + 1 AS step_from FROM s WHERE yhat IS NOT NULL)
        SELECT CAST(step_from AS BIGINT) AS step_from, CAST(least(step_from + 99, max(step)) AS BIGINT) AS step_to, count(*) AS n, {METRIC_SQL},
        CAST(step_from AS BIGINT) || '-' || CAST(least(step_from + 99, max(step)) AS BIGINT) AS step_label FROM b GROUP BY step_from""",
    )
    def _(spark, sf):
        return _rounded(metrics.step_accuracy(forecasts(spark, sf), SERIES, size=100), METRICS)

    @reg.add(
        "point_summary",
        f"""WITH {FORECASTS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds) AS rn FROM forecasts WHERE yhat IS NOT NULL)
        SELECT loto, unique_id, count(yhat) AS count, round(avg(yhat), 6) + 0.0 AS mean, round(stddev_samp(yhat), 6) + 0.0 AS std, round(sum(CASE WHEN rn <= 20 THEN yhat END), 6) + 0.0 AS head FROM s GROUP BY 1, 2""",
    )
    def _(spark, sf):
        out = metrics.point_summary(forecasts(spark, sf).where("yhat IS NOT NULL"), by=KEYS, first=20)
        out = out.withColumn("head", F.aggregate("sample", F.lit(0.0), lambda a, v: a + v)).drop("sample")
        return _rounded(out, ["mean", "std", "head"])

    @reg.add(
        "conformal_interval",
        f"""WITH {FORECASTS_SQL}, k AS (SELECT *, abs(y - yhat) AS a FROM forecasts WHERE yhat IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY loto ORDER BY a) - 1 AS p, count(*) OVER (PARTITION BY loto) AS c FROM k),
        q AS (SELECT loto, max(CASE WHEN p = ceil(round(0.9 * (c - 1), 9)) THEN a END) AS q FROM n GROUP BY 1)
        SELECT loto, 0.9::DOUBLE AS coverage_target, round(max(q), 6) + 0.0 AS quantile_abs_residual, round(avg(CASE WHEN y >= yhat - q AND y <= yhat + q THEN 1.0 ELSE 0.0 END), 2) + 0.0 AS empirical_coverage,
        round(avg((yhat + q) - (yhat - q)), 6) + 0.0 AS interval_width_mean FROM k JOIN q USING (loto) GROUP BY 1""",
    )
    def _(spark, sf):
        out = metrics.interval_summary(metrics.conformal_interval(forecasts(spark, sf), by=["loto"]), by=["loto"])
        return _rounded(out, ["quantile_abs_residual", "interval_width_mean"]).withColumn("empirical_coverage", r("empirical_coverage", 2))

    @reg.add(
        "residual_summary",
        f"WITH {FORECASTS_SQL} SELECT loto, unique_id, round(avg(y - yhat), 6) + 0.0 AS mean, round(stddev_samp(y - yhat), 6) + 0.0 AS std, round(avg(abs(y - yhat)), 6) + 0.0 AS mae, round(sqrt(avg(pow(y - yhat, 2))), 6) + 0.0 AS rmse FROM forecasts GROUP BY 1, 2",
    )
    def _(spark, sf):
        return _rounded(metrics.residual_summary(forecasts(spark, sf), by=KEYS), ["mean", "std", "mae", "rmse"])

    cols = {"l_quantity": 6, "l_extendedprice": 4, "l_discount": 6}
    one = "SELECT '{c}' AS metric, count({c}) AS count, round(avg({c}), {n}) + 0.0 AS mean, round(stddev_samp({c}), {n}) + 0.0 AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) + 0.0 AS q25, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q75 FROM lineitem"

    @reg.add("metric_summary", " UNION ALL ".join(one.format(c=c, n=4) for c in cols))
    def _(spark, sf):
        out = metrics.metric_summary(table(spark, sf, "lineitem"), list(cols))
        return _rounded(_rounded(out, ["mean", "std"], 4), ["q25", "median", "q75"])


def _drift(reg) -> None:
    cuts = ", ".join(f"quantile_cont(v, {i / 10}) AS e{i}" for i in range(11))
    names = "[" + ", ".join(f"e{i}" for i in range(11)) + "]"
    base = """{src}, ed AS (SELECT k, list_sort(list_distinct({names})) AS e FROM (SELECT k, {cuts} FROM d WHERE side = 0 GROUP BY 1)),
      b AS (SELECT d.k, side, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS bin FROM d JOIN ed USING (k) WHERE v >= e[1] AND v <= e[len(e)]),
      h AS (SELECT k, bin, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS r, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c FROM b GROUP BY 1, 2),
      p AS (SELECT k, greatest(r / greatest(sum(r) OVER (PARTITION BY k), 1), 1e-8) AS pr, greatest(c / greatest(sum(c) OVER (PARTITION BY k), 1), 1e-8) AS pc FROM h),
      ps AS (SELECT k, sum((pc - pr) * ln(pc / pr)) AS psi FROM p GROUP BY 1),
      vt AS (SELECT k, v, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS r, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS c FROM d GROUP BY 1, 2),
      cu AS (SELECT k, sum(r) OVER w / sum(r) OVER g AS fr, sum(c) OVER w / sum(c) OVER g AS fc FROM vt WINDOW w AS (PARTITION BY k ORDER BY v), g AS (PARTITION BY k)),
      ks AS (SELECT k, max(abs(fr - fc)) AS ks FROM cu GROUP BY 1),
      lv AS (SELECT k, count(*) FILTER (side = 0) AS reference_n, count(*) FILTER (side = 1) AS current_n, avg(CASE WHEN side = 0 THEN v END) AS rm, avg(CASE WHEN side = 1 THEN v END) AS cm FROM d GROUP BY 1)"""
    final = "round(rm, 6) + 0.0 AS reference_mean, round(cm, 6) + 0.0 AS current_mean, round(cm - rm, 6) + 0.0 AS mean_shift, "
    enough = f"CASE WHEN reference_n >= {drift.LEAST} AND current_n >= {drift.LEAST} THEN {{}} END"
    tail = kolmogorov_sql("ks * sqrt(CAST(reference_n AS DOUBLE) * current_n / (reference_n + current_n))")
    final += ", ".join(f"round({enough.format(e)}, 6) + 0.0 AS {n}" for e, n in (("psi", "psi"), ("ks", "ks_stat"), (tail, "ks_pvalue")))
    shown = ["reference_mean", "current_mean", "mean_shift", "psi", "ks_stat", "ks_pvalue"]

    @reg.add(
        "drift_by_group",
        base.format(src=f"WITH {TICKS_SQL}, d AS (SELECT loto AS k, y AS v, CASE WHEN day(ds) <= 15 THEN 0 ELSE 1 END AS side FROM ticks)", names=names, cuts=cuts)
        + f" SELECT k AS loto, reference_n, current_n, {final} FROM lv JOIN ps USING (k) JOIN ks USING (k)",
    )
    def _(spark, sf):
        t = ticks(spark, sf)
        out = drift.drift(t.where(F.dayofmonth("ds") <= 15), t.where(F.dayofmonth("ds") > 15), "y", ["loto"])
        return _rounded(out, shown).select("loto", "reference_n", "current_n", *shown)

    @reg.add(
        "drift_overall",
        base.format(src="WITH d AS (SELECT 1 AS k, l_quantity AS v, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 0 ELSE 1 END AS side FROM lineitem)", names=names, cuts=cuts)
        + f" SELECT reference_n, current_n, {final} FROM lv JOIN ps USING (k) JOIN ks USING (k)",
    )
    def _(spark, sf):
        li = table(spark, sf, "lineitem")
        old = F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp")
        out = drift.drift(li.where(old), li.where(~old), "l_quantity")
        return _rounded(out, shown).select("reference_n", "current_n", *shown)

    @reg.add(
        "latest_evaluation",
        "SELECT l_returnflag AS dataset_id, CAST(max(year(l_shipdate) * 100 + month(l_shipdate)) AS BIGINT) AS eval_id FROM lineitem GROUP BY 1",
    )
    def _(spark, sf):
        return drift.latest_evaluation(_evaluations(spark, sf).select("dataset_id", "created_at", "eval_id")).select("dataset_id", "eval_id")

    evaluated = """WITH li AS (SELECT l_returnflag AS ds, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS ev, l_quantity AS a, l_extendedprice / 2000 AS b FROM lineitem),
      ages AS (SELECT ds, ev, row_number() OVER (PARTITION BY ds ORDER BY ev DESC) AS age FROM (SELECT DISTINCT ds, ev FROM li)),
      d AS (SELECT [ds, m] AS k, v, CASE WHEN age = 2 THEN 0 ELSE 1 END AS side FROM (SELECT ds, ev, unnest(['y_true', 'y_pred', 'residual']) AS m, unnest([CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(a - b AS DOUBLE)]) AS v FROM li) JOIN ages USING (ds, ev) WHERE age <= 2)"""

    @reg.add("evaluation_drift", base.format(src=evaluated, names=names, cuts=cuts) + f" SELECT k[1] AS dataset_id, k[2] AS measure, reference_n, current_n, reference_n > 0 AND current_n > 0 AS ok, {final} FROM lv JOIN ps USING (k) JOIN ks USING (k)")
    def _(spark, sf):
        return _rounded(drift.evaluation_drift(_evaluations(spark, sf)), shown)


def _evaluations(spark, sf):
    """Line items as stored evaluations: one per return flag and quarter."""
    li = table(spark, sf, "lineitem")
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long")
    return li.select(
        F.col("l_returnflag").alias("dataset_id"), F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("created_at"), month.alias("eval_id"),
        F.col("l_quantity").alias("y_true"), (F.col("l_extendedprice") / 2000).alias("y_pred"), (F.col("l_quantity") - F.col("l_extendedprice") / 2000).alias("residual"),
    )


def _tests(reg) -> None:
    def ljung_sql(lags: int, digits: int, more: str = "") -> str:
        prods = ", ".join(f"sum((e - m) * (l{k} - m)) AS g{k}" for k in range(1, lags + 1))
        lagged = ", ".join(f"lag(e, {k}) OVER (PARTITION BY loto, unique_id ORDER BY ds) AS l{k}" for k in range(1, lags + 1))
        q = " + ".join(f"CASE WHEN n - 1 >= {k} THEN coalesce(pow(g{k} / g0, 2), 0) / nullif(n - {k}, 0) ELSE 0 END" for k in range(1, lags + 1))
        return f"""WITH {FORECASTS_SQL}, r AS (SELECT loto, unique_id, ds, y - yhat AS e FROM forecasts WHERE yhat IS NOT NULL), l AS (SELECT *, {lagged}, avg(e) OVER (PARTITION BY loto, unique_id) AS m FROM r),
        s AS (SELECT loto, unique_id, count(*) AS n, sum(pow(e - m, 2)) AS g0, {prods} FROM l GROUP BY 1, 2), q AS (SELECT *, CAST(least({lags}, n - 1) AS BIGINT) AS used, n * (n + 2) * ({q}) AS lb FROM s)
        SELECT loto, unique_id, n AS nobs, used AS lags_used, round(lb, {digits}) + 0.0 AS lb_stat{more} FROM q"""

    @reg.add("ljung_box", ljung_sql(10, 5))
    def _(spark, sf):
        f = forecasts(spark, sf).withColumn("e", F.col("y") - F.col("yhat"))
        out = stats.ljung_box(f, KEYS, ["ds"], "e", 10)
        return out.select(*KEYS, "nobs", "lags_used", r("lb_stat", 5).alias("lb_stat"))

    @reg.add("ljung_box_pvalues", ljung_sql(20, 5, f", round({chi2_sql('lb', 'used')}, 6) + 0.0 AS lb_pvalue"))
    def _(spark, sf):
        f = forecasts(spark, sf).withColumn("e", F.col("y") - F.col("yhat"))
        return _rounded(stats.ljung_box(f, KEYS, ["ds"], "e", 20), ["lb_pvalue"]).withColumn("lb_stat", r("lb_stat", 5))

    @reg.add("unit_root")
    def _(spark, sf):
        out = stats.adf(series(spark, sf), KEYS, ["ds"], "y")
        return _rounded(out, ["adf_stat", "pvalue", "crit_1", "crit_5", "crit_10"], 5)

    @reg.add("granger_screening")
    def _(spark, sf):
        out = stats.granger_screening(_features(spark, sf), SERIES, FEATURES, 4)
        return out.withColumn("min_pvalue", r("min_pvalue", 8))

    @reg.add(
        "granger_f",
        f"""WITH {SERIES_SQL}, x AS (SELECT *, lag(y, 1) OVER w AS y1, CAST(day(ds) AS DOUBLE) AS x, lag(CAST(day(ds) AS DOUBLE), 1) OVER w AS x1 FROM series WINDOW w AS (PARTITION BY loto, unique_id ORDER BY ds)),
        k AS (SELECT * FROM x WHERE y1 IS NOT NULL), c AS (SELECT count(*) AS n, corr(y, y1) AS ryy, corr(y, x1) AS ryx, corr(y1, x1) AS rxx FROM k)
        SELECT n AS nobs, round(((pow(ryy, 2) + pow(ryx, 2) - 2 * ryy * ryx * rxx) / (1 - pow(rxx, 2)) - pow(ryy, 2)) / ((1 - (pow(ryy, 2) + pow(ryx, 2) - 2 * ryy * ryx * rxx) / (1 - pow(rxx, 2))) / (n - 3)), 5) + 0.0 AS f_stat FROM c""",
    )
    def _(spark, sf):
        s = series(spark, sf).withColumn("x", F.dayofmonth("ds").cast("double"))
        return stats.granger(s, SERIES, ["x"], 1).select("nobs", r("f_stat", 5).alias("f_stat"))

    @reg.add(
        "diebold_mariano",
        f"""WITH {FORECASTS_SQL}, d AS (SELECT loto, pow(y - yhat, 2) - pow(y - ynaive, 2) AS d FROM forecasts WHERE yhat IS NOT NULL AND ynaive IS NOT NULL)
        SELECT loto, n, round(m, 6) + 0.0 AS mean_loss_diff, round(t, 6) + 0.0 AS dm_stat, round({normal2_sql("t")}, 6) + 0.0 AS pvalue FROM (SELECT loto, count(*) AS n, avg(d) AS m, avg(d) / sqrt(var_samp(d) / count(*)) AS t FROM d GROUP BY 1)""",
    )
    def _(spark, sf):
        out = stats.diebold_mariano(forecasts(spark, sf), "y", "yhat", "ynaive", by=["loto"])
        return _rounded(out, ["mean_loss_diff", "dm_stat", "pvalue"])

    @reg.add(
        "diebold_mariano_hac",
        f"""WITH {FORECASTS_SQL}, d AS (SELECT loto, unique_id, ds, pow(y - yhat, 2) - pow(y - ynaive, 2) AS d FROM forecasts WHERE yhat IS NOT NULL AND ynaive IS NOT NULL),
        l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, avg(d) OVER (PARTITION BY loto, unique_id) AS m FROM d WINDOW w AS (PARTITION BY loto, unique_id ORDER BY ds)),
        s AS (SELECT loto, unique_id, count(*) AS n, max(m) AS mean_d, sum(pow(d - m, 2)) + 2 * (2.0 / 3) * sum((d - m) * (d1 - m)) + 2 * (1.0 / 3) * sum((d - m) * (d2 - m)) AS v FROM l GROUP BY 1, 2)
        SELECT loto, unique_id, n, round(mean_d, 6) + 0.0 AS mean_d, round(t, 6) + 0.0 AS dm_t, round({normal2_sql("t")}, 6) + 0.0 AS dm_pvalue FROM (SELECT *, CASE WHEN v > 0 THEN mean_d / (sqrt(v) / n) END AS t FROM s)""",
    )
    def _(spark, sf):
        f = forecasts(spark, sf).withColumns({"e1": F.col("y") - F.col("yhat"), "e2": F.col("y") - F.col("ynaive")}).where("e1 IS NOT NULL AND e2 IS NOT NULL")
        out = stats.diebold_mariano_hac(f, "e1", "e2", ["ds"], h=3, by=KEYS)
        return _rounded(out, ["mean_d", "dm_t", "dm_pvalue"])

    @reg.add("permutation_test")
    def _(spark, sf):
        e = table(spark, sf, "events")
        out = stats.permutation_range(e, "event_type", "value", "event_id", n_iter=200)
        return out.select("n", "groups", r("observed").alias("observed"), r("pvalue").alias("pvalue"))

    @reg.add(
        "jarque_bera",
        """WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1),
        s AS (SELECT event_type, count(*) AS n, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS sk, avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) AS ku FROM events JOIN m USING (event_type) GROUP BY 1)
        SELECT event_type, n, round(sk, 6) + 0.0 AS skew, round(ku, 6) + 0.0 AS kurtosis, round(n / 6.0 * (sk * sk + pow(ku - 3, 2) / 4), 4) + 0.0 AS jb_stat, round(exp(-n / 12.0 * (sk * sk + pow(ku - 3, 2) / 4)), 6) + 0.0 AS pvalue,
        exp(-n / 12.0 * (sk * sk + pow(ku - 3, 2) / 4)) < 0.05 AS reject_normality FROM s""",
    )
    def _(spark, sf):
        out = stats.jarque_bera(table(spark, sf, "events"), "value", ["event_type"])
        return _rounded(out, ["skew", "kurtosis", "pvalue"]).withColumn("jb_stat", r("jb_stat", 4))

    ranks = """c AS (SELECT value, count(*) AS c, {extra} FROM e GROUP BY 1), rk AS (SELECT *, sum(c) OVER (ORDER BY value) - c + (c + 1) / 2.0 AS rank FROM c)"""

    @reg.add(
        "mann_whitney",
        "WITH e AS (SELECT round(value, 0) AS value, event_type FROM events WHERE event_type IN ('view', 'click')), "
        + ranks.format(extra="sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS a")
        + f""", s AS (SELECT sum(a * rank) AS r, sum(a) AS n1, sum(c) AS n, sum(pow(c, 3) - c) AS t FROM rk),
        u AS (SELECT *, n - n1 AS n2, r - n1 * (n1 + 1) / 2.0 AS u FROM s), z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n + 1 - t / (n * (n - 1)))) AS z FROM u)
        SELECT CAST(n1 AS BIGINT) AS n_a, CAST(n2 AS BIGINT) AS n_b, round(u, 2) + 0.0 AS u_stat, round(z, 6) + 0.0 AS z, round({normal2_sql("greatest(z, 0.0)")}, 6) + 0.0 AS pvalue FROM z""",
    )
    def _(spark, sf):
        e = table(spark, sf, "events").withColumn("value", F.round("value", 0))
        out = stats.mann_whitney(e, "event_type", "view", "click", "value")
        return out.select("n_a", "n_b", r("u_stat", 2).alias("u_stat"), r("z").alias("z"), r("pvalue").alias("pvalue"))

    @reg.add(
        "levene",
        f"""WITH e AS (SELECT event_type, value, quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS med FROM events), z AS (SELECT event_type, abs(value - med) AS z FROM e),
        g AS (SELECT event_type, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS w FROM z GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mm, sum(w) AS w FROM g)
        SELECT k AS groups, n, round(f, 6) + 0.0 AS stat, round({f_sql("f", "k - 1", "n - k")}, 6) + 0.0 AS pvalue FROM (SELECT k, CAST(t.n AS BIGINT) AS n, (t.n - k) / (k - 1) * (SELECT sum(n * pow(m - mm, 2)) FROM g) / w AS f FROM t)""",
    )
    def _(spark, sf):
        out = stats.levene(table(spark, sf, "events"), "event_type", "value")
        return out.select("groups", "n", r("stat").alias("stat"), r("pvalue").alias("pvalue"))

    @reg.add(
        "kruskal",
        "WITH e AS (SELECT round(value, 0) AS value, event_type FROM events), "
        + ranks.format(extra="1 AS one")
        + f""", g AS (SELECT event_type, count(*) AS n, sum(rank) AS r FROM e JOIN rk USING (value) GROUP BY 1), t AS (SELECT sum(c) AS n, sum(pow(c, 3) - c) AS t FROM rk),
        h AS (SELECT (SELECT count(*) FROM g) AS groups, CAST(n AS BIGINT) AS n, (12.0 / (n * (n + 1)) * (SELECT sum(r * r / n) FROM g) - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) AS h FROM t)
        SELECT groups, n, round(h, 5) + 0.0 AS stat, round({chi2_sql("h", "groups - 1")}, 6) + 0.0 AS pvalue FROM h""",
    )
    def _(spark, sf):
        out = stats.kruskal(table(spark, sf, "events").withColumn("value", F.round("value", 0)), "event_type", "value")
        return out.select("groups", "n", r("stat", 5).alias("stat"), r("pvalue").alias("pvalue"))

    @reg.add(
        "welch",
        f"""WITH s AS (SELECT count(*) FILTER (event_type = 'view') AS n_a, count(*) FILTER (event_type = 'click') AS n_b, avg(CASE WHEN event_type = 'view' THEN value END) AS mean_a, avg(CASE WHEN event_type = 'click' THEN value END) AS mean_b,
        var_samp(CASE WHEN event_type = 'view' THEN value END) AS va, var_samp(CASE WHEN event_type = 'click' THEN value END) AS vb FROM events)
        SELECT n_a, n_b, round(mean_a, 6) + 0.0 AS mean_a, round(mean_b, 6) + 0.0 AS mean_b, round((mean_a - mean_b) / sqrt(va / n_a + vb / n_b), 6) + 0.0 AS welch_t,
        round(pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)), 4) + 0.0 AS welch_df, round((mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) + 0.0 AS cohens_d,
        round({t2_sql("(mean_a - mean_b) / sqrt(va / n_a + vb / n_b)", "pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1))")}, 6) + 0.0 AS welch_pvalue FROM s""",
    )
    def _(spark, sf):
        out = stats.welch(table(spark, sf, "events"), "event_type", "view", "click", "value")
        return _rounded(out, ["mean_a", "mean_b", "welch_t", "cohens_d", "welch_pvalue"]).withColumn("welch_df", r("welch_df", 4))

    @reg.add("crosstab_failed", f"WITH {RUNS_SQL} SELECT model_name, count(*) FILTER (status <> 'failed') AS not_failed, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1")
    def _(spark, sf):
        return stats.crosstab(runs(spark, sf), "model_name", F.col("status") == "failed")

    chi = """, c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM runs GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS r FROM c GROUP BY 1), cb AS (SELECT b, sum(o) AS s FROM c GROUP BY 1),
      f AS (SELECT coalesce(o, 0) AS o, r * s / (SELECT sum(o) FROM c) AS e FROM ra CROSS JOIN cb LEFT JOIN c USING (a, b))"""

    @reg.add("chi_square", f"WITH {RUNS_SQL}{chi.format(a='model_name', b='status')} SELECT round(x, 6) + 0.0 AS chi2_stat, 8::BIGINT AS dof, n, round({chi2_sql('x', '8')}, 6) + 0.0 AS p_value FROM (SELECT sum(pow(o - e, 2) / e) AS x, CAST(sum(o) AS BIGINT) AS n FROM f)")
    def _(spark, sf):
        out = stats.chi_square(runs(spark, sf), "model_name", "status")
        return out.select(r("chi2_stat").alias("chi2_stat"), "dof", "n", r("p_value").alias("p_value"))

    yates = chi.format(a="CASE WHEN status = 'failed' THEN 1 ELSE 0 END", b="CASE WHEN app_name < '3' THEN 1 ELSE 0 END")

    @reg.add("chi_square_yates", f"WITH {RUNS_SQL}{yates} SELECT round(x, 6) + 0.0 AS chi2_stat, 1::BIGINT AS dof, n, round({chi2_sql('x', '1')}, 6) + 0.0 AS p_value FROM (SELECT sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS x, CAST(sum(o) AS BIGINT) AS n FROM f)")
    def _(spark, sf):
        x = runs(spark, sf).select((F.col("status") == "failed").cast("int").alias("a"), (F.col("app_name") < "3").cast("int").alias("b"))
        out = stats.chi_square(x, "a", "b")
        return out.select(r("chi2_stat").alias("chi2_stat"), "dof", "n", r("p_value").alias("p_value"))

    @reg.add(
        "rejection_summary",
        "SELECT 'l_discount' AS diagnostic, count(*) AS n, round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS rejection_rate, round(quantile_cont(l_discount, 0.5), 6) + 0.0 AS median_pvalue, 0.05::DOUBLE AS alpha FROM lineitem UNION ALL SELECT 'l_tax', count(*), round(avg(CASE WHEN l_tax < 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0, round(quantile_cont(l_tax, 0.5), 6) + 0.0, 0.05 FROM lineitem",
    )
    def _(spark, sf):
        return _rounded(stats.rejection_summary(table(spark, sf, "lineitem"), ["l_discount", "l_tax"]), ["rejection_rate", "median_pvalue"])


FEATURES = ["lag_1", "lag_7", "roll_mean_7"]


def _features(spark, sf):
    return prepare_dataset(series(spark, sf), SERIES)


FEATURES_SQL = SERIES_SQL + """, feats AS (SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7, CASE WHEN count(y) OVER p >= 7 THEN avg(y) OVER p END AS roll_mean_7 FROM series
  WINDOW w AS (PARTITION BY loto, unique_id ORDER BY ds), p AS (PARTITION BY loto, unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
  lf AS (SELECT loto, unique_id, ds, y, f AS feature, v FROM feats UNPIVOT INCLUDE NULLS (v FOR f IN (lag_1, lag_7, roll_mean_7))),
  md AS (SELECT feature, quantile_cont(v, 0.5) AS med FROM lf GROUP BY 1), lx AS (SELECT loto, unique_id, ds, y, feature, coalesce(v, med) AS x FROM lf JOIN md USING (feature))"""


def _explain(reg) -> None:
    @reg.add(
        "feature_correlations",
        f"""WITH {FEATURES_SQL}, rx AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM lx)
        SELECT feature, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(a, b), 6) + 0.0 AS spearman FROM rx GROUP BY 1""",
    )
    def _(spark, sf):
        return _rounded(explain.correlations(_features(spark, sf), FEATURES), ["pearson", "spearman"])

    @reg.add(
        "correlation_table",
        f"""WITH {RUNS_SQL}, l AS (SELECT f AS feature, CAST(v AS DOUBLE) AS x, duration_sec AS y FROM (SELECT duration_sec, CAST(rows_written AS DOUBLE) AS rows_written, CAST(rows_failed AS DOUBLE) AS rows_failed FROM runs) UNPIVOT (v FOR f IN (rows_written, rows_failed))),
        k AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
        rx AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM k)
        SELECT feature, count(*) AS n, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(a, b), 6) + 0.0 AS spearman FROM rx GROUP BY 1""",
    )
    def _(spark, sf):
        return _rounded(explain.correlation_table(runs(spark, sf), ["rows_written", "rows_failed"], "duration_sec"), ["pearson", "spearman"])

    lags = " UNION ALL ".join(f"SELECT feature, {k} AS lag, round(corr({'x' if k == 0 else f'x{k}'}, y), 6) + 0.0 AS corr FROM g GROUP BY 1" for k in range(8))
    lagged = ", ".join(f"lag(x, {k}) OVER w AS x{k}" for k in range(1, 8))

    @reg.add("lag_correlations", f"WITH {FEATURES_SQL}, g AS (SELECT *, {lagged} FROM lx WINDOW w AS (PARTITION BY feature, loto, unique_id ORDER BY ds)) {lags}")
    def _(spark, sf):
        return _rounded(explain.lag_correlations(_features(spark, sf), FEATURES, SERIES.keys, ["ds"]), ["corr"])

    @reg.add(
        "mutual_information",
        f"""WITH {FEATURES_SQL}, s AS (SELECT feature, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lx GROUP BY 1),
        c AS (SELECT feature, least(floor((x - x0) / ((x1 - x0) / 16)), 15) AS i, least(floor((y - y0) / ((y1 - y0) / 16)), 15) AS j, count(*) AS c FROM lx JOIN s USING (feature) GROUP BY 1, 2, 3),
        m AS (SELECT feature, c::DOUBLE AS c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, i) AS ci, sum(c) OVER (PARTITION BY feature, j) AS cj FROM c)
        SELECT feature, round(sum(c / n * ln(c * n / (ci * cj))), 6) + 0.0 AS mutual_info FROM m GROUP BY 1""",
    )
    def _(spark, sf):
        return _rounded(explain.mutual_information(_features(spark, sf), FEATURES), ["mutual_info"])

    @reg.add(
        "attribution_summary",
        f"""WITH {FEATURES_SQL}, s AS (SELECT feature, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lx GROUP BY 1),
        c AS (SELECT feature, least(floor((x - x0) / ((x1 - x0) / 16)), 15) AS i, least(floor((y - y0) / ((y1 - y0) / 16)), 15) AS j, count(*) AS c FROM lx JOIN s USING (feature) GROUP BY 1, 2, 3),
        m AS (SELECT feature, c::DOUBLE AS c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, i) AS ci, sum(c) OVER (PARTITION BY feature, j) AS cj FROM c),
        mi AS (SELECT feature, sum(c / n * ln(c * n / (ci * cj))) AS score FROM m GROUP BY 1), sg AS (SELECT feature, corr(x, y) AS p FROM lx GROUP BY 1),
        g AS (SELECT *, {lagged} FROM lx WINDOW w AS (PARTITION BY feature, loto, unique_id ORDER BY ds)), lg AS ({lags}),
        b AS (SELECT feature, lag FROM lg QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(corr) DESC, lag) = 1)
        SELECT feature, round(score, 6) + 0.0 AS score, 'mutual_info' AS source, CASE WHEN p >= 0 THEN 'positive' ELSE 'negative' END AS direction, lag AS best_lag FROM mi JOIN sg USING (feature) JOIN b USING (feature)""",
    )
    def _(spark, sf):
        f = _features(spark, sf)
        out = explain.attribution_summary(explain.correlations(f, FEATURES), explain.lag_correlations(f, FEATURES, SERIES.keys, ["ds"]), explain.mutual_information(f, FEATURES))
        return _rounded(out, ["score"])

    @reg.add(
        "what_if",
        f"""WITH {FEATURES_SQL}, p AS (SELECT f.*, 0.6 * lag_1 + 0.4 * coalesce(roll_mean_7, lag_1) AS yhat FROM feats f), l AS (SELECT f AS feature, v AS x, yhat AS y FROM p UNPIVOT (v FOR f IN (lag_1, lag_7, roll_mean_7)) WHERE yhat IS NOT NULL),
        s AS (SELECT feature, regr_slope(y, x) AS slope, avg(x) AS m FROM l GROUP BY 1)
        SELECT feature || '+5%' AS name, feature, round(m * 0.05, 6) + 0.0 AS delta_x, round(slope * m * 0.05, 6) + 0.0 AS estimated_delta_y, round(slope, 6) + 0.0 AS slope FROM s""",
    )
    def _(spark, sf):
        return _rounded(explain.what_if(_predicted(_features(spark, sf)), FEATURES), ["delta_x", "estimated_delta_y", "slope"])

    @reg.add(
        "what_if_scenarios",
        f"""WITH {FEATURES_SQL}, p AS (SELECT f.*, 0.6 * lag_1 + 0.4 * coalesce(roll_mean_7, lag_1) AS yhat FROM feats f), l AS (SELECT f AS feature, v AS x, yhat AS y FROM p UNPIVOT (v FOR f IN (lag_1, lag_7)) WHERE yhat IS NOT NULL),
        s AS (SELECT feature, regr_slope(y, x) AS slope, avg(x) AS m FROM l GROUP BY 1), d AS (SELECT *, CASE feature WHEN 'lag_1' THEN 0.5 ELSE m * (1.2 - 1.0) END AS d FROM s)
        SELECT CASE feature WHEN 'lag_1' THEN 'up' ELSE 'lag_7_scenario' END AS name, feature, round(d, 6) + 0.0 AS delta_x, round(slope * d, 6) + 0.0 AS estimated_delta_y, round(slope, 6) + 0.0 AS slope FROM d""",
    )
    def _(spark, sf):
        cases = [{"name": "up", "feature": "lag_1", "delta": 0.5}, {"feature": "lag_7", "multiplier": 1.2}]
        return _rounded(explain.what_if(_predicted(_features(spark, sf)), FEATURES, scenarios=cases), ["delta_x", "estimated_delta_y", "slope"])

    @reg.add("permutation_importance")
    def _(spark, sf):
        f = _features(spark, sf).withColumn("row_id", F.concat_ws("|", *KEYS, "ds"))
        out = explain.permutation_importance(f, ["lag_1", "lag_7"], _predicted, "row_id", repeats=2)
        return _rounded(out, ["delta_mae_mean", "delta_mae_std", "base_mae"])

    @reg.add("parameter_impact")
    def _(spark, sf):
        x = runs(spark, sf).select("run_id", "duration_sec", F.col("app_name").alias("params.app"), F.col("model_name").alias("params.model"))
        x = x.withColumnsRenamed({"params.app": "app", "params.model": "model"})
        out = explain.parameter_impact(x, ["app", "model"], "duration_sec", "run_id", n_iter=100)
        return _rounded(out, ["best_mean", "worst_mean", "effect_abs", "permutation_pvalue", "pearson_corr_numeric"])

    @reg.add(
        "parameter_effects",
        """WITH l AS (SELECT 'l_returnflag' AS parameter, l_returnflag AS value, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_extendedprice FROM lineitem),
        m AS (SELECT parameter, value, avg(y) AS m, count(*) AS c FROM l GROUP BY 1, 2), e AS (SELECT parameter, max(m) - min(m) AS effect_abs, CAST(sum(c) AS BIGINT) AS sample_size, arg_min(value, m) AS best_value, arg_max(value, m) AS worst_value FROM m GROUP BY 1)
        SELECT parameter, sample_size, best_value, worst_value, round(effect_abs, 4) + 0.0 AS effect_abs, round(effect_abs / sum(effect_abs) OVER (), 6) + 0.0 AS contribution_rate FROM e""",
    )
    def _(spark, sf):
        li = table(spark, sf, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
        out = explain.contribution_rates(explain.parameter_impact(li, ["l_returnflag", "l_linenumber"], "l_extendedprice", "id", n_iter=50))
        return out.select("parameter", "sample_size", "best_value", "worst_value", r("effect_abs", 4).alias("effect_abs"), r("contribution_rate").alias("contribution_rate"))

    @reg.add("subset_r2")
    def _(spark, sf):
        return _rounded(explain.subset_r2(_features(spark, sf).na.drop(subset=FEATURES), "y", [*FEATURES, "loto"], ["loto"]), ["r2"])

    @reg.add("single_r2", f"WITH {FEATURES_SQL} SELECT 'lag_1' AS features, 1 AS columns, round(regr_r2(y, lag_1), 6) + 0.0 AS r2 FROM feats")
    def _(spark, sf):
        return _rounded(explain.subset_r2(_features(spark, sf).na.drop(subset=["lag_1"]), "y", ["lag_1"]), ["r2"])

    # within each lottery for the joint regression, over all rows for the others
    within = """, f AS (SELECT loto, y, lag_1 FROM feats WHERE lag_1 IS NOT NULL), c AS (SELECT y - avg(y) OVER (PARTITION BY loto) AS wy, lag_1 - avg(lag_1) OVER (PARTITION BY loto) AS wx, y - avg(y) OVER () AS ty, lag_1 - avg(lag_1) OVER () AS tx, loto FROM f),
      s AS (SELECT sum(ty * ty) AS t, sum(wy * wy) AS w, sum(wx * wy) AS wxy, sum(wx * wx) AS wxx, sum(tx * ty) AS txy, sum(tx * tx) AS txx, CAST(count(DISTINCT loto) AS INT) AS k FROM c)"""

    @reg.add(
        "category_r2",
        f"""WITH {FEATURES_SQL}{within} SELECT unnest(['lag_1', 'loto', 'lag_1,loto']) AS features, unnest([1, k - 1, k]) AS columns, unnest([round(txy * txy / txx / t, 6) + 0.0, round(1 - w / t, 6) + 0.0, round(1 - (w - wxy * wxy / wxx) / t, 6) + 0.0]) AS r2 FROM s""",
    )
    def _(spark, sf):
        return _rounded(explain.subset_r2(_features(spark, sf).na.drop(subset=["lag_1"]), "y", ["lag_1", "loto"], ["loto"]), ["r2"])

    @reg.add("shapley_r2")
    def _(spark, sf):
        return _rounded(explain.shapley_r2(_features(spark, sf).na.drop(subset=FEATURES), "y", [*FEATURES, "loto"], ["loto"]), ["shapley_r2_contrib", "shapley_rate"])

    effect = f"""WITH {RUNS_SQL}, f AS (SELECT duration_sec AS y, rows_written, CAST(rows_failed AS DOUBLE) AS x, model_name AS g FROM runs WHERE duration_sec IS NOT NULL), m AS (SELECT quantile_cont(rows_written, 0.5) AS med FROM f),
      t AS (SELECT y, x, g, CASE WHEN rows_written >= med THEN 1.0 ELSE 0.0 END AS t FROM f, m),
      w AS (SELECT y - avg(y) OVER p AS y, x - avg(x) OVER p AS x, t - avg(t) OVER p AS t, g FROM t WINDOW p AS (PARTITION BY g)),
      s AS (SELECT count(*) AS n, count(DISTINCT g) AS k, sum(t * t) AS tt, sum(t * x) AS tx, sum(x * x) AS xx, sum(t * y) AS ty, sum(x * y) AS xy, sum(y * y) AS yy FROM w),
      b AS (SELECT *, (ty * xx - xy * tx) / (tt * xx - tx * tx) AS bt, (xy * tt - ty * tx) / (tt * xx - tx * tx) AS bx FROM s),
      e AS (SELECT *, sqrt((yy - bt * ty - bx * xy) / (n - 2 - k) * xx / (tt * xx - tx * tx)) AS se FROM b)
      SELECT true AS ok, n, 'rows_written' AS treatment_col, round(bt, 6) + 0.0 AS ate_proxy, round(se, 6) + 0.0 AS std_error, round(bt / se, 6) + 0.0 AS z_score, round(bt - 1.96 * se, 6) + 0.0 AS ci_low_95, round(bt + 1.96 * se, 6) + 0.0 AS ci_high_95 FROM e"""

    @reg.add("proxy_effect", effect)
    def _(spark, sf):
        out = explain.proxy_effect(runs(spark, sf).na.drop(subset=["duration_sec"]), "duration_sec", "rows_written", ["rows_failed"], ["model_name"])
        return _rounded(out, ["ate_proxy", "std_error", "z_score", "ci_low_95", "ci_high_95"])

    @reg.add("causal_hints")
    def _(spark, sf):
        out = explain.causal_hints(runs(spark, sf).na.drop(subset=["duration_sec"]), "duration_sec", ["rows_written", "rows_failed"], ["rows_failed"], ["model_name", "status"])
        return _rounded(out, ["std_coef", "pvalue", "ci_low_95", "ci_high_95", "abs_std_coef"])

    @reg.add("forest_contribution")
    def _(spark, sf):
        x = runs(spark, sf).na.drop(subset=["duration_sec"])
        out = explain.forest_contribution(x, "duration_sec", ["rows_written", "rows_failed"], ["status"], "run_id", trees=10, repeats=1)
        return out.select("feature", r("importance_mean", 3).alias("importance_mean"), r("contribution_rate", 3).alias("contribution_rate"), "n_train", "n_test")


def _predicted(df):
    """A fixed blend of two features stands for a fitted model."""
    return df.withColumn("yhat", 0.6 * F.col("lag_1") + 0.4 * F.coalesce("roll_mean_7", "lag_1"))


def _task_events(spark, sf):
    """Events as task states: the task is the user, the state follows the event type."""
    t = F.col("event_type")
    status = F.when(t == "purchase", "success").when(t == "error", "failed").otherwise("running")
    return table(spark, sf, "events").select(F.lit("g").alias("grid_id"), F.col("user_id").alias("task_id"), status.alias("status"), F.col("ts").alias("event_ts"))


def _results(spark, sf):
    """Orders as finished runs with parameter, metric and diagnostic JSON."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    params = F.concat(F.lit('{"alpha": '), (k % 3).cast("string"), F.lit(', "horizon": '), (k % 4).cast("string"), F.lit("}"))
    metrics_ = F.concat(F.lit('{"mae": '), (F.col("o_totalprice") / 1000).cast("string"), F.lit("}"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "Success").otherwise("running")
    return o.select(
        k.alias("run_id"), (k % 50).alias("config_id"), F.col("o_orderpriority").alias("model_name"), (k % 4).cast("int").alias("horizon"), status.alias("status"),
        F.when(k % 5 == 0, "late").otherwise(" ").alias("error_message"), params.alias("params_json"), metrics_.alias("metrics_json"), F.lit("{}").alias("diagnostics_json"),
        (k % 5).cast("string").alias("cfg_horizon"), F.col("o_orderdate").alias("created_at"),
    )


RESULTS_SQL = """results AS (SELECT o_orderkey AS run_id, o_orderkey % 50 AS config_id, o_orderpriority AS model_name, CAST(o_orderkey % 4 AS INTEGER) AS horizon,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'Success' ELSE 'running' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'late' ELSE ' ' END AS error_message,
  '{"alpha": ' || o_orderkey % 3 || ', "horizon": ' || o_orderkey % 4 || '}' AS params_json, o_totalprice / 1000 AS mae, CAST(o_orderkey % 5 AS VARCHAR) AS cfg_horizon, o_orderdate AS created_at FROM orders)"""
SIGNATURE_SQL = """sha1('{"horizon": ' || greatest(horizon, 1) || ', "model_name": "' || model_name || '", "params_json": ' || params_json || '}')"""


def _grids(reg) -> None:
    @reg.add("naive_forecast", f"""WITH {TICKS_SQL}, l AS (SELECT loto, unique_id, max(ds) AS last, arg_max(y, row_id) AS yhat FROM ticks GROUP BY 1, 2)
        SELECT loto, unique_id, strftime(last + to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS ds, round(yhat, 6) + 0.0 AS yhat FROM l, range(1, 4) t(k)""")
    def _(spark, sf):
        out = forecast.naive_last(ticks(spark, sf), TICKS, 3)
        return out.select(*KEYS, day("ds").alias("ds"), r("yhat").alias("yhat"))

    @reg.add("window_mean_forecast", f"""WITH {GAPPY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds DESC) AS rn FROM gappy WHERE y IS NOT NULL), e AS (SELECT loto, unique_id, max(ds) AS last FROM gappy GROUP BY 1, 2),
        m AS (SELECT loto, unique_id, avg(y) AS yhat FROM k WHERE rn <= 7 GROUP BY 1, 2)
        SELECT loto, unique_id, strftime(last + to_days(CAST(s AS INTEGER)), '%Y-%m-%d') AS ds, CAST(s AS INTEGER) AS step, round(yhat, 6) + 0.0 AS yhat FROM m JOIN e USING (loto, unique_id), range(1, 4) t(s)""")
    def _(spark, sf):
        out = forecast.forecast(gappy(spark, sf), SERIES, "window_mean", 3)
        return out.select(*KEYS, day("ds").alias("ds"), "step", r("yhat").alias("yhat"))

    cv = f"""WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY loto, unique_id) AS n, avg(y) OVER (PARTITION BY loto, unique_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS wm
        FROM series WINDOW w AS (PARTITION BY loto, unique_id ORDER BY ds)), c AS (SELECT * FROM n WHERE (n - p) >= 5 AND (n - p - 5) % 5 = 0 AND (n - p - 5) // 5 < 3)
        SELECT c.loto, c.unique_id, strftime(c.ds, '%Y-%m-%d') AS cutoff, strftime(f.ds, '%Y-%m-%d') AS ds, CAST(f.p - c.p AS INTEGER) AS step, round(f.y, 6) + 0.0 AS y, round(c.y, 6) + 0.0 AS naive, round(c.wm, 6) + 0.0 AS window_mean
        FROM c JOIN n f ON c.loto = f.loto AND c.unique_id = f.unique_id AND f.p > c.p AND f.p <= c.p + 5"""

    @reg.add("cross_validation", cv)
    def _(spark, sf):
        out = forecast.cross_validation(series(spark, sf), SERIES, {"naive": None, "window_mean": {"window": 7}}, 5, windows=3)
        return out.select(*KEYS, day("cutoff").alias("cutoff"), day("ds").alias("ds"), "step", *[r(c).alias(c) for c in ("y", "naive", "window_mean")])

    @reg.add("holdout_evaluation")
    def _(spark, sf):
        rows = forecast.cross_validation(series(spark, sf), SERIES, {"autoregression": None}, 28)
        parts = forecast.evaluation(rows.withColumnRenamed("autoregression", "yhat"), SERIES, step_size=7)
        out = parts["metrics"].select(F.lit("all").alias("step_label"), "n", *METRICS)
        return _rounded(out.unionByName(parts["steps"].select("step_label", "n", *METRICS)), METRICS)

    @reg.add("holdout_against_naive")
    def _(spark, sf):
        rows = forecast.holdout_by_position(series(spark, sf), SERIES, "autoregression", 28)
        out = forecast.compare_with_naive(rows, SERIES, "autoregression", by=KEYS)
        return _rounded(out, [c for c in out.columns if c not in (*KEYS, "n")])

    @reg.add("holdout_by_time", f"""WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds DESC) AS rn FROM series), t AS (SELECT loto, unique_id, max(ds) AS last, arg_max(y, ds) AS yhat FROM n WHERE rn > 14 GROUP BY 1, 2)
        SELECT s.loto, s.unique_id, strftime(s.ds, '%Y-%m-%d') AS ds, round(s.y, 6) + 0.0 AS y, round(t.yhat, 6) + 0.0 AS yhat FROM series s JOIN t ON s.loto = t.loto AND s.unique_id = t.unique_id AND s.ds > t.last AND s.ds <= t.last + INTERVAL 14 DAY""")
    def _(spark, sf):
        out = forecast.holdout(series(spark, sf), SERIES, "naive", 14)
        return out.select(*KEYS, day("ds").alias("ds"), r("y").alias("y"), r("yhat").alias("yhat"))

    @reg.add(
        "grid_over_series",
        f"""WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds DESC) AS rn FROM series),
        t AS (SELECT * FROM (VALUES (2, 'window_mean', 7), (3, 'window_mean', 14), (4, 'smoothing', 7), (5, 'smoothing', 14)) v(k, m, w)),
        g AS (SELECT loto, unique_id, ts_type, k, m, sum(y * CASE WHEN m = 'window_mean' THEN 1.0 / w WHEN rn - 14 = w THEN pow(0.7, w - 1) ELSE 0.3 * pow(0.7, rn - 15) END) AS yhat FROM n, t WHERE rn BETWEEN 15 AND 14 + w GROUP BY ALL),
        p AS (SELECT g.*, n.y FROM g JOIN n USING (loto, unique_id, ts_type) WHERE rn <= 14),
        b AS (SELECT * FROM (VALUES (0, 'naive', 'ValueError: unknown parameters for naive: [''window'']'), (1, 'naive', 'ValueError: unknown parameters for naive: [''window'']'), (6, 'nosuch', 'ValueError: unknown model: nosuch'), (7, 'nosuch', 'ValueError: unknown model: nosuch')) v(k, m, e))
        SELECT loto, unique_id, ts_type, CAST(k AS BIGINT) AS task_order, m AS model_name, 'success' AS status, NULL::VARCHAR AS error_message, count(*) AS n, {METRIC_SQL} FROM p GROUP BY loto, unique_id, ts_type, k, m
        UNION ALL SELECT loto, unique_id, ts_type, k, m, 'failed', e, 0, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT loto, unique_id, ts_type FROM series), b""",
    )
    def _(spark, sf):
        space = {"model": ["naive", "window_mean", "smoothing", "nosuch"], "window": [7, 14]}
        out = grid.run_grid(series(spark, sf), SERIES, grid.expand_grid(spark, space), 14)
        return _rounded(out, METRICS)

    @reg.add("grid_ranking", f"""WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds DESC) AS rn FROM series), l AS (SELECT loto, unique_id, max(CASE WHEN rn = 15 THEN y END) AS last, avg(CASE WHEN rn > 14 AND rn <= 21 THEN y END) AS m7 FROM n GROUP BY 1, 2),
        e AS (SELECT n.loto, n.unique_id, avg(abs(y - last)) AS a, avg(abs(y - m7)) AS b FROM n JOIN l USING (loto, unique_id) WHERE rn <= 14 GROUP BY 1, 2)
        SELECT 0::BIGINT AS task_order, 'naive' AS model_name, count(*) AS succeeded, 0::BIGINT AS failed, round(avg(a), 6) + 0.0 AS mae FROM e UNION ALL SELECT 1, 'window_mean', count(*), 0, round(avg(b), 6) + 0.0 FROM e""")
    def _(spark, sf):
        tasks = grid.expand_grid(spark, {"model": ["naive", "window_mean"]})
        return _rounded(grid.rank_tasks(grid.run_grid(series(spark, sf), SERIES, tasks, 14)), ["mae"])

    axes_sql = """WITH a AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT l_linenumber AS v FROM lineitem)), b AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem)),
      c AS (SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
      SELECT CAST((a.i * (SELECT count(*) FROM b) + b.i) * (SELECT count(*) FROM c) + c.i AS BIGINT) AS task_order, '{"line": ' || a.v || ', "mark": "' || b.v || '", "urgency": "' || c.v || '"}' AS params FROM a, b, c"""

    @reg.add("grid_expansion", axes_sql)
    def _(spark, sf):
        def values(name, column):
            return sorted(x[0] for x in table(spark, sf, name).select(column).distinct().collect())

        return grid.expand_grid(spark, {"line": values("lineitem", "l_linenumber"), "mark": values("lineitem", "l_returnflag"), "urgency": values("orders", "o_orderpriority")})

    # Every order proposes a training combination; its columns decide which checks it meets.
    combos_sql = """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'AutoHINT' ELSE 'AutoNHITS' END AS model, CASE WHEN o_orderstatus = 'F' THEN 'ray' ELSE 'optuna' END AS backend,
        CASE WHEN o_orderpriority < '4' THEN 'TPESampler' ELSE 'HyperOptSearch' END AS search, CASE WHEN month(o_orderdate) < 4 THEN 'csv' ELSE 'db_table' END AS method, day(o_orderdate) AS v, year(o_orderdate) AS c FROM orders),
      r AS (SELECT *, CASE WHEN model = 'AutoHINT' AND backend <> 'ray' THEN 'model_backend_requirement' WHEN (backend = 'ray') <> (search = 'HyperOptSearch') THEN 'backend_search_mismatch'
        WHEN method = 'csv' THEN 'missing_dataset_path' WHEN v < 14 THEN 'fit_val_size_too_small' END AS reason FROM p),
      d AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY model, backend, search, method, v, c ORDER BY k) > 1 THEN 'duplicate_combination' ELSE reason END AS why FROM r)
      SELECT why AS reason, count(*) AS count FROM d WHERE why IS NOT NULL GROUP BY 1"""

    @reg.add("combination_checks", combos_sql)
    def _(spark, sf):
        o = table(spark, sf, "orders")
        body = F.struct(
            F.when(F.col("o_orderstatus") == "F", "ray").otherwise("optuna").alias("backend"), F.year("o_orderdate").alias("campaign"),
            F.when(F.month("o_orderdate") < 4, "csv").otherwise("db_table").alias("dataset_input_method"), F.dayofmonth("o_orderdate").alias("fit_val_size"), F.lit(14).alias("horizon"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "AutoHINT").otherwise("AutoNHITS").alias("model"),
            F.when(F.col("o_orderpriority") < "4", "TPESampler").otherwise("HyperOptSearch").alias("search_alg"),
        )
        proposals = o.select(F.col("o_orderkey").alias("task_order"), F.to_json(body).alias("params"))
        return grid.reason_counts(grid.evaluate_combinations(proposals, {"dataset_table": "series"})).drop("parameters")

    @reg.add("combo_signatures", f"WITH {RESULTS_SQL} SELECT run_id, {SIGNATURE_SQL} AS signature FROM results")
    def _(spark, sf):
        return _results(spark, sf).select("run_id", grid.combo_signature(F.col("model_name"), F.col("horizon"), F.col("params_json")).alias("signature"))

    @reg.add("unfinished_combos", f"""WITH {RESULTS_SQL}, s AS (SELECT *, {SIGNATURE_SQL} AS signature FROM results), d AS (SELECT DISTINCT signature FROM s WHERE lower(status) = 'success' AND trim(error_message) = '' AND model_name < '3')
        SELECT run_id FROM s WHERE signature NOT IN (SELECT signature FROM d)""")
    def _(spark, sf):
        x = _results(spark, sf).withColumn("signature", grid.combo_signature(F.col("model_name"), F.col("horizon"), F.col("params_json")))
        return grid.skip_done(x, grid.succeeded_signatures(_results(spark, sf).where("model_name < '3'"))).select("run_id")

    @reg.add("unfinished_by_prefix", f"""WITH {RESULTS_SQL}, s AS (SELECT *, {SIGNATURE_SQL} AS signature FROM results), d AS (SELECT DISTINCT left(signature, 10) AS p FROM s WHERE model_name > '4')
        SELECT run_id FROM s WHERE left(signature, 10) NOT IN (SELECT p FROM d)""")
    def _(spark, sf):
        x = _results(spark, sf).withColumn("signature", grid.combo_signature(F.col("model_name"), F.col("horizon"), F.col("params_json")))
        done = x.where("model_name > '4'").select(F.concat(F.lit("run_x_"), "signature").alias("run_id"))
        return grid.skip_prefix_done(x, done).select("run_id")

    @reg.add("seeded_rounds", "SELECT p_partkey, d AS depth, 42 + 10 * d AS seed FROM part, range(0, 3) t(d)")
    def _(spark, sf):
        out = grid.seeded_rounds(table(spark, sf, "part").select("p_partkey"), 3, 42, 10)
        return out.select("p_partkey", F.col("depth").cast("long").alias("depth"), F.col("seed").cast("long").alias("seed"))

    state = """WITH l AS (SELECT user_id AS task_id, arg_max(CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'running' END, ts) AS s FROM events GROUP BY 1)
        SELECT 'g' AS grid_id, coalesce(s, 'pending') AS status, count(*) AS n FROM (SELECT c_custkey AS task_id FROM customer) t LEFT JOIN l USING (task_id) GROUP BY 2"""

    @reg.add("task_status", state)
    def _(spark, sf):
        tasks = table(spark, sf, "customer").select(F.lit("g").alias("grid_id"), F.col("c_custkey").alias("task_id"))
        return grid.status_counts(grid.task_status(tasks, _task_events(spark, sf)))


def _reports(reg) -> None:
    @reg.add("report_overview", f"WITH {RESULTS_SQL} SELECT count(*) AS rows, 11 AS columns, count(DISTINCT config_id) AS config_count, count(DISTINCT run_id) AS run_count, count(DISTINCT model_name) AS model_count, strftime(min(created_at), '%Y-%m-%d') AS created_at_min, strftime(max(created_at), '%Y-%m-%d') AS created_at_max FROM results")
    def _(spark, sf):
        out = reports.overview(_results(spark, sf))
        return out.withColumns({c: day(c) for c in ("created_at_min", "created_at_max")})

    @reg.add("report_status", f"WITH {RESULTS_SQL} SELECT status, count(*) AS n FROM results GROUP BY 1")
    def _(spark, sf):
        return reports.status_table(_results(spark, sf))

    @reg.add("flattened_results", f"""WITH {RESULTS_SQL} SELECT run_id, CAST(run_id % 3 AS VARCHAR) AS alpha, round(mae, 6) + 0.0 AS mae FROM results""")
    def _(spark, sf):
        flat = reports.flatten_results(_results(spark, sf))
        return flat.select("run_id", F.col("`params.alpha`").alias("alpha"), r(F.col("`metrics.mae`").cast("double")).alias("mae"))

    refl = f"""WITH {RESULTS_SQL}, c AS (SELECT *, CAST(cfg_horizon AS INTEGER) = horizon AS ok FROM results)
        SELECT 'horizon' AS parameter, count(*) AS compared_rows, count(*) FILTER (ok) AS matched_rows, count(*) FILTER (NOT ok) AS mismatched_rows, 0::BIGINT AS missing_actual_rows, round(avg(CAST(ok AS DOUBLE)), 6) + 0.0 AS match_rate, round(1 - avg(CAST(ok AS DOUBLE)), 6) + 0.0 AS mismatch_rate FROM c
        UNION ALL SELECT 'model_name', count(*), 0, 0, count(*), 0.0, 1.0 FROM c"""

    @reg.add("settings_reflection", refl)
    def _(spark, sf):
        flat = reports.flatten_results(_results(spark, sf))
        out = reports.reflection_summary(reports.reflection_rows(flat))
        return _rounded(out, ["match_rate", "mismatch_rate"])

    @reg.add("reflection_details", f"WITH {RESULTS_SQL} SELECT run_id, cfg_horizon AS expected, CAST(horizon AS VARCHAR) AS actual, CASE WHEN CAST(cfg_horizon AS INTEGER) = horizon THEN 'match' ELSE 'mismatch' END AS status FROM results")
    def _(spark, sf):
        rows = reports.reflection_rows(reports.flatten_results(_results(spark, sf))).where("parameter = 'horizon'")
        return rows.select("run_id", "expected", "actual", "status")

    drill = f"""WITH {RUNS_SQL}, k AS (SELECT * FROM runs WHERE duration_sec IS NOT NULL), top AS (SELECT model_name AS v FROM k GROUP BY 1 HAVING count(*) >= 5)
        SELECT 'root' AS node, 0 AS depth, count(*) AS rows, round(avg(duration_sec), 6) + 0.0 AS target_mean, 'model_name' AS split_parameter FROM runs
        UNION ALL SELECT 'root/model_name=' || model_name, 1, count(*), round(avg(duration_sec), 6) + 0.0, NULL FROM runs WHERE model_name IN (SELECT v FROM top) GROUP BY model_name"""

    @reg.add("drilldown", drill)
    def _(spark, sf):
        out = reports.drilldown(runs(spark, sf), "duration_sec", ["model_name", "status"], max_depth=1)
        return out.select("node", "depth", "rows", r("target_mean").alias("target_mean"), "split_parameter")

    names = "['model_name', 'status', 'app_name']"
    levels = "".join(
        f""", c{d} AS (SELECT node, i, v, count(*) AS c FROM (SELECT node, y, unnest([1, 2, 3]) AS i, unnest(p) AS v FROM r{d}) WHERE y IS NOT NULL AND v IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
        s{d} AS (SELECT node, min(i) AS i FROM (SELECT node, i FROM c{d} GROUP BY ALL HAVING count(*) >= 2) WHERE node IN (SELECT node FROM r{d} GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1),
        r{d + 1} AS (SELECT p, y, r.node || '/' || {names}[s.i] || '=' || c.v AS node FROM r{d} r JOIN s{d} s ON s.node = r.node JOIN c{d} c ON c.node = r.node AND c.i = s.i AND c.v = r.p[s.i])"""
        for d in range(3)
    )
    shown = " UNION ALL ".join(
        f"SELECT r{d}.node, {d} AS depth, count(*) AS rows, round(avg(y), 6) + 0.0 AS target_mean, round(coalesce(stddev_samp(y), 0.0), 6) + 0.0 AS target_std, {f'any_value({names}[s{d}.i])' if d < 3 else 'NULL'} AS split_parameter FROM r{d}{f' LEFT JOIN s{d} ON s{d}.node = r{d}.node' if d < 3 else ''} GROUP BY r{d}.node"
        for d in range(4)
    )

    @reg.add("drilldown_deep", f"WITH {RUNS_SQL}, r0 AS (SELECT [CAST(model_name AS VARCHAR), CAST(status AS VARCHAR), CAST(app_name AS VARCHAR)] AS p, CAST(duration_sec AS DOUBLE) AS y, 'root' AS node FROM runs){levels} {shown}")
    def _(spark, sf):
        out = reports.drilldown(runs(spark, sf), "duration_sec", ["model_name", "status", "app_name"], max_depth=3)
        return _rounded(out, ["target_mean", "target_std"])

    @reg.add("impact_graph", "WITH e AS (SELECT event_type AS p, max(value) - min(value) AS x FROM events GROUP BY 1) SELECT p AS node, round(x, 6) + 0.0 AS weighted_degree, round(1.0 / (SELECT count(*) FROM e), 6) + 0.0 AS degree_centrality, round(x * CASE WHEN p < 'm' THEN 1.2 ELSE 1.0 END, 6) + 0.0 AS bridge_score FROM e")
    def _(spark, sf):
        imp = table(spark, sf, "events").groupBy(F.col("event_type").alias("parameter")).agg((F.max("value") - F.min("value")).alias("effect_abs"))
        return _rounded(reports.impact_graph(imp.withColumn("is_significant", F.col("parameter") < "m")), ["weighted_degree", "degree_centrality", "bridge_score"])

    @reg.add("relation_graph", "WITH e AS (SELECT event_type AS p, avg(value) AS w FROM events GROUP BY 1) SELECT 'exog:' || p AS node, round(1.0 / (SELECT count(*) FROM e), 6) + 0.0 AS degree_centrality, 0.0::DOUBLE AS betweenness FROM e UNION ALL SELECT 'model:m', 1.0, 1.0")
    def _(spark, sf):
        scores = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("weight")).withColumn("kind", F.lit("exog"))
        return _rounded(reports.relation_graph("m", scores)[1], ["degree_centrality", "betweenness"])

    @reg.add("key_insights", f"""WITH {RUNS_SQL} SELECT 1 AS rank, 'failure_rate' AS insight, 'status' AS subject, round(avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value FROM runs
        UNION ALL SELECT 2, 'best_run', CAST((SELECT run_id FROM runs WHERE duration_sec IS NOT NULL ORDER BY duration_sec, run_id LIMIT 1) AS VARCHAR), round(min(duration_sec), 6) + 0.0 FROM runs""")
    def _(spark, sf):
        return _rounded(reports.key_insights(runs(spark, sf), "duration_sec"), ["value"])

    @reg.add("forecast_contract", f"""WITH {FEATURES_SQL} SELECT '{{"count":' || count(0.6 * lag_1 + 0.4 * coalesce(roll_mean_7, lag_1)) || ',"coverage_target":0.9}}' AS head, 3 AS features, 3 AS scenarios FROM feats WHERE y IS NOT NULL""")
    def _(spark, sf):
        rows = _predicted(_features(spark, sf))
        out = reports.forecast_contract(rows, "y", "yhat", FEATURES, KEYS, ["ds"], points=20)
        return out.select(F.to_json(F.struct("point_forecast.count", "prediction_interval.coverage_target")).alias("head"), F.size("attribution").alias("features"), F.size("what_if").alias("scenarios"))


def _streams(reg) -> None:
    @reg.add(
        "samples_per_window",
        "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS metric_key, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2",
    )
    def _(spark, sf):
        e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("sampled_at"), F.col("event_type").alias("metric_key"), F.col("value").alias("metric_value"))
        out = streams.samples_per_window(e, width="1 hour", keys=["metric_key"])
        return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "metric_key", "n", r("mean").alias("mean"), "min", "max")

    @reg.add(
        "run_sessions",
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id AS run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, sid""",
    )
    def _(spark, sf):
        e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("event_ts"))
        out = streams.run_sessions(e, gap="6 hours")
        return out.select("run_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")
