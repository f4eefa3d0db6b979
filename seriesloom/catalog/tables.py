"""Sources, sinks, filters, checks and joins of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import feature_name_column
from ..operators import joins, prep, windows
from ..sources import readers, runner, writers
from ..spec import SeriesSpec
from .views import (
    ERRORS_SQL, FORECASTS_SQL, GAPPY_SQL, SERIES, SERIES_SQL, TICKS, TICKS_SQL, day, errors, forecasts, gappy, r, series, table, ticks,
)

DAY_SQL = "strftime(ds, '%Y-%m-%d') AS ds"
ORDERS = SeriesSpec(("loto", "unique_id", "ts_type"), "ds", "y")


def _orders(spark, sf):
    """Orders under series names, read straight from the file so that filters reach the scan."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderstatus").alias("loto"), F.col("o_custkey").alias("unique_id"), F.col("o_orderpriority").alias("ts_type"),
        F.col("o_orderdate").alias("ds"), F.col("o_totalprice").alias("y"), F.col("o_orderkey").alias("order_row_id"), F.lit(1).alias("unused"),
    )


def register(reg) -> None:
    _sources(reg)
    _sinks(reg)
    _filters(reg)
    _joins(reg)


def _sources(reg) -> None:
    @reg.add(
        "source_projection",
        "SELECT o_orderstatus AS loto, o_custkey AS unique_id, o_orderpriority AS ts_type, strftime(o_orderdate, '%Y-%m-%d') AS ds, o_totalprice AS y, o_orderkey AS order_row_id FROM orders WHERE o_totalprice > 100000",
    )
    def _(spark, sf):
        return readers.read_source(_orders(spark, sf), ORDERS, "y > 100000").withColumn("ds", day("ds"))

    @reg.add(
        "source_range",
        """SELECT o_orderkey AS order_row_id, o_totalprice AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1998-06-30'
        AND o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '5-LOW')""",
    )
    def _(spark, sf):
        from datetime import datetime

        out = readers.read_range(_orders(spark, sf), ORDERS, datetime(1996, 3, 1), datetime(1998, 6, 30), ["F", "O"], ["1-URGENT", "5-LOW"])
        return out.select("order_row_id", "y")

    @reg.add("source_by_method", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_discount > 0.02 GROUP BY 1")
    def _(spark, sf):
        out = readers.load_dataset(spark, "parquet", path=f"{sf}/lineitem.parquet", where="l_discount > 0.02")
        return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))

    @reg.add("source_glob", "SELECT 'nation' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
    def _(spark, sf):
        out = readers.read_files(spark, f"{sf}/{{nation,region}}.parquet", "parquet")
        kind = F.when(F.col("n_nationkey").isNotNull(), "nation").otherwise("region")
        return out.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))

    @reg.add("source_union", "SELECT count(*) AS n, count(o_orderkey) AS orders, count(c_custkey) AS customers FROM orders FULL JOIN customer ON false")
    def _(spark, sf):
        both = readers.union_by_name([table(spark, sf, "orders"), table(spark, sf, "customer")])
        return both.agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("orders"), F.count("c_custkey").alias("customers"))

    @reg.add("source_recent", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 500")
    def _(spark, sf):
        return readers.read_recent(table(spark, sf, "events"), "ts", 500, ["event_id"]).select("event_id", "value")

    @reg.add("standard_columns", "SELECT event_type AS unique_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ds, value AS y FROM events")
    def _(spark, sf):
        e = table(spark, sf, "events")
        raw = e.select(F.col("event_type").alias("Series"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("value").cast("string").alias("Target"))
        return readers.standard_columns(raw).withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm:ss"))

    @reg.add("event_lines", "SELECT event_id, event_type AS category, CAST(user_id AS VARCHAR) AS run_id FROM events WHERE event_id % 10 <> 0")
    def _(spark, sf):
        e = table(spark, sf, "events")
        body = F.to_json(F.struct(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("run_id"), F.lit("INFO").alias("level")))
        line = F.when(F.col("event_id") % 20 == 0, F.substr(body, F.lit(1), F.length(body) - 3)).when(F.col("event_id") % 20 == 10, F.lit("not json")).otherwise(body)
        return readers.parse_event_lines(e.select("event_id", line.alias("value")), keep=["event_id"]).select("event_id", "category", "run_id")

    @reg.add("table_runner", "SELECT o_orderstatus AS loto, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
    def _(spark, sf):
        sql = "SELECT loto, count(*) AS n, round(sum(y), 2) AS total FROM {{source}} WHERE y > 50000 GROUP BY loto"
        return runner.run_table(_orders(spark, sf), sql)

    @reg.add("table_runner_filter", "SELECT o_orderkey AS order_row_id, o_totalprice AS y FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus = 'F'")
    def _(spark, sf):
        out = runner.run_table(_orders(spark, sf), "SELECT * FROM {{source}} WHERE y IS NOT NULL AND loto = 'F'", partitions=4, by=["ts_type"])
        return out.select("order_row_id", "y")


def _sinks(reg) -> None:
    @reg.add("append_alignment", "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS note, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus FROM orders")
    def _(spark, sf):
        target = spark.createDataFrame([], "o_orderkey bigint, note string, o_custkey double, o_orderstatus string").schema
        return writers.align(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey"), target)

    @reg.add(
        "incremental_rows",
        f"""WITH {TICKS_SQL}, l AS (SELECT *, lag(y, 1) OVER (PARTITION BY loto, unique_id, ts_type ORDER BY ds, row_id) AS hist_lag_1 FROM ticks)
        SELECT row_id, round(hist_lag_1, 6) + 0.0 AS hist_lag_1 FROM l WHERE row_id NOT IN (SELECT c_custkey FROM customer)""",
    )
    def _(spark, sf):
        built = windows.lag_features(ticks(spark, sf), TICKS, [1])
        held = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"))
        return writers.only_missing(built, held, "row_id").select("row_id", r("lag_1").alias("hist_lag_1"))

    @reg.add(
        "metric_rows_long",
        "SELECT l_orderkey AS run_id, unnest(['qty', 'price']) AS metric_name, round(unnest([sum(l_quantity), sum(l_extendedprice)]), 2) + 0.0 AS metric_value FROM lineitem GROUP BY 1",
    )
    def _(spark, sf):
        wide = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"))
        return writers.metrics_long(wide, "run_id", ["qty", "price"]).withColumn("metric_value", r("metric_value", 2))

    @reg.add(
        "metric_upsert",
        """WITH a AS (SELECT user_id AS run_id, event_type AS metric_name, value AS metric_value, event_id AS version FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY run_id, metric_name ORDER BY version DESC) AS rn FROM a)
        SELECT run_id, metric_name, metric_value, version FROM n WHERE rn = 1""",
    )
    def _(spark, sf):
        rows = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"), F.col("event_id").alias("version"))
        return writers.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["run_id", "metric_name"], "version")

    @reg.add("forecast_rows", f"WITH {FORECASTS_SQL} SELECT 'r1' AS run_id, loto || '/' || unique_id AS unique_id, {DAY_SQL}, round(yhat, 6) + 0.0 AS yhat FROM forecasts")
    def _(spark, sf):
        f = forecasts(spark, sf).select(F.concat_ws("/", "loto", "unique_id").alias("unique_id"), "ds", F.lit("c").alias("cutoff"), F.col("yhat").alias("model_a"))
        return writers.forecast_rows(f, "r1").withColumns({"ds": day("ds"), "yhat": r("yhat")})

    @reg.add("contribution_rows", "SELECT 'r1' AS run_id, event_type AS feature, round(avg(value), 6) + 0.0 AS importance, 'permutation' AS method FROM events GROUP BY 2")
    def _(spark, sf):
        imp = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("delta_mae_mean"))
        return writers.contribution_rows(imp, "r1").withColumn("importance", r("importance"))

    @reg.add("log_rows", "SELECT event_id, event_type, '{\"user_id\":' || user_id || ',\"props\":\"' || replace(props, '\"', '\\\"') || '\"}' AS payload FROM events")
    def _(spark, sf):
        return writers.event_rows(table(spark, sf, "events"), ["user_id", "props"], ["event_id", "event_type"])

    @reg.add("grid_task_rows", "SELECT 'g1' AS grid_id, p_partkey AS task_order, '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}' AS param_values, 'pending' AS status FROM part")
    def _(spark, sf):
        return writers.grid_task_rows(table(spark, sf, "part"), "g1", ["p_size", "p_brand"], "p_partkey")

    @reg.add(
        "provenance_stamp",
        """SELECT vec_id, 8 AS embedding_dim, 'harmonic' AS model_name, '1' AS model_version, sha256('{"dim": 8, "window": 16}') AS config_hash FROM embeddings""",
    )
    def _(spark, sf):
        from ..operators.embed import provenance

        e = table(spark, sf, "embeddings").select("vec_id")
        return provenance(e, {"dim": 8, "window": 16}, "harmonic", "1", 8).drop("created_at", "updated_at")


def _filters(reg) -> None:
    @reg.add(
        "sanitized_input",
        f"""WITH {TICKS_SQL}, d AS (SELECT unique_id, date_trunc('day', ds) AS ds, CASE WHEN row_id % 11 <> 0 THEN y END AS y, row_id FROM ticks),
        n AS (SELECT *, row_number() OVER (PARTITION BY unique_id, ds ORDER BY row_id DESC) AS rn FROM d WHERE y IS NOT NULL)
        SELECT unique_id, {DAY_SQL}, row_id, round(y, 6) + 0.0 AS y FROM n WHERE rn = 1""",
    )
    def _(spark, sf):
        t = ticks(spark, sf).select("unique_id", F.date_format("ds", "yyyy-MM-dd 00:00:00").alias("ds"), F.when(F.col("row_id") % 11 != 0, F.col("y")).alias("y"), "row_id")
        return prep.sanitize(t, "row_id").select("unique_id", day("ds").alias("ds"), "row_id", r("y").alias("y"))

    @reg.add("equality_filter", "SELECT count(*) AS rows_before, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS rows_after, 'nope' AS missing_filter_cols FROM orders")
    def _(spark, sf):
        return prep.filter_report(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "5-LOW", "nope": 1})

    @reg.add("in_list_filter", "SELECT event_id FROM events WHERE user_id IN (3, 17, 42)")
    def _(spark, sf):
        return prep.in_list(table(spark, sf, "events"), "user_id", " 3,17 , 42,").select("event_id")

    integ = """, g AS (SELECT user_id, ts, count(*) AS n FROM d GROUP BY 1, 2)
        SELECT CAST(sum(n) AS BIGINT) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT user_id FROM d)) AS group_count,
          CAST(sum(CASE WHEN user_id IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_key_rows,
          CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_group_time_rows, 'ts_type' AS missing_group_cols, false AS ok FROM g"""

    @reg.add("group_integrity", "WITH d AS (SELECT CASE WHEN user_id > 3 THEN user_id END AS user_id, date_trunc('hour', ts) AS ts FROM events)" + integ)
    def _(spark, sf):
        e = table(spark, sf, "events").select(F.when(F.col("user_id") > 3, F.col("user_id")).alias("user_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
        return prep.integrity(e, ["user_id", "ts_type"], "ts")

    @reg.add("group_summary", "SELECT user_id, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_time FROM events GROUP BY 1")
    def _(spark, sf):
        out = prep.group_summary(table(spark, sf, "events"), ["user_id"], "ts")
        return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_time", "max_time")})

    @reg.add(
        "exog_roles",
        "SELECT unnest(['feat_week', 'month', 'hist_a', 'lag_3', 'acctbal', 'stat_b']) AS column, unnest(['futr_exog', 'futr_exog', 'hist_exog', 'hist_exog', 'hist_exog', 'stat_exog']) AS role",
    )
    def _(spark, sf):
        c = table(spark, sf, "customer")
        t = c.select(
            F.col("c_name").alias("unique_id"), F.lit("2020-01-01").alias("ds"), F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 7).alias("feat_week"),
            (F.col("c_custkey") % 12).alias("month"), F.col("c_acctbal").alias("hist_a"), F.col("c_acctbal").alias("acctbal"), F.lit(1.0).alias("lag_3"),
            F.lit(2).alias("stat_b"), F.lit(None).cast("double").alias("feat_empty"), F.col("c_mktsegment").alias("hist_text"),
        )
        return prep.exog_role_table(t)

    @reg.add(
        "model_frames",
        f"""WITH {GAPPY_SQL}, x AS (SELECT loto || unique_id AS unique_id, ds, y, CASE WHEN day(ds) % 3 = 0 THEN NULL ELSE CAST(day(ds) * 1.5 AS DOUBLE) END AS feat_a, lag(y, 2) OVER (PARTITION BY loto, unique_id ORDER BY ds) AS hist_b FROM gappy),
        k AS (SELECT * FROM x WHERE y IS NOT NULL), m AS (SELECT quantile_cont(feat_a, 0.5) AS ma, quantile_cont(hist_b, 0.5) AS mb FROM k)
        SELECT unique_id, {DAY_SQL}, round(y, 6) + 0.0 AS y, round(coalesce(feat_a, ma), 6) + 0.0 AS feat_a, round(coalesce(hist_b, mb), 6) + 0.0 AS hist_b FROM k, m""",
    )
    def _(spark, sf):
        lagged = windows.lag_features(gappy(spark, sf), SERIES, [2])
        d = F.dayofmonth("ds")
        x = lagged.select(F.concat("loto", "unique_id").alias("unique_id"), "ds", "y", F.when(d % 3 != 0, d * 1.5).alias("feat_a"), F.col("lag_2").alias("hist_b"))
        fit, _, _ = prep.model_frames(x)
        return fit.select("unique_id", day("ds").alias("ds"), *[r(c).alias(c) for c in ("y", "feat_a", "hist_b")])

    @reg.add(
        "static_frame",
        """SELECT user_id AS unique_id, arg_max(value, event_id) AS stat_last, arg_max(event_type, event_id) AS stat_kind FROM events GROUP BY 1""",
    )
    def _(spark, sf):
        e = table(spark, sf, "events").select(F.col("user_id").alias("unique_id"), "event_id", F.col("value").alias("stat_last"), F.col("event_type").alias("stat_kind"))
        return prep.static_frame(e, ["event_id"])

    @reg.add("prefix_projection", f"WITH {SERIES_SQL} SELECT loto, unique_id, ts_type, {DAY_SQL}, round(y, 6) + 0.0 AS y, day(ds) AS feat_day, 1 AS hist_one FROM series")
    def _(spark, sf):
        t = series(spark, sf).withColumns({"feat_day": F.dayofmonth("ds").cast("long"), "other": F.lit(1), "hist_one": F.lit(1)})
        return prep.prefix_projection(t, SERIES).withColumns({"ds": day("ds"), "y": r("y")})

    @reg.add(
        "eval_keys",
        "SELECT CAST(user_id AS VARCHAR) AS unique_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS ds, max(event_id) AS event_id FROM events WHERE event_id % 13 <> 0 GROUP BY 1, 2",
    )
    def _(spark, sf):
        e = table(spark, sf, "events")
        text = F.when(F.col("event_id") % 13 == 0, "bad").otherwise(F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss"))
        out = prep.eval_keys(e.select(F.col("user_id").alias("unique_id"), text.alias("ds"), "event_id"), "event_id")
        return out.withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH"))

    @reg.add(
        "row_id_hash",
        """WITH d AS (SELECT event_id, event_type AS loto, 'raw' AS ts_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS ds, CAST(user_id AS VARCHAR) AS u FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY loto, ds, u ORDER BY event_id) AS k FROM d),
        h AS (SELECT *, CAST('0x' || substr(sha1('unique_id|u' || u || '|' || loto || '|raw|' || ds || '|' || k), 1, 16) AS UBIGINT) AS v FROM n)
        SELECT event_id, CAST(v % 9223372036854775808::UBIGINT AS BIGINT) AS row_hash FROM h""",
    )
    def _(spark, sf):
        e = table(spark, sf, "events").select(
            "event_id", F.col("event_type").alias("loto"), F.lit("raw").alias("ts_type"), day(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("ds"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("unique_id"),
        )
        spec = SeriesSpec(order_cols=("event_id",))
        return prep.ensure_row_id(e, spec).select("event_id", F.col("loto_y_ts_row_id").alias("row_hash"))

    @reg.add("status_normalized", "SELECT o_orderkey, lower(coalesce(nullif(o_orderstatus, 'P'), '')) = 'success' AS ok, nullif(trim(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE 'x' END, '')), '') IS NULL AS blank FROM orders")
    def _(spark, sf):
        o = table(spark, sf, "orders")
        text = F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise("x")
        return o.select("o_orderkey", prep.is_success(F.nullif("o_orderstatus", F.lit("P"))).alias("ok"), prep.is_blank(text).alias("blank"))

    @reg.add(
        "category_normalized",
        """SELECT event_id, CASE WHEN k = 'queued' THEN 'pending' WHEN k IN ('ready', 'pending') THEN k ELSE 'unknown' END AS category FROM (
        SELECT event_id, lower(trim(CASE event_type WHEN 'view' THEN ' Ready ' WHEN 'click' THEN 'QUEUED' WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN '' END)) AS k FROM events)""",
    )
    def _(spark, sf):
        t = F.col("event_type")
        raw = F.when(t == "view", " Ready ").when(t == "click", "QUEUED").when(t == "signup", "PENDING").when(t == "error", "")
        out = prep.normalize_category(raw, ["ready", "pending", "unknown"], {"queued": "pending"})
        return table(spark, sf, "events").select("event_id", out.alias("category"))

    @reg.add("category_order", "SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 1 ELSE 3 END AS rank FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
    def _(spark, sf):
        return prep.present_categories(table(spark, sf, "events"), "event_type", ["view", "absent", "click"])

    @reg.add("feature_names", "SELECT doc_id, coalesce(nullif(trim(regexp_replace(replace(lower(trim(left(text, 40))), '%', 'pct'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'feature') AS name FROM documents")
    def _(spark, sf):
        return table(spark, sf, "documents").select("doc_id", feature_name_column(F.substr("text", F.lit(1), F.lit(40))).alias("name"))

    @reg.add("deduplicated", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
    def _(spark, sf):
        return table(spark, sf, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()

    @reg.add("id_difference", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || '/' || o_custkey AS id FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') || '/' || o_custkey NOT IN (SELECT strftime(o_orderdate, '%Y-%m-%d') || '/' || o_custkey FROM orders WHERE o_orderstatus = 'F')")
    def _(spark, sf):
        o = table(spark, sf, "orders")
        ids = o.select(F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_custkey").alias("id"), "o_orderstatus")
        return writers.only_missing(ids.select("id").distinct(), ids.where("o_orderstatus = 'F'").select("id"), "id")

    @reg.add("id_difference_mixed_types", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT ps FROM (SELECT l_suppkey * 3 AS ps FROM lineitem))")
    def _(spark, sf):
        ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
        held = table(spark, sf, "lineitem").select((F.col("l_suppkey") * 3).cast("string").alias("id"))
        return writers.only_missing(ids, held, "id")


def _joins(reg) -> None:
    # Times cut to the day tie; every twentieth event has no user.
    tied = "SELECT event_id, date_trunc('day', ts) AS d, CASE WHEN event_id % 20 <> 0 THEN user_id END AS u, event_type FROM events"

    @reg.add("asof_tied_times", f"WITH e AS ({tied}), r AS (SELECT * FROM e WHERE event_type = 'error'), m AS (SELECT e.event_id, max_by(r.event_id, (r.d, r.event_id)) AS error_id FROM e JOIN r ON e.u = r.u AND r.d <= e.d GROUP BY 1) SELECT e.event_id, m.error_id FROM e LEFT JOIN m USING (event_id)")
    def _(spark, sf):
        e = table(spark, sf, "events").select("event_id", F.date_trunc("day", "ts").alias("d"), F.when(F.col("event_id") % 20 != 0, F.col("user_id")).alias("u"), "event_type")
        out = joins.asof_join(e.select("event_id", "d", "u"), e.where("event_type = 'error'"), "u", "d", "d", {"event_id": "error_id"}, right_order=["event_id"])
        return out.select("event_id", "error_id")

    hist = """, hist AS (SELECT loto, unique_id, ts_type, ds, lag(y, 1) OVER (PARTITION BY loto, unique_id, ts_type ORDER BY ds) AS hist_signal FROM series),
      w AS (SELECT unique_id, ds, max(y) AS hist_signal, count(*) AS feat_n FROM series WHERE day(ds) % 2 = 0 GROUP BY 1, 2)"""

    @reg.add(
        "unified_dataset",
        f"""WITH {SERIES_SQL}{hist} SELECT s.loto, s.unique_id, strftime(s.ds, '%Y-%m-%d') AS ds, round(s.y, 6) + 0.0 AS y, round(h.hist_signal, 6) + 0.0 AS hist_signal,
        round(w.hist_signal, 6) + 0.0 AS hist_weather_signal, CAST(feat_n AS DOUBLE) AS feat_n FROM series s LEFT JOIN hist h USING (loto, unique_id, ts_type, ds) LEFT JOIN w ON s.unique_id = w.unique_id AND s.ds = w.ds""",
    )
    def _(spark, sf):
        base = series(spark, sf)
        h = windows.lag_features(base, SERIES, [1]).select("loto", "unique_id", "ts_type", "ds", F.col("lag_1").alias("hist_signal"))
        even = base.where(F.dayofmonth("ds") % 2 == 0)
        n = even.groupBy("unique_id", "ds").agg(F.count(F.lit(1)).alias("feat_n"))
        weather = even.select("unique_id", "ds", F.col("y").alias("hist_signal")).join(n, ["unique_id", "ds"])
        res = joins.unified_dataset(base, ("hist", h), {"weather": weather, "skipme": weather, "nokeys": weather.select(F.col("feat_n").alias("z"))}, exclude=["skipme"])
        out = res.frame
        return out.select("loto", "unique_id", day("ds").alias("ds"), *[r(c).alias(c) for c in ("y", "hist_signal", "hist_weather_signal")], F.col("feat_n").cast("double").alias("feat_n"))

    @reg.add("last_row_per_key", "SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
    def _(spark, sf):
        return joins.last_per_key(table(spark, sf, "events").select("user_id", "ts", "value"), ["user_id"], "ts").select("user_id", "value")

    @reg.add("actual_and_forecast", f"WITH {FORECASTS_SQL} SELECT loto || unique_id AS unique_id, {DAY_SQL}, round(y, 6) + 0.0 AS y, round(yhat, 6) + 0.0 AS yhat FROM forecasts WHERE day(ds) < 20")
    def _(spark, sf):
        f = forecasts(spark, sf).withColumn("unique_id", F.concat("loto", "unique_id"))
        out = joins.actual_forecast(f, f.where(F.dayofmonth("ds") < 20), "yhat")
        return out.select("unique_id", day("ds").alias("ds"), r("y").alias("y"), r("yhat").alias("yhat"))

    @reg.add(
        "latest_per_run",
        f"WITH {ERRORS_SQL} SELECT run_id, arg_max(error_type, event_id) AS error_type, max(event_id) AS event_id FROM errors GROUP BY 1",
    )
    def _(spark, sf):
        return windows.latest_per(errors(spark, sf), ["run_id"], ["event_ts", "event_id"]).select("run_id", "error_type", "event_id")
