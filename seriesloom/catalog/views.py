"""The canonical inputs of the registered queries, each as a Spark frame and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import SeriesSpec

SERIES = SeriesSpec()
TICKS = SeriesSpec(order_cols=("row_id",))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 6) -> Column:
    """Rounded for comparison, without negative zeros."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


def day(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def series(spark, sf) -> DataFrame:
    """Daily log order value by market segment and order priority."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("c_mktsegment").alias("loto"), F.col("o_orderpriority").alias("unique_id"), F.lit("raw").alias("ts_type"), F.col("o_orderdate").alias("ds")]
    return joined.groupBy(*keys).agg(F.log(F.sum("o_totalprice")).alias("y"))


SERIES_SQL = """series AS (
  SELECT c_mktsegment AS loto, o_orderpriority AS unique_id, 'raw' AS ts_type, o_orderdate AS ds, ln(sum(o_totalprice)) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4)"""


def gappy(spark, sf) -> DataFrame:
    """The series with every day of the month divisible by 5 missing."""
    return series(spark, sf).withColumn("y", F.when(F.dayofmonth("ds") % 5 != 0, F.col("y")))


GAPPY_SQL = SERIES_SQL + """, gappy AS (
  SELECT loto, unique_id, ts_type, ds, CASE WHEN day(ds) % 5 <> 0 THEN y END AS y FROM series)"""


def ticks(spark, sf) -> DataFrame:
    """Irregular event values per type and user, ordered by time and event id."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("event_type").alias("loto"),
        F.col("user_id").cast("string").alias("unique_id"),
        F.lit("raw").alias("ts_type"),
        F.col("ts").alias("ds"),
        F.log1p("value").alias("y"),
        F.col("event_id").alias("row_id"),
    )


TICKS_SQL = """ticks AS (
  SELECT event_type AS loto, CAST(user_id AS VARCHAR) AS unique_id, 'raw' AS ts_type, ts AS ds, ln(1 + value) AS y,
         event_id AS row_id FROM events)"""


LINES = SeriesSpec(("loto", "unique_id"), order_cols=("order_id", "line_no", "part_id"))


def lines(spark, sf) -> DataFrame:
    """Log line prices per return flag and supplier: the largest series table of the data."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("loto"),
        F.col("l_suppkey").alias("unique_id"),
        F.col("l_shipdate").alias("ds"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.log("l_extendedprice").alias("y"),
    )


LINES_SQL = """lines AS (
  SELECT l_returnflag || l_linestatus AS loto, l_suppkey AS unique_id, l_shipdate AS ds, l_orderkey AS order_id, l_linenumber AS line_no,
         l_partkey AS part_id, ln(l_extendedprice) AS y FROM lineitem)"""


def forecasts(spark, sf) -> DataFrame:
    """The series next to the seasonal guess of seven rows earlier and a naive guess of one row earlier."""
    from ..operators.windows import lag_features

    out = lag_features(series(spark, sf), SERIES, [1, 7])
    return out.withColumnsRenamed({"lag_7": "yhat", "lag_1": "ynaive"})


FORECASTS_SQL = SERIES_SQL + """, forecasts AS (
  SELECT *, lag(y, 7) OVER w AS yhat, lag(y, 1) OVER w AS ynaive FROM series
  WINDOW w AS (PARTITION BY loto, unique_id, ts_type ORDER BY ds))"""


def runs(spark, sf) -> DataFrame:
    """Orders as runs: status, app, model, and written / failed rows and seconds summed from the line items."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("duration_sec"),
        F.sum("l_partkey").alias("rows_written"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).otherwise(0)).alias("rows_failed"),
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "success").otherwise("running")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_orderdate").alias("started_at"),
            status.alias("status"),
            F.col("o_orderpriority").alias("app_name"),
            F.col("c_mktsegment").alias("model_name"),
            F.concat(F.lit("train --seg "), F.col("c_mktsegment")).alias("command"),
            "duration_sec",
            "rows_written",
            "rows_failed",
        )
    )


RUNS_SQL = """runs AS (
  SELECT o_orderkey AS run_id, o_orderdate AS started_at,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END AS status,
         o_orderpriority AS app_name, c_mktsegment AS model_name, 'train --seg ' || c_mktsegment AS command,
         duration_sec, rows_written, rows_failed
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS duration_sec, CAST(sum(l_partkey) AS BIGINT) AS rows_written,
                    CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE 0 END) AS BIGINT) AS rows_failed
             FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def spans(spark, sf) -> DataFrame:
    """Line items as stage spans."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("span_no"),
        F.concat("l_returnflag", "l_linestatus").alias("stage_name"),
        F.col("l_shipdate").alias("started_at"),
        (F.col("l_quantity") * 1000).alias("duration_ms"),
        (F.col("l_extendedprice") / 17).alias("db_time_ms"),
        (F.col("l_discount") * 1000).alias("gpu_util_avg"),
        (F.col("l_tax") * 1000).alias("gpu_mem_used_mb_avg"),
        F.when(F.col("l_linenumber") == 7, "TimeoutError").when(F.col("l_linenumber") == 6, "ValueError").alias("exception_type"),
    )


SPANS_SQL = """spans AS (
  SELECT l_orderkey AS run_id, l_linenumber AS span_no, l_returnflag || l_linestatus AS stage_name, l_shipdate AS started_at,
         l_quantity * 1000 AS duration_ms, l_extendedprice / 17 AS db_time_ms, l_discount * 1000 AS gpu_util_avg,
         l_tax * 1000 AS gpu_mem_used_mb_avg,
         CASE l_linenumber WHEN 7 THEN 'TimeoutError' WHEN 6 THEN 'ValueError' END AS exception_type FROM lineitem)"""


def history(spark, sf) -> DataFrame:
    """Events that are no errors, as run history (one run per user)."""
    e = table(spark, sf, "events").where(F.col("event_type") != "error")
    status = F.when(F.col("event_type") == "purchase", "success").otherwise("running")
    return e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("event_ts"), "event_type", status.alias("status"), "event_id")


HISTORY_SQL = """history AS (
  SELECT user_id AS run_id, ts AS event_ts, event_type, CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'running' END AS status,
         event_id FROM events WHERE event_type <> 'error')"""


def errors(spark, sf) -> DataFrame:
    """Error events, with a type and a stage read off the event id."""
    e = table(spark, sf, "events").where(F.col("event_type") == "error")
    kind = F.when(F.col("event_id") % 3 == 0, "ValueError").when(F.col("event_id") % 3 == 1, "TimeoutError").otherwise("KeyError")
    stage = F.when(F.col("event_id") % 2 == 0, "fit").otherwise("predict")
    return e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("event_ts"), kind.alias("error_type"), stage.alias("stage"), "event_id")


ERRORS_SQL = """errors AS (
  SELECT user_id AS run_id, ts AS event_ts,
         CASE event_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'TimeoutError' ELSE 'KeyError' END AS error_type,
         CASE event_id % 2 WHEN 0 THEN 'fit' ELSE 'predict' END AS stage, event_id FROM events WHERE event_type = 'error')"""


class Registry:
    """Collects queries and their SQL counterparts."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(fn):
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return put


# Tail probabilities in SQL, from series of positive terms whose logarithms are sums of log-gamma values.


def chi2_sql(x: str, k: str) -> str:
    """P(X > x) for k degrees of freedom: one minus the series of the lower incomplete gamma function."""
    term = f"exp(-({x}) / 2.0 + (({k}) / 2.0 + i) * ln(({x}) / 2.0) - lgamma(({k}) / 2.0 + i + 1))"
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 800 + 2 * ({k}) THEN 0.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, 2000), lambda i: {term}))) END"


def normal2_sql(z: str) -> str:
    """P(|Z| > |z|): a squared standard normal value has one degree of freedom."""
    return chi2_sql(f"pow({z}, 2)", "1")


def f_sql(x: str, d1: str, d2: str) -> str:
    """P(F > x): one minus the series of the incomplete beta function at d1 x / (d2 + d1 x)."""
    a, b, y = f"(({d1}) / 2.0)", f"(({d2}) / 2.0)", f"(({d1}) * ({x}) / (({d2}) + ({d1}) * ({x})))"
    term = f"exp(({a} + i) * ln({y}) + {b} * ln(1 - {y}) + lgamma({a} + {b} + i) - lgamma({b}) - lgamma({a} + 1 + i))"
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, 3000), lambda i: {term}))) END"


def t2_sql(t: str, df: str) -> str:
    return f_sql(f"pow({t}, 2)", "1", df)


def kolmogorov_sql(x: str) -> str:
    """Tail of the limit distribution of the scaled two-sample distance, in the form that converges for small and for large values."""
    small = f"1.0 - sqrt(2 * pi()) / ({x}) * list_sum(list_transform(range(1, 40), lambda i: exp(-pow(2 * i - 1, 2) * pow(pi(), 2) / (8 * pow({x}, 2)))))"
    large = f"2 * list_sum(list_transform(range(1, 100), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * pow({x}, 2))))"
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < 0.000001 THEN 1.0 WHEN ({x}) < 1.18 THEN {small} ELSE greatest(0.0, least(1.0, {large})) END"
