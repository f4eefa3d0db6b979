"""What is written, or streamed, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import forecast
from ..operators.windows import lag_features
from ..plans.series import measure
from ..session import shared_folder
from ..sources import writers
from ..streaming import streams
from ..streaming.histories import history_stream
from .views import SERIES, SERIES_SQL, TICKS, TICKS_SQL, day, r, series, table, ticks


def _place(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


def register(reg) -> None:
    @reg.add(
        "appended_table",
        """SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""",
    )
    def _(spark, sf):
        place, orders = _place(spark), table(spark, sf, "orders")
        writers.write_table(orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus"), place, "replace", partition_by=["o_orderstatus"])
        writers.write_table(orders.where("o_orderstatus <> 'F'").select("o_orderstatus", "o_orderkey"), place, "append", partition_by=["o_orderstatus"], max_rows_per_file=1000)
        return spark.read.parquet(place).select("o_orderkey", "o_custkey", "o_orderstatus")

    @reg.add("appended_csv", "SELECT p_partkey, p_brand, p_size FROM part")
    def _(spark, sf):
        place, parts = _place(spark), table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
        for odd in (0, 1):
            writers.write_table(parts.where(F.col("p_partkey") % 2 == odd), place, "append", "csv")
        return spark.read.csv(place, header=True, schema=parts.schema)

    @reg.add(
        "unified_outputs",
        """SELECT unnest(['table', 'csv', 'parquet']) AS sink, s.* FROM (SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem) s""",
    )
    def _(spark, sf):
        place = _place(spark)
        rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
        names = writers.write_outputs(rows, table_path=f"{place}/table", csv_path=f"{place}/csv", parquet_path=f"{place}/parquet")
        out = None
        for name in names:
            held = spark.read.csv(f"{place}/csv", header=True, schema=rows.schema) if name == "csv" else spark.read.parquet(f"{place}/{name}")
            one = held.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_linenumber").cast("bigint").alias("lines"))
            out = one if out is None else out.unionByName(one)
        return out

    @reg.add(
        "replaced_partitions",
        """SELECT 'g1' AS grid_id, p_partkey AS task_order, '{"p_size":' || p_size || '}' AS param_values, 'pending' AS status FROM part WHERE p_size < 20
        UNION ALL SELECT 'g2', p_partkey, '{"p_brand":"' || p_brand || '"}', 'pending' FROM part""",
    )
    def _(spark, sf):
        place, parts = _place(spark), table(spark, sf, "part")
        for grid, params, rows in (("g1", ["p_brand"], parts), ("g2", ["p_brand"], parts), ("g1", ["p_size"], parts.where("p_size < 20"))):
            writers.replace_partitions(writers.grid_task_rows(rows, grid, params, "p_partkey"), place, "grid_id")
        return spark.read.parquet(place).select("grid_id", "task_order", "param_values", "status")

    @reg.add("insample_fallback", f"""WITH {SERIES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY loto, unique_id ORDER BY ds DESC) AS rn FROM series)
        SELECT loto, unique_id, strftime(ds, '%Y-%m-%d') AS ds, round(y, 6) + 0.0 AS y, 'insample_tail_fallback' AS mode FROM n WHERE rn <= 7""")
    def _(spark, sf):
        s = series(spark, sf)
        rows, mode = forecast.with_fallback(s.where("y IS NULL AND y IS NOT NULL"), s, SERIES, 7)
        return rows.select("loto", "unique_id", day("ds").alias("ds"), r("y").alias("y"), F.lit(mode).alias("mode"))

    @reg.add("stream_unique_events", "SELECT DISTINCT event_type AS category, 'user ' || user_id AS message FROM events")
    def _(spark, sf):
        """Events as JSON lines, streamed; a fingerprint that comes again is dropped."""
        place = _place(spark)
        e = table(spark, sf, "events")
        lines = F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit("app").alias("source"), F.col("event_type").alias("category"), F.lit("INFO").alias("level"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"), F.lit("r").alias("run_id"))
        e.select(F.to_json(lines).alias("value")).write.text(f"{place}/in")
        seen = streams.unique_events(streams.event_stream(spark, f"{place}/in"), delay="20000 days")
        query = seen.select("category", "message").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema("category string, message string").parquet(f"{place}/out")

    @reg.add(
        "stream_appended_features",
        f"WITH {TICKS_SQL} SELECT row_id, round(lag(y, 1) OVER w, 6) + 0.0 AS lag_1, round(lag(y, 7) OVER w, 6) + 0.0 AS lag_7 FROM ticks WINDOW w AS (PARTITION BY loto, unique_id, ts_type ORDER BY ds, row_id)",
    )
    def _(spark, sf):
        """The rows arrive in two files, the older ones first; features of new rows are appended, and a replay adds none."""
        place, rows = _place(spark), ticks(spark, sf)
        layout = measure(rows, TICKS.keys)  # of all rows: a batch's series are no larger
        border = rows.agg(F.percentile_approx("ds", 0.5)).first()[0]
        for older in (True, False):
            part = rows.where(F.col("ds") <= F.lit(border)) if older else rows.where(F.col("ds") > F.lit(border))
            part.write.mode("append").parquet(f"{place}/in")
            for state in ("state", "replay"):
                stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")

                def target(s):
                    return s.read.parquet(f"{place}/out") if _held(s, f"{place}/out") else None

                query = streams.append_features(
                    stream, lambda s: s.read.schema(rows.schema).parquet(f"{place}/in"), target, lambda d: lag_features(d, TICKS, [1, 7], layout),
                    lambda d: d.write.mode("append").parquet(f"{place}/out"), TICKS, "row_id", f"{place}/{state}",
                )
                query.awaitTermination()
        return spark.read.parquet(f"{place}/out").select("row_id", r("lag_1").alias("lag_1"), r("lag_7").alias("lag_7"))


    w = "(PARTITION BY loto, unique_id, ts_type ORDER BY ds{})"
    frame = w.format(" ROWS BETWEEN {} PRECEDING AND 1 PRECEDING")
    kept = {"hist_lag_1": f"lag(y, 1) OVER {w.format('')}", "hist_lag_28": f"lag(y, 28) OVER {w.format('')}", "hist_diff_7": f"y - lag(y, 7) OVER {w.format('')}"}
    for fn, tag, n in (("avg", "mean", 7), ("stddev_samp", "std", 14), ("min", "min", 7), ("max", "max", 14)):
        kept[f"hist_roll_{tag}_{n}"] = f"CASE WHEN count(y) OVER {frame.format(n)} = {n} THEN {fn}(y) OVER {frame.format(n)} END"
    kept |= {"hist_expanding_mean": f"avg(y) OVER {frame.format('UNBOUNDED')}", "hist_expanding_std": f"stddev_samp(y) OVER {frame.format('UNBOUNDED')}"}

    @reg.add("stream_history_features", f"WITH {SERIES_SQL} SELECT loto, unique_id, strftime(ds, '%Y-%m-%d') AS ds, {', '.join(f'round({e}, 6) + 0.0 AS {n}' for n, e in kept.items())} FROM series")
    def _(spark, sf):
        """The rows arrive in two batches, the older ones first; the second continues from the kept state."""
        place, rows = _place(spark), series(spark, sf)
        borders = rows.agg(F.percentile_approx("ds", [0.5])).first()[0]
        part = sum((F.when(F.col("ds") > F.lit(b), 1).otherwise(0) for b in borders), F.lit(0))
        marked = rows.select(*SERIES.keys, *SERIES.order, "y", part.alias("part"))
        for k in range(len(borders) + 1):
            marked.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{place}/in")
            stream = spark.readStream.schema(marked.drop("part").schema).parquet(f"{place}/in")
            query = history_stream(stream, SERIES).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
            query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{place}/out").select("loto", "unique_id", day("ds").alias("ds"), *[r(n).alias(n) for n in kept])


def _held(spark, path: str) -> bool:
    """Whether something was written there, in whatever file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
