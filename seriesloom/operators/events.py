"""Event logs: levels, duplicates, error findings, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_level, mask_secrets, stable_fingerprint


def record_events(df: DataFrame) -> DataFrame:
    """Complete raw events: level from the text where none is given, secrets masked, fingerprint."""
    level = F.col("level") if "level" in df.columns else F.lit(None).cast("string")
    out = df.withColumns({"level": F.coalesce(level, event_level(F.col("message"), F.col("source"))), "message": mask_secrets(F.col("message"))})
    if "payload" in out.columns:
        out = out.withColumn("payload", mask_secrets(F.col("payload")))
    return out.withColumn("fingerprint", stable_fingerprint(out))


def duplicate_events(df: DataFrame, min_count: int = 2, order: str = "ts") -> DataFrame:
    """Fingerprints seen at least ``min_count`` times, with the first event's fields and the time span."""
    fp = F.coalesce(F.col("fingerprint"), stable_fingerprint(df)) if "fingerprint" in df.columns else stable_fingerprint(df)
    first = F.min_by(F.struct(*[c for c in ("level", "category", "message", "source", "run_id") if c in df.columns]), F.col(order))
    out = df.withColumn("_fp", fp).groupBy(F.col("_fp").alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), first.alias("_f")
    )
    return out.where(F.col("count") >= int(min_count)).select("fingerprint", "count", "first_seen", "last_seen", "_f.*")


def error_findings(df: DataFrame) -> DataFrame:
    """Events of level ERROR or CRITICAL, or whose text reads like an error."""
    level = F.upper(F.coalesce(F.col("level"), F.lit("")))
    hit = level.isin("ERROR", "CRITICAL") | (event_level(F.col("message")) == "ERROR")
    return df.where(hit).withColumn("level", F.when(level == "", "ERROR").otherwise(level))


def event_summary(df: DataFrame, order: str = "ts") -> DataFrame:
    """Counts by level, by category and overall with the latest time, from one scan."""
    level = F.upper(F.coalesce(F.col("level"), F.lit("UNKNOWN")))
    category = F.coalesce(F.col("category"), F.lit("unknown"))
    base = df.select(level.alias("level"), category.alias("category"), F.col(order).alias("_t"))
    sets = [[F.col("level")], [F.col("category")], []]
    out = base.groupingSets(sets, "level", "category").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("count"), F.max("_t").alias("latest")
    )
    scope = F.when(F.col("_g") == 1, "level").when(F.col("_g") == 2, "category").otherwise("all")
    return out.select(scope.alias("scope"), F.coalesce("level", "category", F.lit("")).alias("name"), "count", "latest")


def latest_event(df: DataFrame, order: str = "ts") -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(1)
