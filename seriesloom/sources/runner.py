"""Run a SQL transform over a source table and write the result to one or more sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import durable
from .writers import write_table

_PLACEHOLDER = re.compile(r"\{\{\s*source\s*\}\}")


@dataclass(frozen=True)
class Sink:
    path: str
    fmt: str = "parquet"
    mode: str = "replace"
    partition_by: tuple[str, ...] = ()


def run_table(source: DataFrame, transform_sql: str | None = None, partitions: int | None = None, by: Sequence[str] = (), sinks: Sequence[Sink] = ()) -> DataFrame:
    """``{{source}}`` in the SQL stands for the source frame; filters and columns reach its scan through the planner."""
    spark = source.sparkSession
    out = source
    if transform_sql:
        name = f"src_{uuid.uuid4().hex[:12]}"
        source.createOrReplaceTempView(name)
        try:
            out = spark.sql(_PLACEHOLDER.sub(name, transform_sql))
        finally:
            spark.catalog.dropTempView(name)
    if partitions or by:
        out = out.repartition(*([partitions] if partitions else []), *by)
    if len(sinks) > 1:
        out = durable(out)
    for s in sinks:
        write_table(out, s.path, s.mode, s.fmt, s.partition_by)
    return out
