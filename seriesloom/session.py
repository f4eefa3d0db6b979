"""Session settings and the few knobs the operators read from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = "seriesloom.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000


def build_session(app: str = "seriesloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect. Parallelism and memory are left to the cluster, or to `conf`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    base.update(conf)
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def rows_per_task(spark: SparkSession) -> int:
    """How many rows of one group a single task may sort; larger groups are split into blocks."""
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's, or a temporary one where the session is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="seriesloom-ckpt-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage on storage that all executors share: the folder the session names. Only a local session may go without."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read back: later passes read their own columns, not its joins again."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
