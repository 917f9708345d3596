"""Session plumbing shared by all operators: factory, table loading, checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "cairn", master: str | None = None, **conf: str) -> SparkSession:
    """Build or get a session with the settings the operators rely on (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Lazy scan of one parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where nothing names one, a local master gets a folder of its own that ends with the process; a cluster raises, as
    a machine's own disk is no shared folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    own = tempfile.mkdtemp(prefix="cairn-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a written table in the shared folder, read back.

    Parquet keeps columns apart and compressed, so readers take what they need and the planner knows the table's
    size; it outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
