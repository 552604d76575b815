"""Session defaults and lineage cuts."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "perfcap", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator relies on (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="perfcap-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table other stages share to the shared folder and read it back.

    Unlike a cached table it survives lost executors; unlike an RDD checkpoint later scans prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/perfcap-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is; nothing happens if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def lineage_cuts(spark: SparkSession):
    """A :func:`cut_lineage` whose tables go at the end; for work that repeats, such as a micro-batch."""
    paths = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(f"{shared_folder(spark).rstrip('/')}/perfcap-{uuid.uuid4().hex}")
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            remove(spark, path)
