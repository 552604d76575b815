"""Tables that micro-batches write together: a batch counts when its mark is there, which is written last."""

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MARKS = "commits"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
    except AnalysisException:
        return None  # nothing written yet


def committed(spark: SparkSession, out_path: str, name: str, but: int | None = None) -> DataFrame | None:
    """Rows of the committed batches of a table; ``but`` leaves one batch out.  None if the table was never written."""
    marks, rows = _read(spark, f"{out_path}/{MARKS}"), _read(spark, f"{out_path}/{name}")
    if marks is None or rows is None:
        return None
    if but is not None:
        marks = marks.where(F.col("batch_id") != but)
    return rows.join(marks.select("batch_id").distinct(), "batch_id", "left_semi")


def write_batch(df: DataFrame, out_path: str, name: str, batch_id: int) -> None:
    """Replace what a batch has in a table, also by nothing."""
    df.write.mode("overwrite").parquet(f"{out_path}/{name}/batch_id={batch_id}")


def commit(spark: SparkSession, out_path: str, batch_id: int, at: datetime, counts: dict) -> None:
    """Write the mark of a batch, one file; from now on readers see the batch."""
    row = spark.createDataFrame([(at, *counts.values())], "committed_at timestamp, " + ", ".join(f"{c} long" for c in counts))
    row.coalesce(1).write.mode("overwrite").parquet(f"{out_path}/{MARKS}/batch_id={batch_id}")
