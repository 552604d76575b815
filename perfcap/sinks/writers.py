"""Writers.  Every sink is idempotent per run: writing a run again replaces it, for readers at one instant.

A table of runs is a folder with ``rows``, in a fixed number of bucket directories however many runs there are, and a
``manifest`` with a row per write of a run, written last.  Readers take the rows of the last write of each run, so a
write that breaks off is never seen and a run that comes again, with fewer rows or none, is replaced whole.
"""

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from perfcap.session import cut_lineage

#: Directories of a table.
BUCKETS = 64
FORMATS = {"parquet": ("parquet", "zstd"), "json": ("json", "gzip")}
#: JSON keeps microseconds.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def bucket_of(run: Column) -> Column:
    return F.pmod(F.xxhash64(run.cast("string")), F.lit(BUCKETS)).cast("int")


def write_runs(df: DataFrame, path: str, by: str = "run_id", runs: DataFrame | None = None, kind: str = "parquet") -> None:
    """Replace the runs in ``df``; others stay.

    ``runs`` (a column ``by``) names the runs that are written, also those without a row; without it they are taken
    from ``df``, which is then written to the shared folder once.  Rows of no run (null) are not read back.  Buckets are
    rebalanced, so a run with a third of the rows is written by many tasks.
    """
    if runs is None:
        df = cut_lineage(df)
        runs = df.select(by)
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    name, compression = FORMATS[kind]
    rows = df.withColumns({"_version": F.lit(version), "_bucket": bucket_of(F.col(by))})
    rows.hint("rebalance", "_bucket").write.mode("append").options(compression=compression, timestampFormat=STAMP) \
        .partitionBy("_bucket").format(name).save(f"{path}/rows")
    runs.select(F.col(by).cast("string").alias("run")).where("run IS NOT NULL").distinct().select(
        "run", F.lit(version).alias("_version")).write.mode("append").parquet(f"{path}/manifest")


def read_runs(spark: SparkSession, path: str, by: str = "run_id", only: list | None = None, kind: str = "parquet",
              schema: str | None = None) -> DataFrame | None:
    """Rows of the last write of each run, or of the runs in ``only`` (their buckets are read alone).

    None if nothing was ever written whole.  ``schema`` (without the added columns) saves JSON a scan.
    """
    reader = spark.read.schema(f"{schema}, _version string, _bucket int") if schema else spark.read
    try:
        manifest = spark.read.schema("run string, _version string").parquet(f"{path}/manifest")
        rows = reader.format(FORMATS[kind][0]).load(f"{path}/rows")
    except AnalysisException:
        return None
    run = F.col(by).cast("string")
    if only is not None:
        names = [str(r) for r in only]
        buckets = [r.b for r in spark.createDataFrame([(n,) for n in names], "run string").select(bucket_of(F.col("run")).alias("b")).collect()]
        rows = rows.where(F.col("_bucket").isin(buckets) & run.isin(names))
        manifest = manifest.where(F.col("run").isin(names))
    last = manifest.groupBy("run").agg(F.max("_version").alias("_version"))
    return rows.withColumn("run", run).join(last, ["run", "_version"], "left_semi").drop("run", "_version", "_bucket")


def write_dataset_artifact(samples: DataFrame, path: str) -> None:
    """Samples as compressed parquet, a table of datasets."""
    write_runs(samples, path, "dataset_id")


def write_dataset_json(samples: DataFrame, path: str) -> None:
    """The same as gzip JSON lines."""
    write_runs(samples, path, "dataset_id", kind="json")


def write_results(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Replace the runs of ``df`` in a table of results; others stay."""
    write_runs(df, path, by)


def write_text_reports(rendered: DataFrame, column: str, path: str) -> None:
    """One directory per dataset with the rendered text; reports of other datasets stay."""
    rendered.select("dataset_id", F.col(column).alias("value")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").text(path)


def write_json_rows(df: DataFrame, path: str, by: str | None = None) -> None:
    """Catalog, validation or inspection rows as JSON lines.

    With ``by`` (such as a run id) the rows are a table of runs; without, they are the whole table and replace it.
    """
    if by:
        write_runs(df, path, by, kind="json")
    else:
        df.write.mode("overwrite").option("timestampFormat", STAMP).json(path)
