"""Tables that later steps read more than once, in the shared folder; they go when the owner says so."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder all executors share in spark.checkpoint.dir")
    folder = tempfile.mkdtemp(prefix="perfcap-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Written tables of one run of an operator. drop() removes those that the result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        """options are those of the parquet writer."""
        path = f"{shared_folder(self.spark)}/perfcap-llm-{uuid.uuid4().hex}"
        df.write.options(**options).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Removes all tables but the last `keep`."""
        gone, self.paths = self.paths[:len(self.paths) - keep], self.paths[len(self.paths) - keep:]
        for path in gone:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def free(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now: it does so when the driver collects garbage."""
        self.spark.sparkContext._jvm.System.gc()
