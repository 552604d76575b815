"""Status roll-ups over findings and warnings."""

from pyspark.sql import DataFrame, functions as F

from perfcap.functions.compare import severity_rank


def _status(rank):
    return F.when(rank == 3, "critical").when(rank == 2, "warning").otherwise("healthy")


def category_statuses(findings: DataFrame) -> DataFrame:
    return findings.groupBy("dataset_id", "category").agg(
        _status(F.max(severity_rank(F.col("severity")))).alias("status"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Counts per dataset; a severity outside the format counts as informational."""
    s = F.col("severity")
    return findings.groupBy("dataset_id").agg(
        F.count_if(s == "critical").alias("critical"), F.count_if(s == "warning").alias("warning"),
        F.count_if(~s.isin("critical", "warning")).alias("informational"),
        F.max(severity_rank(s)).alias("_rank"))


def score(findings: DataFrame, warnings: DataFrame, datasets: DataFrame) -> DataFrame:
    """Overall status, counts, category map and analysis status; datasets without findings are healthy."""
    counts = severity_counts(findings)
    by_category = category_statuses(findings).groupBy("dataset_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "status")))).alias("category_statuses"))
    warned = warnings.groupBy("dataset_id").agg(F.count("*").alias("warnings"))
    joined = datasets.select("dataset_id").join(counts, "dataset_id", "left").join(
        by_category, "dataset_id", "left").join(warned, "dataset_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select(
        "dataset_id", _status(F.coalesce("_rank", F.lit(0))).alias("overall_status"),
        zero("critical"), zero("warning"), zero("informational"),
        F.coalesce("category_statuses", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        .alias("category_statuses"),
        F.when(F.coalesce("warnings", F.lit(0)) > 0, "completed_with_warnings").otherwise("completed")
        .alias("analysis_status"))


def gate_on_warning(findings: DataFrame, datasets: DataFrame) -> DataFrame:
    """Whether a dataset has any warning or critical finding."""
    bad = findings.groupBy("dataset_id").agg(F.bool_or(F.col("severity").isin("warning", "critical")).alias("_bad"))
    return datasets.select("dataset_id").join(bad, "dataset_id", "left").select(
        "dataset_id", F.coalesce("_bad", F.lit(False)).alias("failed"))
