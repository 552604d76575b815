"""Series statistics, dataset summaries and capture quality."""

from pyspark.sql import DataFrame, Window, functions as F

from perfcap import fixed
from perfcap.functions.compare import greatest, least
from perfcap.operators import skew

SERIES = ["dataset_id", "series_id"]
STATISTICS = ["count", "min", "max", "avg", "median", "p90", "p95", "p99", "stddev", "trend_per_hour",
              "missing_sample_count"]
# Microseconds are taken relative to this instant before they become doubles, which keeps a slope
# over a few minutes exact to about 1e-10.  A slope does not depend on the origin.
_ORIGIN_MICROS = 1_700_000_000_000_000


def _moments() -> list:
    valid = F.col("value").isNotNull()
    hours = (F.unix_micros("ts") - F.lit(_ORIGIN_MICROS)) / F.lit(3.6e9)
    return [
        F.count("*").alias("count"),
        F.count("value").alias("valid_count"),
        least(F.col("value")).alias("min"),
        greatest(F.col("value")).alias("max"),
        F.avg("value").alias("avg"),
        F.stddev_pop("value").alias("stddev"),
        F.regr_slope("value", hours).alias("trend_per_hour"),
        F.min(F.when(valid, F.col("ts"))).alias("first_valid_ts"),
        F.max(F.when(valid, F.col("ts"))).alias("last_valid_ts"),
    ]


def _shown(rows: DataFrame, keys: list, ranked: dict) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        *keys, "count",
        zero(F.col("min")).alias("min"), zero(F.col("max")).alias("max"), zero(F.col("avg")).alias("avg"),
        *[zero(c).alias(n) for n, c in ranked.items()],
        zero(F.col("stddev")).alias("stddev"), zero(F.col("trend_per_hour")).alias("trend_per_hour"),
        (F.col("count") - F.col("valid_count")).alias("missing_sample_count"),
        "valid_count", "first_valid_ts", "last_valid_ts")


def series_moments(samples: DataFrame, keys: list = SERIES) -> DataFrame:
    """The statistics of :func:`series_stats` that are no percentiles: one scan, one shuffle of partial aggregates."""
    return _shown(samples.groupBy(*keys).agg(*_moments()), keys, {})


def series_stats(samples: DataFrame, keys: list = SERIES, materialize=None) -> DataFrame:
    """Eleven statistics per series, plus first/last valid timestamp and valid count.

    One shuffle of partial aggregates for the moments; exact percentiles as described in
    :func:`perfcap.operators.skew.grouped_quantiles`.  A series without valid samples reports 0.
    """
    rows = skew.grouped_quantiles(samples.select(*keys, "ts", "value"), keys, "value", fixed.PERCENTILES, _moments(), materialize)
    names = ["median", "p90", "p95", "p99"]
    return _shown(rows, keys, {n: F.get("quantiles", F.lit(i)) for i, n in enumerate(names)})


def dataset_summary(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Start, end, series count, sample count, nominal interval and gap count per dataset."""
    sizes = samples.groupBy("dataset_id").agg(F.count("*").alias("sample_count"))
    widths = series.groupBy("dataset_id").agg(F.count("*").alias("series_count"))
    return capture_quality(samples).join(sizes, "dataset_id").join(widths, "dataset_id")


def capture_quality(samples: DataFrame, slice_unit: str = "day") -> DataFrame:
    """First/last timestamp, first inter-sample difference and number of deviating differences.

    Works on the distinct timestamps of a dataset, in time order.  ``slice_unit`` bounds how much
    of a dataset one task orders.
    """
    stamps = samples.select("dataset_id", "ts").groupBy("dataset_id", "ts").agg(F.count("*").alias("_n"))
    return _gaps(stamps.select("dataset_id", "ts"), slice_unit)


def row_quality(rows: DataFrame, slice_unit: str = "day") -> DataFrame:
    """As :func:`capture_quality`, for one row per capture line: repeated timestamps are zero-length
    differences."""
    stamps = rows.groupBy("dataset_id", "ts").agg(F.count("*").alias("_repeats"))
    return _gaps(stamps, slice_unit)


def _gaps(stamps: DataFrame, slice_unit: str) -> DataFrame:
    repeats = F.col("_repeats") if "_repeats" in stamps.columns else F.lit(1)
    diffs = skew.running(stamps, ["dataset_id"], ["ts"], F.date_trunc(slice_unit, "ts"),
                         {"_prev": ("last", F.col("ts"))})
    seconds = (F.unix_micros("ts") - F.unix_micros("_prev")) / F.lit(1e6)
    diffs = diffs.withColumn("_diff", seconds).withColumn("_extra", repeats - 1)
    # The first difference is zero when the first timestamp repeats.
    first = diffs.groupBy("dataset_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.min_by("_diff", F.when(F.col("_diff").isNotNull(), F.col("ts"))).alias("_second"),
        F.max_by("_extra", F.when(F.col("_diff").isNull(), F.col("ts"))).alias("_head_extra"))
    first = first.select(
        "dataset_id", "start_time", "end_time",
        F.when(F.col("_head_extra") > 0, F.lit(0.0)).otherwise(F.col("_second")).alias("_nominal"))
    # One row per dataset against the ordered rows: salted, a dataset may be hot.
    joined = skew.salted_join(diffs, first, ["dataset_id"], F.col("ts"))
    deviates = F.abs(F.col("_diff") - F.col("_nominal")) > 0.5 * F.col("_nominal")
    zero_deviates = F.col("_nominal") > 0
    return joined.groupBy("dataset_id", "start_time", "end_time", "_nominal").agg(
        (F.count_if(deviates) + F.coalesce(F.sum(F.when(zero_deviates, F.col("_extra"))), F.lit(0)))
        .cast("long").alias("gap_count")
    ).select("dataset_id", "start_time", "end_time",
             F.coalesce("_nominal", F.lit(0.0)).alias("sample_interval_seconds"), "gap_count")


def inspect(datasets: DataFrame, series: DataFrame, top: int = 10) -> DataFrame:
    """Dataset summary plus the metrics of its first ``top`` series."""
    head = series.where(F.col("series_ord") <= top).groupBy("dataset_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("series_ord", "metric"))), lambda s: s["metric"])
        .alias("top_metrics"))
    return datasets.join(head, "dataset_id", "left")


def present_metrics(series: DataFrame) -> DataFrame:
    return series.select("dataset_id", F.lower("metric").alias("metric")).distinct()


def find_series(series: DataFrame, metric: str, instance: str | None = None, first: bool = False) -> DataFrame:
    """Series of a metric (and instance), ignoring case; ``first`` keeps the lowest ordinal per dataset."""
    found = series.where(F.lower("metric") == metric.lower())
    if instance is not None:
        found = found.where(F.lower("instance") == instance.lower())
    if not first:
        return found
    by_ord = Window.partitionBy("dataset_id").orderBy("series_ord")
    return found.withColumn("_rn", F.row_number().over(by_ord)).where("_rn = 1").drop("_rn")
