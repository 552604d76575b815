"""Counter paths -> canonical metrics."""

from pyspark.sql import DataFrame, functions as F

from perfcap.functions import names
from perfcap.functions.aliases import builtin_table


def pack_patterns(pack_aliases: DataFrame) -> DataFrame:
    """Glob aliases of packs as ordered regexes: (ord, pattern, metric)."""
    return pack_aliases.select("ord", names.glob_to_regex(F.col("glob")).alias("pattern"), "metric")


def first_match(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lowest-ordered alias whose regex matches each path.

    ``paths`` must be distinct: regexes run once per path, never per sample.  ``aliases`` is a few hundred rows
    (configuration) and is broadcast; only paths with a match come back.
    """
    hits = paths.join(F.broadcast(aliases), names.like_regex(F.col("counter_path"), F.col("pattern")))
    return hits.groupBy("counter_path").agg(F.min_by("metric", "ord").alias("metric"), F.min("ord").alias("ord"))


def resolve_metrics(paths: DataFrame, pack_aliases: DataFrame | None = None) -> DataFrame:
    """(counter_path, metric) for each distinct path: built-in pattern, pack alias, else ``unknown.…``."""
    spark = paths.sparkSession
    path = F.col("counter_path")
    distinct = paths.select("counter_path").distinct()
    patterns = builtin_table(spark)
    if pack_aliases is not None:
        # After the built-in names, in the order of the packs.
        patterns = patterns.unionByName(pack_patterns(pack_aliases).withColumn("ord", F.col("ord") + 1_000_000))
    known = distinct.join(first_match(distinct, patterns), "counter_path", "left")
    return known.select("counter_path", F.coalesce("metric", names.unknown_metric(path)).alias("metric"))
