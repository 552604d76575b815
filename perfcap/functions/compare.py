"""Comparators, ranks and named-aggregation lookup."""

from pyspark.sql import Column, functions as F

from perfcap import fixed


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """``value op threshold`` as a never-null boolean.

    Spark orders NaN above every number; here any comparison with NaN is false.
    """
    usable = ~F.isnan(value) & ~F.isnan(threshold)
    result = (
        F.when(op == "gt", value > threshold)
        .when(op == "ge", value >= threshold)
        .when(op == "lt", value < threshold)
        .when(op == "le", value <= threshold)
        .when(op == "eq", F.abs(value - threshold) == 0)
    )
    return F.coalesce(usable & result, F.lit(False))


def severity_rank(severity: Column) -> Column:
    """critical 3, warning 2, informational 1, anything else 0."""
    return (
        F.when(severity == "critical", 3)
        .when(severity == "warning", 2)
        .when(severity == "informational", 1)
        .otherwise(0)
    )


def trend_severity_rank(severity: Column) -> Column:
    """As :func:`severity_rank`; run history also knows the short form ``info``."""
    return F.when(severity == "info", 1).otherwise(severity_rank(severity))


def severity_of_rank(rank: Column) -> Column:
    return F.when(rank == 3, "critical").when(rank == 2, "warning").when(rank == 1, "informational")


def position_in(value: Column, ordered: list) -> Column:
    """Index of ``value`` in ``ordered`` (for sorting); after the end if absent."""
    expr = None
    for i, item in enumerate(ordered):
        expr = F.when(value == item, i) if expr is None else expr.when(value == item, i)
    return expr.otherwise(len(ordered))


def aggregation(name: Column, prefix: str = "") -> Column:
    """Pick the statistics column an aggregation name stands for."""
    expr = None
    for agg in fixed.AGGREGATIONS:
        column = F.col(prefix + ("trend_per_hour" if agg == "trend" else agg))
        expr = F.when(name == agg, column) if expr is None else expr.when(name == agg, column)
    return expr


def least(value: Column) -> Column:
    """Smallest value of a group; NaN is the smallest here, the largest in Spark."""
    return F.when(F.count_if(F.isnan(value)) > 0, F.lit(float("nan"))).otherwise(F.min(value))


def greatest(value: Column) -> Column:
    """Largest value of a group, NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))
