"""Listing: filters, pages, workspace isolation."""

from pyspark.sql import DataFrame, functions as F

from perfcap import fixed


def in_workspace(df: DataFrame, workspace_id: str) -> DataFrame:
    """Rows of one workspace; on tables partitioned by workspace this prunes partitions."""
    return df.where(F.col("workspace_id") == workspace_id)


def page(limit: int | None = None, offset: int | None = None) -> tuple:
    """(take, skip): absent or non-positive limits are the default page, larger ones are clamped."""
    take = min(limit, fixed.PAGE_MAX) if limit and limit > 0 else fixed.PAGE_DEFAULT
    return take, offset if offset and offset > 0 else 0


def list_rows(df: DataFrame, filters: dict, order: list, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Equality filters whose value is not None, then one ordered page."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    take, skip = page(limit, offset)
    return df.orderBy(*order).offset(skip).limit(take)
