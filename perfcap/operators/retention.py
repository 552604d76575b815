"""Retention: what to delete, and the counters of a purge."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from perfcap import fixed


def purge_plan(runs: DataFrame, uploads: DataFrame, compares: DataFrame, now: datetime, days: int,
               batch: int = fixed.PURGE_BATCH) -> dict:
    """Runs, compare rows and uploads to delete, and the audit row.

    Finished runs older than the cutoff that are no baseline, oldest first, one bounded batch per call (the
    batch size is part of the operation); ``days <= 0`` deletes nothing.
    """
    cutoff = now - timedelta(days=max(days, 0))
    stamp = F.lit(cutoff).cast("timestamp")
    old = runs.where(
        F.lit(days > 0) & ~F.col("is_baseline") & F.col("status").isin("completed", "failed")
        & (F.col("completed_at") < stamp))
    purged = old.orderBy("completed_at", "run_id").limit(batch)
    ids = F.broadcast(purged.select("run_id"))  # at most one batch
    by_side = [compares.join(ids.withColumnRenamed("run_id", side), side, "left_semi")
               for side in ("baseline_run_id", "candidate_run_id")]
    compared = by_side[0].unionByName(by_side[1]).dropDuplicates(["compare_id"])
    touched = F.broadcast(purged.select("upload_id").distinct())
    kept = runs.join(ids, "run_id", "left_anti").select("upload_id")
    orphans = uploads.join(touched, "upload_id", "left_semi").join(
        kept.join(touched, "upload_id", "left_semi").distinct(), "upload_id", "left_anti")
    return {"runs": purged, "compares": compared, "uploads": orphans,
            "audit": _audit(purged, compared, orphans, cutoff, now)}


def _audit(purged, compared, orphans, cutoff, now):
    tag = lambda df, kind: df.select(F.lit(kind).alias("_kind"))
    rows = tag(purged, "run").unionByName(tag(compared, "compare")).unionByName(tag(orphans, "upload"))
    count = lambda kind: F.count_if(F.col("_kind") == kind)
    counted = rows.agg(count("run").alias("jobs_deleted"), count("compare").alias("compare_results_deleted"),
                       count("upload").alias("uploads_deleted"))
    # No audit row when nothing was deleted.
    return counted.where("jobs_deleted > 0").select(
        F.lit("retention.jobs_purged").alias("event_type"), F.lit("system").alias("entity_id"),
        "jobs_deleted", "compare_results_deleted", "uploads_deleted",
        F.lit(cutoff).cast("timestamp").alias("cutoff_utc"), F.lit(now).cast("timestamp").alias("created_at"))


def purge_audit(events: DataFrame, now: datetime, days: int):
    """(kept, deleted) audit events; ``days <= 0`` keeps all."""
    stamp = F.lit(now - timedelta(days=max(days, 0))).cast("timestamp")
    old = F.coalesce(F.lit(days > 0) & (F.col("created_at") < stamp), F.lit(False))
    return events.where(~old), events.where(old)
