"""Ingestion schedules: validation, due schedules, recorded runs."""

from pyspark.sql import Column, DataFrame, functions as F


def validate_schedules(schedules: DataFrame) -> DataFrame:
    """First violation of each schedule: (schedule_id, message)."""
    name = F.trim("name")
    trimmed = F.transform("pack_ids", lambda p: F.lower(F.trim(p)))
    bad_packs = (F.size("pack_ids") == 0) | F.exists(trimmed, lambda p: p == "") | (
        F.size(F.array_distinct(trimmed)) != F.size("pack_ids"))
    text = F.col("source_config_json")
    parsed = F.try_parse_json(text)
    is_object = F.trim(text).startswith("{")
    field = lambda n: F.get_json_object(text, f"$.{n}")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    path = field("path")
    message = (
        F.when((name == "") | (F.length(name) > 100), "name must be 1–100 non-whitespace characters")
        .when((F.col("interval_minutes") < 5) | (F.col("interval_minutes") > 1440),
              "intervalMinutes must be between 5 and 1440 (1 day)")
        .when(bad_packs, "packIds must contain at least one non-empty, non-duplicate pack ID")
        .when(parsed.isNull(), "sourceConfigJson is not valid JSON")
        .when(~is_object, "sourceConfigJson must be a JSON object")
        .when(F.coalesce(field("type") != "directory", F.lit(True)), F.concat(
            F.lit("unsupported source type '"), F.coalesce(field("type"), F.lit("(missing)")),
            F.lit("' — v1 supports only 'directory'")))
        .when(blank(path), "source 'path' is required and must be non-empty")
        .when(~path.rlike(r"^(/|[A-Za-z]:[\\/])") | F.contains(path, F.lit("..")),
              "source 'path' must be absolute and free of '..' segments")
        .when(blank(field("glob")), "source 'glob' is required and must be non-empty"))
    return schedules.select("schedule_id", message.alias("message")).where("message IS NOT NULL")


def due_schedules(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.where(F.col("enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)))


def record_run(schedules: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Set last and next run of the schedules in ``ids``."""
    ran = schedules.join(ids.select("schedule_id", F.lit(True).alias("_ran")), "schedule_id", "left")
    following = now + F.make_dt_interval(mins=F.col("interval_minutes"))
    return ran.select(
        *[c for c in schedules.columns if c not in ("last_run_at", "next_run_at")],
        F.when(F.col("_ran"), now).otherwise(F.col("last_run_at")).alias("last_run_at"),
        F.when(F.col("_ran"), following).otherwise(F.col("next_run_at")).alias("next_run_at"))
