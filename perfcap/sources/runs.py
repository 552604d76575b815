"""Run history from stored findings documents."""

from pyspark.sql import DataFrame, functions as F

from perfcap import schemas


def read_runs(results: DataFrame):
    """(findings, warnings) from (workspace_id, run_id, findings_json).

    A document that is no JSON array yields no findings and a warning row; a blank one yields nothing.
    """
    text = F.col("findings_json")
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    rows = results.where(~blank).withColumn("_ok", F.try_parse_json(text).isNotNull() & F.trim(text).startswith("["))
    parsed = rows.where("_ok").select(
        "workspace_id", "run_id", F.posexplode(F.from_json(text, schemas.FINDINGS_JSON)).alias("_pos", "f"))
    findings = parsed.select(
        "workspace_id", "run_id", (F.col("_pos") + 1).cast("long").alias("finding_ord"), "f.finding_id", "f.rule_id",
        F.get(F.col("f.evidence.metrics"), F.lit(0))["canonical_metric"].alias("metric"), "f.severity", "f.category",
        "f.title", "f.summary",
        F.transform(F.filter("f.recommendations", lambda r: r["text"].isNotNull()), lambda r: r["text"]).alias("recommendations"))
    warnings = rows.where("NOT _ok").select(
        "workspace_id", "run_id", F.lit("run.findings_malformed").alias("code"),
        F.concat(F.lit("Run '"), F.col("run_id"), F.lit("': findings are not a JSON array, skipping.")).alias("message"))
    return findings, warnings


def findings_json(findings: DataFrame) -> DataFrame:
    """(workspace_id, run_id, findings_json): the stored form of the findings of each run (rule-book sized)."""
    item = F.struct(
        "finding_ord", "finding_id", "rule_id", "severity", "category", "title", "summary",
        F.struct(F.array(F.struct(F.col("metric").alias("canonical_metric"))).alias("metrics")).alias("evidence"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda i: i.dropFields("finding_ord"))
    return findings.groupBy("workspace_id", "run_id").agg(F.to_json(ordered).alias("findings_json"))
