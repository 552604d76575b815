"""Fixed schemas (DDL) of the tables."""

def top_level(ddl: str) -> list:
    """Fields of a DDL list, not splitting inside ``<>``."""
    parts, depth, part = [], 0, ""
    for ch in ddl + ",":
        if ch == "," and depth == 0:
            parts.append(part.strip())
            part = ""
            continue
        depth += (ch == "<") - (ch == ">")
        part += ch
    return parts


def struct_of(ddl: str) -> str:
    """``a T, b U`` -> ``STRUCT<a: T, b: U>``."""
    return "STRUCT<" + ", ".join(": ".join(p.split(" ", 1)) for p in top_level(ddl)) + ">"


STATS = ("count BIGINT, min DOUBLE, max DOUBLE, avg DOUBLE, median DOUBLE, p90 DOUBLE, p95 DOUBLE, p99 DOUBLE, "
         "stddev DOUBLE, trend_per_hour DOUBLE, missing_sample_count BIGINT")

CONDITION = ("metric STRING, instance STRING, aggregation STRING, operator STRING, threshold DOUBLE, "
             "hc_variable STRING, hc_factor DOUBLE, hc_min DOUBLE, hc_max DOUBLE, duration_percent DOUBLE, "
             "window_s BIGINT, step_s BIGINT, min_samples BIGINT")

RULE = ("rule_id STRING, severity STRING, category STRING, title STRING, summary STRING, explanation STRING, "
        "requires_any ARRAY<STRING>, requires_all ARRAY<STRING>, recommendation_ids ARRAY<STRING>, "
        f"conditions ARRAY<{struct_of(CONDITION)}>")

RECOMMENDATION = "rec_id STRING, priority STRING, text STRING, rationale STRING, links ARRAY<STRING>"


# One row per pack file; ``error`` is set (and the rest null) when the file cannot be read.
PACK_FILE = (
    "path STRING, error STRING, pack_id STRING, pack_name STRING, version STRING, schema_version STRING, "
    "description STRING, has_applicability BOOLEAN, always BOOLEAN, requires_any ARRAY<STRING>, "
    "requires_all ARRAY<STRING>, metric_aliases ARRAY<STRUCT<metric: STRING, glob: STRING>>, "
    f"recommendations ARRAY<{struct_of(RECOMMENDATION)}>, rules ARRAY<{struct_of(RULE)}>")

FINDINGS_JSON = (
    "ARRAY<STRUCT<finding_id: STRING, rule_id: STRING, severity: STRING, category: STRING, title: STRING, "
    "summary: STRING, evidence: STRUCT<metrics: ARRAY<STRUCT<canonical_metric: STRING>>>, "
    "recommendations: ARRAY<STRUCT<text: STRING>>>>")
