"""Rule packs: YAML files -> one row per pack -> flat tables."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from perfcap import fixed, schemas


def _number(value):
    if value is None or isinstance(value, bool):
        raise ValueError(f"not a number: {value!r}")
    return float(value)


def _condition(raw: dict) -> dict:
    for name in ("metric", "aggregation", "operator"):
        if raw.get(name) is None:
            raise ValueError(f"condition has no {name}")
    threshold = raw.get("threshold")
    if threshold is None:
        raise ValueError(f"condition on metric '{raw['metric']}' has no threshold")
    out = {
        "metric": raw["metric"], "instance": raw.get("instance"), "aggregation": raw["aggregation"],
        "operator": raw["operator"], "threshold": None, "hc_variable": None, "hc_factor": None, "hc_min": None,
        "hc_max": None, "window_s": None, "step_s": None, "min_samples": None,
        "duration_percent": _number(raw.get("duration_percent", fixed.DEFAULT_DURATION_PERCENT)),
    }
    if isinstance(threshold, dict):
        if not threshold.get("host_context"):
            raise ValueError("host threshold names no host_context variable")
        out["hc_variable"] = threshold["host_context"]
        out["hc_factor"] = _number(threshold.get("factor", 1.0))
        for column, name in (("hc_min", "minimum"), ("hc_max", "maximum")):
            if name in threshold:
                out[column] = _number(threshold[name])
    else:
        out["threshold"] = _number(threshold)
    window = raw.get("window")
    if window is not None:
        out["window_s"] = int(window.get("duration_seconds", 0))
        out["step_s"] = window.get("step_seconds")
        least = window.get("min_samples")
        out["min_samples"] = fixed.DEFAULT_MIN_SAMPLES if least is None else least
    return out


def _rule(raw: dict) -> dict:
    for name in ("rule_id", "severity", "category", "title", "summary"):
        if raw.get(name) is None:
            raise ValueError(f"rule '{raw.get('rule_id')}' has no {name}")
    guard = raw.get("applies_when") or {}
    return {
        **{n: raw.get(n) for n in ("rule_id", "severity", "category", "title", "summary", "explanation")},
        "requires_any": guard.get("requires_any") or [], "requires_all": guard.get("requires_all") or [],
        "recommendation_ids": raw.get("recommendations") or [],
        "conditions": [_condition(c) for c in raw.get("conditions") or []],
    }


def pack_record(raw: dict, path: str = "") -> dict:
    """Row of the pack table for a pack given as nested dictionaries; defaults applied."""
    for name in ("pack_id", "pack_name"):
        if raw.get(name) is None:
            raise ValueError(f"missing {name}")
    block = raw.get("applicability")
    return {
        "path": path, "error": None, "pack_id": raw["pack_id"], "pack_name": raw["pack_name"],
        "version": raw.get("version") or fixed.DEFAULT_VERSION,
        "schema_version": raw.get("schema_version"),
        "description": raw.get("description"),
        "has_applicability": block is not None, "always": bool((block or {}).get("always", False)),
        "requires_any": (block or {}).get("requires_any") or [],
        "requires_all": (block or {}).get("requires_all") or [],
        "metric_aliases": [{"metric": m, "glob": g} for m, globs in (raw.get("metric_aliases") or {}).items()
                           for g in globs],
        "recommendations": [
            {"rec_id": i, "priority": r.get("priority") or fixed.DEFAULT_PRIORITY, "text": r.get("text") or "",
             "rationale": r.get("rationale"), "links": r.get("links") or []}
            for i, r in (raw.get("recommendations") or {}).items()],
        "rules": [_rule(r) for r in raw.get("rules") or []],
    }


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    columns = [c.split(" ", 1)[0] for c in schemas.top_level(schemas.PACK_FILE)]
    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["value"]):
            try:
                rows.append(pack_record(yaml.safe_load(text), path))
            except (yaml.YAMLError, ValueError, TypeError, AttributeError, KeyError) as problem:
                rows.append({"path": path, "error": f"Failed to load pack at '{path}': {problem}"})
        yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)


def read_packs(spark: SparkSession, path: str, glob: str = "pack.yaml") -> DataFrame:
    """One row per pack file under ``path``; unreadable files are rows with ``error``."""
    text = (
        spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("path"), "value"))
    return text.mapInPandas(_parse_batches, schemas.PACK_FILE)


def packs_from(spark: SparkSession, packs: list) -> DataFrame:
    """Packs given as dictionaries (the YAML structure)."""
    return _literal(spark, [pack_record(p, f"inline/{p['pack_id']}") for p in packs])


def _literal(spark: SparkSession, records: list) -> DataFrame:
    """Records as a constant of the plan: no Python job each time the table is used."""
    text, kind = json.dumps(records), f"ARRAY<{schemas.struct_of(schemas.PACK_FILE)}>"
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), kind)))


class RuleBook:
    """The rule packs of a job.

    Packs are configuration (files written by people), so they are read once and become constants of the
    plan; what they contain decides which branches a plan needs.
    """

    def __init__(self, spark: SparkSession, records: list):
        self.records = [r for r in records if r["error"] is None]
        self.errors = [r["error"] for r in records if r["error"] is not None]
        self.files = _literal(spark, self.records)
        self.packs = pack_table(self.files)
        self.rules = rule_table(self.files)
        self.conditions = condition_table(self.files)
        self.recommendations = recommendation_table(self.files)
        self.aliases = alias_table(self.files)

    @classmethod
    def of(cls, spark: SparkSession, packs: list) -> "RuleBook":
        return cls(spark, [pack_record(p, f"inline/{p['pack_id']}") for p in packs])

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "RuleBook":
        """Packs under a folder, in path order (size of configuration, not of data).

        Files that cannot be read, repeat the name of an earlier folder or break the format are left out; ``errors`` says why.
        """
        from perfcap.operators.packs import usable_files

        rows = [r.asDict(recursive=True) for r in read_packs(spark, path).orderBy("path").collect()]
        readable = [r for r in rows if r["error"] is None]
        if not readable:
            return cls(spark, rows)
        used, refused = usable_files(_literal(spark, readable))
        paths = {r["path"] for r in used.select("path").collect()}
        why = [{**rows[0], "error": f"{r['path']}: {r['message']}"} for r in refused.orderBy("path", "message").collect()]
        return cls(spark, [r for r in rows if r["error"] is not None or r["path"] in paths] + why)

    def _any(self, test) -> bool:
        return any(test(c) for p in self.records for r in p["rules"] for c in r["conditions"])

    @property
    def has_host(self) -> bool:
        return self._any(lambda c: c["hc_variable"] is not None)

    @property
    def has_host_samples(self) -> bool:
        return self._any(lambda c: c["hc_variable"] is not None and c["window_s"] is None and c["aggregation"] != "trend")

    @property
    def has_windows(self) -> bool:
        return self._any(lambda c: c["window_s"] is not None)

    @property
    def has_window_percentiles(self) -> bool:
        return self._any(lambda c: c["window_s"] is not None and c["aggregation"].startswith("p"))

    @property
    def has_guards(self) -> bool:
        return any(r["requires_any"] or r["requires_all"] for p in self.records for r in p["rules"])


# --- flat tables ---------------------------------------------------------------

def pack_table(files: DataFrame) -> DataFrame:
    return files.where(F.col("error").isNull()).drop("error", "rules", "recommendations", "metric_aliases")


def rule_table(files: DataFrame) -> DataFrame:
    r = files.where(F.col("error").isNull()).select("pack_id", F.posexplode("rules").alias("rule_ord", "r"))
    return r.select("pack_id", "rule_ord", *[F.col(f"r.{n}").alias(n) for n in (
        "rule_id", "severity", "category", "title", "summary", "explanation", "requires_any", "requires_all",
        "recommendation_ids")], F.size("r.conditions").alias("n_conditions"))


def condition_table(files: DataFrame) -> DataFrame:
    r = files.where(F.col("error").isNull()).select("pack_id", F.posexplode("rules").alias("rule_ord", "r"))
    c = r.select("pack_id", "rule_ord", F.col("r.rule_id").alias("rule_id"),
                 F.posexplode("r.conditions").alias("cond_ord", "c"))
    return c.select("pack_id", "rule_ord", "rule_id", "cond_ord", "c.*")


def recommendation_table(files: DataFrame) -> DataFrame:
    return files.where(F.col("error").isNull()).select("pack_id", F.inline("recommendations"))


def alias_table(files: DataFrame) -> DataFrame:
    a = files.where(F.col("error").isNull()).select("pack_id", F.posexplode("metric_aliases").alias("ord", "a"))
    return a.select("pack_id", "ord", "a.metric", "a.glob")
