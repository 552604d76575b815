"""Built-in counter names: which counter path is which canonical metric."""

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values, one row per entry: pattern and metric, in matching order.
COUNTER_NAMES = Path(__file__).resolve().parents[1] / "data" / "counter_names.tsv"


def builtin_aliases(path: Path = COUNTER_NAMES) -> list[tuple[str, str]]:
    """(pattern, metric) in matching order."""
    lines = path.read_text(encoding="utf-8").splitlines()
    return [tuple(line.split("\t")) for line in lines if line and not line.startswith("#")]


def builtin_table(spark: SparkSession) -> DataFrame:
    """(ord, pattern, metric) as a constant of the plan."""
    rows = json.dumps([{"ord": i, "pattern": p, "metric": m} for i, (p, m) in enumerate(builtin_aliases())])
    kind = "ARRAY<STRUCT<ord: BIGINT, pattern: STRING, metric: STRING>>"
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(rows), kind)))
