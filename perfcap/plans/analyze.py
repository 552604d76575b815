"""Captures in, findings and reports out: the whole analysis of many captures as one set of plans."""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from perfcap.operators import packs as P, rules as R, stats as S
from perfcap.session import cut_lineage
from perfcap.sinks import reports
from perfcap.sources import captures as C
from perfcap.sources.packs import RuleBook


@dataclass
class Analysis:
    """Tables of an analysis."""

    captures: C.Captures
    stats: DataFrame
    findings: DataFrame
    warnings: DataFrame
    selected: DataFrame
    pack_errors: DataFrame
    reports: DataFrame


def analyze(captures: C.Captures, book: RuleBook, hosts: DataFrame, generated_at: Column, explicit: list = (),
            auto: bool = True, materialize=cut_lineage) -> Analysis:
    """Analyse every capture against the selected packs.

    The tables that several outputs share (samples, series, datasets, statistics, findings) are written once to the
    shared folder; ``materialize=None`` keeps the plan lazy and computes them for every output.
    """
    keep = materialize or (lambda df: df)
    c = replace(captures, samples=keep(captures.samples), series=keep(captures.series), datasets=keep(captures.datasets))
    stats = keep(S.series_stats(c.samples, materialize=materialize))
    selected, errors = P.select_packs(book.packs, list(explicit), auto, S.present_metrics(c.series))
    findings, engine = R.evaluate_rules(
        c.samples, c.series, stats, c.datasets, hosts, book, selected, materialize=materialize)
    findings = keep(findings)
    columns = ["dataset_id", "code", "message", "severity", "ord"]
    warnings = c.warnings.select(*columns).unionByName(engine.select(*columns))
    built = reports.build_reports(c.datasets, c.series, stats, findings, warnings, selected, book.packs, generated_at)
    return Analysis(c, stats, findings, warnings, selected, errors, built)


def analyze_path(spark: SparkSession, path: str, pack_path: str, generated_at: Column | None = None, explicit: list = (),
                 auto: bool = True, memory_mb: float | None = None, processors: int | None = None,
                 machine_name: str | None = None, time_zone: str | None = None, glob: str = "*.csv", materialize=cut_lineage) -> Analysis:
    """Read captures, packs and host side files from folders and analyse them."""
    book = RuleBook.read(spark, pack_path)
    captures = C.read_captures(spark, path, glob, book.aliases, machine_name, time_zone, materialize)
    hosts = C.read_host_context(spark, path, captures.datasets, memory_mb, processors)
    return analyze(captures, book, hosts, F.current_timestamp() if generated_at is None else generated_at, explicit, auto, materialize)
