"""Capture files written by the tests: parsing, analysis, reports."""

import hashlib

import pytest
from pyspark.sql import functions as F

from perfcap.functions import parse
from perfcap.plans.analyze import analyze_path
from perfcap.sinks import reports, writers
from perfcap.sources import captures as C
from perfcap.sources.packs import RuleBook

CPU = [(f"04/23/2026 08:{i // 4:02d}:{i % 4 * 15:02d}.000", 85.0 + i % 7) for i in range(20)]

PACK = {
    "schema_version": "perfcap.pack/v1", "pack_id": "cpu-core", "pack_name": "CPU", "version": "1.0.0",
    "applicability": {"always": True},
    "recommendations": {"look": {"priority": "high", "text": "Look at <processes> | now.", "links": ["https://example.org"]}},
    "rules": [
        {"rule_id": "high-cpu", "severity": "warning", "category": "cpu", "title": "High CPU", "summary": "CPU above 80.",
         "conditions": [{"metric": "processor.percent_processor_time", "instance": "_Total", "aggregation": "avg", "operator": "gt",
                         "threshold": 80, "duration_percent": 20}], "recommendations": ["look"]},
        {"rule_id": "low-memory", "severity": "critical", "category": "memory", "title": "Low memory", "summary": "Memory is low.",
         "conditions": [{"metric": "memory.available_mbytes", "aggregation": "min", "operator": "lt",
                         "threshold": {"host_context": "total_physical_memory_mb", "factor": 0.05, "minimum": 64}}]},
    ],
}
HEADER = r'"(PDH-CSV 4.0)","\\SERVER01\Processor(_Total)\% Processor Time","\\SERVER01\Memory\Available MBytes"'


def write_capture(path, points, header=HEADER, memory=4096):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [header] + [f'"{t}","{v}","{memory}"' for t, v in points]
    path.write_text("\n".join(lines) + "\n")


def write_pack(folder, pack):
    yaml = pytest.importorskip("yaml")
    target = folder / pack["pack_id"]
    target.mkdir(parents=True, exist_ok=True)
    (target / "pack.yaml").write_text(yaml.safe_dump(pack, sort_keys=False))


def samples(spark, folder):
    return C.read_captures(spark, str(folder)).samples


def test_edge_cells(spark, tmp_path):
    text = "\n".join([
        "", "  ", HEADER, '"04/23/2026 08:00:00.000","12.5",""', '"04/23/2026 08:00:15.000","1,234","(5)"',
        '"not a time","1","2"', '"2026-04-23 08:00:30","1d"', '"4/23/2026 8:00:45.500 AM",1e2,NaN',
        '2026-04-23T08:01:00Z,"-3","7-","extra"', ""])
    (tmp_path / "x.csv").write_text("\ufeff" + text)
    c = C.read_captures(spark, str(tmp_path))
    rows = {(r.series_ord, str(r.ts)): r.value for r in c.samples.collect()}
    cpu = [rows[k] for k in sorted(rows) if k[0] == 1]
    memory = [rows[k] for k in sorted(rows) if k[0] == 2]
    assert cpu == [12.5, 1234.0, None, 100.0, -3.0]
    assert memory[:3] == [None, -5.0, None] and memory[3] != memory[3] and memory[4] == -7.0
    assert [r.message for r in c.warnings.collect()] == ["line 4 left out: no time in '\"not a time\"'"]
    d = c.datasets.first()
    assert (d.sample_count, d.row_count, d.gap_count, d.sample_interval_seconds) == (10, 5, 0, 15.0)
    assert (d.machine_name, d.input_digest[:16]) == ("SERVER01", d.dataset_id[3:])


@pytest.mark.parametrize("text,expected", [
    ("2026/04/23 08:00:00", "2026-04-23 08:00:00"), ("04-23-2026 08:00:00", "2026-04-23 08:00:00"), ("04-23-2026 08:00:00.250", "2026-04-23 08:00:00.25"),
    ("23 Apr 2026 08:00", "2026-04-23 08:00:00"), ("Thu, 23 Apr 2026 08:00:00 GMT", "2026-04-23 08:00:00"), ("23 apr 2026", "2026-04-23 00:00:00"),
    ("2026/4/3", "2026-04-03 00:00:00"), ("4/23/2026", "2026-04-23 00:00:00"), ("2026-04-23T08:00:00+02:00", "2026-04-23 06:00:00"),
    ("23-04-2026 08:00:00", None), ("23 Foo 2026 08:00", None), ("2026/13/01 08:00", None), ("Thu, ", None), ("12", None)])
def test_timestamps_of_other_forms(spark, text, expected):
    row = spark.createDataFrame([(f'"{text}"',)], "c string").select(parse.parse_ts(F.col("c")).cast("string").alias("ts")).first()
    assert row.ts == expected


def test_gaps_follow_file_order(spark, tmp_path):
    stamps = ["08:00:00", "08:00:15", "08:00:30", "08:01:30", "08:01:20", "08:01:35"]
    write_capture(tmp_path / "g.csv", [(f"04/23/2026 {s}.000", 1) for s in stamps])
    d = C.read_captures(spark, str(tmp_path)).datasets.first()
    assert (d.gap_count, str(d.start_time), str(d.end_time)) == (2, "2026-04-23 08:00:00", "2026-04-23 08:01:35")


def test_split_files_keep_line_order(spark, tmp_path):
    """A file in many splits gives the same tables as in one."""
    points = [(f"04/23/2026 {8 + i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}.000", i % 50) for i in range(6000)]
    points[4000] = ("bad", 0)
    write_capture(tmp_path / "long.csv", points)
    whole = C.read_captures(spark, str(tmp_path))
    expected = (whole.datasets.drop("path").first(), whole.warnings.first().message)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        parts = C.read_captures(spark, str(tmp_path))
        assert (parts.datasets.drop("path").first(), parts.warnings.first().message) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert expected[1].startswith("line 4002 left out:") and expected[0].row_count == 5999


def test_rejected(spark, tmp_path):
    (tmp_path / "head.csv").write_text(HEADER + "\n")
    write_capture(tmp_path / "bad.csv", [("never", 1)])
    write_capture(tmp_path / "good.csv", CPU)
    c = C.read_captures(spark, str(tmp_path))
    assert sorted(r.path.split("/")[-1] for r in c.rejected.collect()) == ["bad.csv", "head.csv"]
    assert c.datasets.count() == 1


def test_analysis_and_reports(spark, tmp_path):
    write_capture(tmp_path / "in" / "one" / "a.csv", CPU)
    write_capture(tmp_path / "in" / "two" / "b.csv", [(t, v - 60) for t, v in CPU], memory=100)
    (tmp_path / "in" / "two" / "host-context.json").write_text('{"TotalPhysicalMemoryMb": 8192, "LogicalProcessorCount": 4}')
    write_pack(tmp_path / "packs", PACK)
    a = analyze_path(spark, str(tmp_path / "in"), str(tmp_path / "packs"), F.lit("2026-05-01").cast("timestamp"))
    found = {(r.rule_id, r.severity): r for r in a.findings.collect()}
    assert set(found) == {("high-cpu", "warning"), ("low-memory", "critical")}
    detail = found[("high-cpu", "warning")].evidence[0].trigger_details[0]
    assert detail.expression == "avg(processor.percent_processor_time[_Total]) > 80 for >= 20% of samples"
    assert found[("low-memory", "critical")].evidence[0].trigger_details[0].expected_value == pytest.approx(409.6)
    assert [r.message for r in a.warnings.collect()] == [
        "Rule 'low-memory' in pack 'cpu-core' skipped: host_context.total_physical_memory_mb not provided."]

    status = {r.dataset.machine_name + r.input.source_path: r.summary for r in a.reports.collect()}
    assert status["SERVER01a.csv"].overall_status == "warning"
    assert status["SERVER01a.csv"].analysis_status == "completed_with_warnings"
    assert status["SERVER01b.csv"].category_statuses == {"memory": "critical"}
    text = "\n".join(r.markdown for r in reports.render_markdown(a.reports).collect())
    assert "### [WARNING] High CPU" in text and "- [HIGH] Look at <processes> | now." in text
    assert "| `memory.available_mbytes` | 100.00 | 100.00 | 100.00 | min(memory.available_mbytes) < 409.6 |" in text
    page = "\n".join(r.html for r in reports.render_html(a.reports).collect())
    assert "Look at &lt;processes&gt; | now." in page and "<processes>" not in page
    json_rows = reports.report_json(a.reports)
    assert json_rows.where(F.get_json_object("json", "$.findings[0].evidence.metrics[0].statistics.count") == "20").count() == 2

    writers.write_dataset_artifact(a.captures.samples, str(tmp_path / "artifact"))
    assert writers.read_runs(spark, str(tmp_path / "artifact"), "dataset_id").count() == 80
    writers.write_text_reports(reports.render_markdown(a.reports), "markdown", str(tmp_path / "md"))
    writers.write_json_rows(a.findings, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_results_are_replaced_per_run(spark, tmp_path):
    kind, path = "run_id string, n int", str(tmp_path / "t")
    read = lambda **o: sorted((r.run_id, r.n) for r in writers.read_runs(spark, path, **o).collect())
    assert writers.read_runs(spark, path) is None
    first = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3), (None, 4)], kind)
    writers.write_results(first, path)
    writers.write_results(spark.createDataFrame([("r1", 9)], kind), path)
    writers.write_results(spark.createDataFrame([], kind), path)
    assert read() == [("r1", 9), ("r2", 3)] and read(only=["r2", "none"]) == [("r2", 3)]
    writers.write_runs(spark.createDataFrame([], kind), path, runs=spark.createDataFrame([("r2",)], "run_id string"))
    assert read() == [("r1", 9)]

    many = spark.range(500).selectExpr("concat('x', id) AS run_id", "cast(id AS int) AS n")
    writers.write_runs(many, path, runs=many.select("run_id").limit(0))  # as after a loss: the rows are there, the manifest is not
    assert read() == [("r1", 9)]
    writers.write_results(many, path)
    assert len(read()) == 501 and len(list((tmp_path / "t" / "rows").glob("_bucket=*"))) <= writers.BUCKETS


def test_pack_files(spark, tmp_path):
    write_pack(tmp_path, PACK)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "pack.yaml").write_text("pack_id: x\nrules: [")
    book = RuleBook.read(spark, str(tmp_path))
    assert len(book.records) == 1 and len(book.errors) == 1 and "Failed to load pack" in book.errors[0]
    row = book.conditions.where("rule_id = 'low-memory'").first()
    assert (row.duration_percent, row.hc_factor, row.hc_min, row.hc_max) == (1.0, 0.05, 64.0, None)
    assert (book.has_host, book.has_windows, book.has_guards) == (True, False, False)


def test_faulty_and_repeated_packs(spark, tmp_path):
    """Packs that break the format, and second folders of a name, are not used; the rest are."""
    write_pack(tmp_path / "a", PACK)
    write_pack(tmp_path / "b", {**PACK, "pack_name": "Second"})
    write_pack(tmp_path / "a", {**PACK, "pack_id": "Bad_Id", "version": "1"})
    book = RuleBook.read(spark, str(tmp_path))
    assert [r["pack_name"] for r in book.records] == ["CPU"]
    assert [e.split(": ", 1)[1] for e in book.errors] == [
        "pack_id: 'Bad_Id' is not a letter followed by a-z, 0-9 and hyphens", "version: '1' is not three numbers joined by dots",
        "a folder of this name came before"]


ODD_NAMES = ["plain.csv", "with space.csv", "p%q.csv", "hash#1.csv", "a+b.csv", "grün [1] {x}.csv"]


def test_odd_file_names(spark, tmp_path):
    for i, name in enumerate(ODD_NAMES):
        write_capture(tmp_path / "in put" / name, CPU[i:])
    write_capture(tmp_path / "other" / "copy of plain.csv", CPU)
    (tmp_path / "other" / "tabs.csv").write_text("\t\n \t \n")
    c = C.read_captures(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r for r in c.datasets.collect()}
    assert sorted(found) == sorted([*ODD_NAMES, "copy of plain.csv"])
    first, copy = found["plain.csv"], found["copy of plain.csv"]  # equal files are a dataset each
    assert (copy.dataset_id, copy.input_digest, copy.sample_count) == (first.dataset_id + "_2", first.input_digest, first.sample_count)
    rejected = {r.path.rsplit("/", 1)[1]: r.reason for r in c.rejected.collect()}
    assert rejected == {"tabs.csv": "no parseable data rows"}


@pytest.mark.parametrize("limit", ["DIGEST_WHOLE", "HEADER_CELLS"])
def test_large_files_and_many_headers(spark, tmp_path, monkeypatch, limit):
    """Digests piece by piece, and headers too many to broadcast, give the same tables."""
    for i, name in enumerate(ODD_NAMES):
        write_capture(tmp_path / name, CPU[i:])
    whole = C.read_captures(spark, str(tmp_path))
    expected = [sorted(map(tuple, t.collect()), key=repr) for t in (whole.datasets, whole.samples)]
    monkeypatch.setattr(C, limit, 1)
    monkeypatch.setattr(C, "DIGEST_PIECE", 100)
    parts = C.read_captures(spark, str(tmp_path))
    assert [sorted(map(tuple, t.collect()), key=repr) for t in (parts.datasets, parts.samples)] == expected
    assert expected[0][0][2] in {hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ODD_NAMES}


def test_sinks_keep_other_datasets(spark, tmp_path):
    for day in ("a", "b"):
        rows = spark.createDataFrame([(f"ds_{day}", f"report {day}")], "dataset_id string, markdown string")
        writers.write_text_reports(rows, "markdown", str(tmp_path / "md"))
        writers.write_json_rows(rows, str(tmp_path / "json"), "dataset_id")
        writers.write_json_rows(rows, str(tmp_path / "added"))
    writers.write_json_rows(rows, str(tmp_path / "json"), "dataset_id")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "md")).collect()) == ["report a", "report b"]
    assert sorted(r.markdown for r in writers.read_runs(spark, str(tmp_path / "json"), "dataset_id", kind="json").collect()) == [
        "report a", "report b"]
    assert [r.markdown for r in spark.read.json(str(tmp_path / "added")).collect()] == ["report b"]  # a table without runs is replaced
