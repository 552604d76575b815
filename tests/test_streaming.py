"""Streams: folder watch, content dedup, incremental analysis, alert state equal to the batch operator."""

import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from perfcap.operators import alerts as A
from perfcap.plans import views
from perfcap.sources.packs import RuleBook
from perfcap.streaming import alerts as SA, captures as SC, commits

from test_captures import CPU, PACK, write_capture

SF = "/root/testdata/sf0.001"


def rows(spark, out, name, *columns):
    table = commits.committed(spark, str(out), name)
    return [] if table is None else sorted(map(tuple, table.select(*columns).collect()))


def watch(spark, tmp_path, out, **options):
    stream = SC.capture_stream(spark, str(tmp_path / "in"), max_files=10)
    return SC.start_analysis(stream, RuleBook.of(spark, [PACK]), str(out), str(tmp_path / "cp"), {"availableNow": True}, **options)


def test_captures_are_analysed_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    write_capture(folder / "a + %b#1 é[2].csv", CPU)
    write_capture(folder / "copy.csv", CPU)
    watch(spark, tmp_path, out).awaitTermination(240)
    assert len(rows(spark, out, "datasets", "dataset_id")) == 1
    assert rows(spark, out, "findings", "rule_id") == [("high-cpu",)]
    assert rows(spark, out, "files", "status", "reason") == [("analysed", None), ("copy", f"same content as {folder}/a + %b#1 é[2].csv")]
    assert sorted(r[0] for r in rows(spark, out, "reports", "kind")) == ["html", "json", "markdown"]
    assert rows(spark, out, "compares", "status") == []
    time.sleep(0.01)
    write_capture(folder / "again.csv", CPU)
    write_capture(folder / "b.csv", [(t, v - 60) for t, v in CPU])
    watch(spark, tmp_path, out).awaitTermination(240)
    assert len(rows(spark, out, "datasets", "dataset_id")) == 2
    assert len(rows(spark, out, "findings", "rule_id")) == 1
    assert [s for s, in rows(spark, out, "files", "status")] == ["analysed", "analysed", "copy", "copy"]
    assert rows(spark, out, "compares", "status") == [("resolved",)]  # against the run before, of the same machine
    assert rows(spark, out, "alert_history", "rule_id", "outcome") == [("high-cpu", "created")]
    assert rows(spark, out, "commits", "files", "analysed", "runs") == [(2, 1, 1), (2, 1, 1)]


def test_batch_that_ends_between_two_tables(spark, tmp_path, monkeypatch):
    """Nothing of it is seen; the same batch, come again, is whole and there once."""
    out = tmp_path / "out"
    write_capture(tmp_path / "in" / "a.csv", CPU)
    write, done = SC.write_batch, []

    def failing(df, path, name, batch_id):
        if name == "compares":
            raise RuntimeError("lost")
        done.append(name)
        write(df, path, name, batch_id)

    monkeypatch.setattr(SC, "write_batch", failing)
    with pytest.raises(Exception, match="lost"):
        watch(spark, tmp_path, out).awaitTermination(240)
    assert "findings" in done and (out / "findings").exists() and rows(spark, out, "findings", "rule_id") == []
    monkeypatch.setattr(SC, "write_batch", write)
    watch(spark, tmp_path, out).awaitTermination(240)
    assert rows(spark, out, "findings", "rule_id") == rows(spark, out, "alert_history", "rule_id") == [("high-cpu",)]
    assert len(rows(spark, out, "files", "path")) == 1


def test_workspaces_and_files_that_grow(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for place in ("one/a.csv", "one/b.csv", "two/a.csv"):
        write_capture(folder / place, CPU)
    write_capture(folder / "two" / "grows.csv", CPU[:8])
    paths = [str(p) for p in sorted(folder.rglob("*.csv"))]
    book, now = RuleBook.of(spark, [PACK]), datetime.now(timezone.utc).replace(tzinfo=None)
    for p in paths[:3]:
        os.utime(p, (time.time() - 100,) * 2)
    options = {"workspace": lambda path: F.regexp_extract(path, "/([^/]+)/[^/]+$", 1), "stable_s": 30}
    SC.analyse_files(spark, paths, 0, book, out, now=now, **options)
    assert rows(spark, out, "files", "workspace_id", "status") == [("one", "analysed"), ("one", "copy"), ("two", "analysed"), ("two", "waiting")]
    runs = rows(spark, out, "runs", "workspace_id", "run_id")
    assert [w for w, _ in runs] == ["one", "two"] and len(set(runs)) == 2  # the same file, a dataset for each workspace
    SC.analyse_files(spark, [], 1, book, out, now=now + timedelta(seconds=5), **options)
    assert len(rows(spark, out, "runs", "run_id")) == 2
    write_capture(folder / "two" / "grows.csv", CPU[:12])
    SC.analyse_files(spark, [], 2, book, out, now=now + timedelta(seconds=500), **options)
    assert len(rows(spark, out, "runs", "run_id")) == 3
    assert max(r[0] for r in rows(spark, out, "datasets", "row_count")) == 20 and (12,) in rows(spark, out, "datasets", "row_count")


def test_alert_stream_equals_batch(spark, tmp_path):
    runs, findings = views.runs_history(spark, SF), views.findings_history(spark, SF)
    rows = A.lifecycle_input(A.finding_events(runs, findings, A.escalations(runs, findings)), views.alert_commands(spark, SF))
    source = tmp_path / "events"
    rows = rows.cache()
    for part in ("2024-01-10", "2024-01-20", "2024-03-01"):
        low = {"2024-01-10": "2000-01-01", "2024-01-20": "2024-01-10", "2024-03-01": "2024-01-20"}[part]
        rows.where((F.col("at") >= low) & (F.col("at") < part)).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.05)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    events = SA.alert_stream(stream)
    query = (events.writeStream.format("memory").queryName("alerts_out").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination(180)
    columns = ["workspace_id", "rule_id", "segment", "at", "action", "run_id", "outcome", "event", "alert_severity"]
    streamed = sorted(map(repr, spark.table("alerts_out").select(*columns).collect()))
    batch = sorted(map(repr, A.alert_history(
        A.finding_events(runs, findings, A.escalations(runs, findings)), views.alert_commands(spark, SF)).select(*columns).collect()))
    assert len(batch) > 100
    assert streamed == batch
    box = SA.outbox_stream(spark.table("alerts_out"), views.sinks(spark, SF))
    assert box.count() > 0
