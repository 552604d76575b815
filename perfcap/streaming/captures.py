"""Captures that arrive in a folder: watch, wait until stable, skip known content, analyse and commit each micro-batch."""

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from perfcap import fixed
from perfcap.operators import alerts as A, crossrun
from perfcap.plans.analyze import analyze
from perfcap.session import lineage_cuts
from perfcap.sinks import reports
from perfcap.sources import captures as C
from perfcap.streaming.commits import commit, committed, write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def capture_stream(spark: SparkSession, path: str, glob: str = "*.csv", max_files: int = fixed.FILES_PER_TICK) -> DataFrame:
    """New files (path, length, modificationTime), newest first, at most ``max_files`` per micro-batch; none is opened.

    The checkpoint of the query remembers which files were given out.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files).option("latestFirst", True).load(path))
    return files.select(C.file_name(F.col("_metadata.file_path")).alias("path"), "length", "modificationTime")


def _present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a few paths that are still there."""
    conf, there = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            there.append(path)
    return there


def judge_files(catalog: DataFrame, known: DataFrame | None, stable_until: Column) -> DataFrame:
    """The catalog (with workspace_id) with ``status`` and ``reason`` of each file.

    ``waiting``: changed after ``stable_until``; ``copy``: the workspace has this content, in ``known`` or under an earlier
    path of the catalog; else ``analysed``.
    """
    ready = F.col("modificationTime") <= stable_until
    first = F.min(F.when(ready, F.col("path"))).over(Window.partitionBy("workspace_id", "sha256"))
    rows = catalog.withColumn("_first", first)
    if known is None:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    else:
        seen = known.groupBy("workspace_id", "sha256").agg(F.min("path").alias("_known"))
        rows = rows.join(seen, ["workspace_id", "sha256"], "left")
    other = F.coalesce("_known", F.when(F.col("_first") != F.col("path"), F.col("_first")))
    status = F.when(~ready, "waiting").when(other.isNotNull(), "copy").otherwise("analysed")
    return rows.withColumn("status", status).withColumn(
        "reason", F.when(F.col("status") == "copy", F.concat(F.lit("same content as "), other))).drop("_first", "_known")


def history_findings(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings of an analysis in the form of the run history."""
    return findings.join(runs.select("dataset_id", "workspace_id", "run_id"), "dataset_id").select(
        "workspace_id", "run_id", F.col("finding_ord").cast("long").alias("finding_ord"), "finding_id", "rule_id",
        F.col("primary_metric").alias("metric"), "severity", "category", "title", "summary",
        F.transform("recommendations", lambda r: r["text"]).alias("recommendations"))


def _joined(earlier: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if earlier is None else earlier.select(new.columns).unionByName(new)


def analyse_files(spark: SparkSession, paths: list[str], batch_id: int, book, out_path: str, hosts_of=None, explicit: list = (),
                  auto: bool = True, workspace: Callable[[Column], Column] | None = None, stable_s: int = 0,
                  baseline: str | None = "previous", now: datetime | None = None) -> None:
    """One batch: judge the files, analyse the new ones, then reports, comparison and alerts; the mark comes last.

    Files that waited in earlier batches are judged again.  Rows of a batch that ends early are never read, and are
    replaced when the batch comes again.  ``baseline`` "previous" compares each run with the latest committed run of its
    workspace and machine.
    """
    now = now or datetime.now(timezone.utc).replace(tzinfo=None)
    files = committed(spark, out_path, "files", batch_id)
    if files is not None:
        last = Window.partitionBy("path").orderBy(F.desc("batch_id"))
        held = files.withColumn("_n", F.row_number().over(last)).where("_n = 1 AND status = 'waiting'")
        paths = sorted({*paths, *[r["path"] for r in held.select("path").collect()]})  # what arrived within stable_s
    paths = _present(spark, paths)
    if not paths:
        return
    unknown = lambda d: d.select(
        "dataset_id", F.lit(None).cast("double").alias("total_physical_memory_mb"),
        F.lit(None).cast("int").alias("logical_processor_count"))
    names = [C.open_name(p) for p in paths]
    with lineage_cuts(spark) as keep:
        place = (workspace or (lambda _: F.lit("default")))(F.col("path"))
        known = None if files is None else files.where("status = 'analysed'").select("workspace_id", "sha256", "path")
        stable_until = F.lit(now - timedelta(seconds=stable_s))
        catalog = keep(judge_files(C.capture_catalog(spark, names).withColumn("workspace_id", place), known, stable_until))
        fresh = catalog.where("status = 'analysed'")
        write_batch(catalog, out_path, "files", batch_id)
        new = [r["path"] for r in fresh.select("path").collect()]
        runs_written = 0
        if new:
            lines = C.read_lines(spark, [C.open_name(p) for p in new], "*")
            captures = C.captures_from(lines, fresh, book.aliases, materialize=keep)
            result = analyze(captures, book, (hosts_of or unknown)(captures.datasets), F.lit(now), explicit, auto, materialize=keep)
            earlier = committed(spark, out_path, "runs", batch_id)
            runs = result.captures.datasets.join(fresh.select("path", "workspace_id", "modificationTime"), "path").select(
                "workspace_id", F.concat_ws("/", "workspace_id", "dataset_id").alias("run_id"), "dataset_id", "path", "machine_name",
                F.lit("completed").alias("status"), F.col("modificationTime").alias("created_at"), F.lit(now).alias("completed_at"))
            if earlier is not None and baseline == "previous":
                machine = F.coalesce("machine_name", F.lit("")).alias("_machine")
                latest = earlier.groupBy("workspace_id", machine).agg(
                    F.max_by("run_id", F.struct("completed_at", "run_id")).alias("selected_baseline_id"))
                runs = runs.withColumn("_machine", F.coalesce("machine_name", F.lit(""))).join(latest, ["workspace_id", "_machine"], "left").drop("_machine")
            else:
                runs = runs.withColumn("selected_baseline_id", F.lit(None).cast("string"))
            runs = keep(runs)
            found = keep(history_findings(result.findings, runs))
            past = committed(spark, out_path, "run_findings", batch_id)
            all_runs, all_found = _joined(earlier, runs), _joined(past, found)

            pairs = runs.where("selected_baseline_id IS NOT NULL").select(
                F.col("selected_baseline_id").alias("baseline_run_id"), F.col("run_id").alias("candidate_run_id"))
            # Alerts of the rules that fired in this batch, from their whole history.
            mine = all_found.join(found.select("workspace_id", "rule_id").distinct(), ["workspace_id", "rule_id"], "left_semi")
            events = A.finding_events(all_runs, mine, A.escalations(all_runs, mine))
            history = A.alert_history(events, materialize=keep).join(runs.select("run_id"), "run_id", "left_semi")
            of_run = runs.select("dataset_id", "workspace_id", "run_id")
            shown = [(kind, column, rows) for kind, column, rows in (
                ("json", "json", reports.report_json(result.reports)), ("markdown", "markdown", reports.render_markdown(result.reports)),
                ("html", "html", reports.render_html(result.reports)))]
            documents = None
            for kind, column, rows in shown:
                part = rows.select("dataset_id", F.lit(kind).alias("kind"), F.col(column).alias("document")).join(of_run, "dataset_id")
                documents = part if documents is None else documents.unionByName(part)
            tables = {"datasets": result.captures.datasets, "series_stats": result.stats, "findings": result.findings,
                      "warnings": result.warnings, "rejected": captures.rejected, "runs": runs, "run_findings": found,
                      "reports": documents, "compares": crossrun.compare_runs(pairs, all_found), "alert_history": history}
            for name, table in tables.items():
                write_batch(table, out_path, name, batch_id)
            runs_written = runs.count()
        commit(spark, out_path, batch_id, now, {"files": len(paths), "analysed": len(new), "runs": runs_written})


def start_analysis(stream: DataFrame, book, out_path: str, checkpoint: str, trigger: dict | None = None, hosts_of=None,
                   explicit: list = (), auto: bool = True, workspace: Callable[[Column], Column] | None = None, stable_s: int = 0,
                   baseline: str | None = "previous"):
    """Analyse each micro-batch of :func:`capture_stream` and commit its tables together (:func:`analyse_files`).

    Read them with :func:`perfcap.streaming.commits.committed`.  ``hosts_of(datasets)`` gives the host variables (unknown by
    default), ``workspace(path)`` the workspace of a file; equal contents are skipped within a workspace only, with a row in
    ``files``.  Files changed in the last ``stable_s`` seconds wait for a later batch, or for a call of
    :func:`analyse_files` with no paths.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().collect()]  # at most files-per-tick
        analyse_files(batch.sparkSession, paths, batch_id, book, out_path, hosts_of, explicit, auto, workspace, stable_s, baseline)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()
