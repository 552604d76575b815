"""Registered queries over sources, names, packs and reports, with their SQL."""

import uuid

from pyspark.sql import functions as F

from perfcap.functions import aliases, names, parse, text
from perfcap.operators import normalize as N, packs as P, skew
from perfcap.plans import analyze as Z, event_rules, views
from perfcap.plans.queries_rules import Events, iso, sql_iso
from perfcap.plans.sqltext import lit, query, values
from perfcap.sinks import reports as R, writers
from perfcap.session import cut_lineage, remove, shared_folder
from perfcap.sources import captures as C, packs as S, runs as H
from perfcap.streaming import captures as live, commits

GLOBS = [("custom.counter", r"\\*\Custom Object\Counter Name (m?)"), ("custom.any", r"\\*\Custom*"),
         ("db.reads", r"\\*\Database ==> Instances(*)\Reads (Attached) Latency")]


def _paths(spark, sf_dir):
    return views.counter_paths(spark, sf_dir).distinct()


def split_cells(spark, sf_dir):
    lines = views.capture_lines(spark, sf_dir)
    return lines.select("event_id", F.posexplode(parse.split_cells(F.col("line"))).alias("pos", "cell")).select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), "cell")


def timestamps(spark, sf_dir):
    lines = views.capture_lines(spark, sf_dir)
    return lines.select("event_id", F.coalesce(iso(parse.parse_ts(F.get(parse.split_cells(F.col("line")), F.lit(0)))), F.lit(""))
                        .alias("stamp"))


def numbers(spark, sf_dir):
    lines = views.capture_lines(spark, sf_dir)
    return lines.select("event_id", parse.parse_value(F.get(parse.split_cells(F.col("line")), F.lit(1))).alias("value"),
                        parse.parse_value(F.get(parse.split_cells(F.col("line")), F.lit(9))).alias("beyond"))


def machines(spark, sf_dir):
    return _paths(spark, sf_dir).select("counter_path", names.machine_of(F.col("counter_path")).alias("machine"))


def instances(spark, sf_dir):
    return _paths(spark, sf_dir).select(
        "counter_path", names.instance_of(F.col("counter_path")).alias("instance"),
        names.path_instance(F.col("counter_path")).alias("path_instance"),
        names.strip_instance(F.col("counter_path")).alias("stripped"))


def canonical(spark, sf_dir):
    p = _paths(spark, sf_dir)
    known = N.resolve_metrics(p)
    both = known.select("metric").unionByName(p.select(F.col("counter_path").alias("metric")))
    return both.select("metric", names.is_canonical(F.col("metric")).alias("valid")).distinct()


def metrics(spark, sf_dir):
    return N.resolve_metrics(views.counter_paths(spark, sf_dir))


def pack_globs(spark, sf_dir):
    table = spark.sql(values([(i, m, g) for i, (m, g) in enumerate(GLOBS)], ["ord", "metric", "glob"],
                             ["BIGINT", "STRING", "STRING"]).replace("\\", "\\\\"))
    return N.resolve_metrics(views.counter_paths(spark, sf_dir), table)


def unknown_names(spark, sf_dir):
    return _paths(spark, sf_dir).select("counter_path", names.unknown_metric(F.col("counter_path")).alias("metric"))


def ids(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", names.dataset_id(F.sha2("text", 256)).alias("dataset_id"),
                    names.series_id((F.col("doc_id") % 1200 + 1).cast("int")).alias("series_id"))


def unpivoted(spark, sf_dir):
    li = views.samples_li(spark, sf_dir)
    return li.groupBy("dataset_id", "metric", "instance").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), iso(F.max("ts")).alias("latest"))


def dispatch(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages").select(F.concat("url", F.when(F.col("page_id") % 3 == 0, ".CSV").when(
        F.col("page_id") % 3 == 1, ".blg").otherwise("")).alias("path"))
    p = p.withColumn("source_type", parse.file_extension(F.col("path")))
    return C.supported(p).groupBy("source_type").agg(F.count("*").alias("files"))


def dedup(spark, sf_dir):
    return C.dedup_uploads(views.uploads(spark, sf_dir)).select("upload_id", "workspace_id", "sha256", "file_name")


def dedup_known(spark, sf_dir):
    u = views.uploads(spark, sf_dir)
    known = u.where(F.col("upload_id") % 3 == 0)
    return C.dedup_uploads(u.where(F.col("upload_id") % 3 != 0), known).select("upload_id", "workspace_id")


def files_to_pick(spark, sf_dir):
    c = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 7 % 5003).alias("modificationTime"))
    return C.pick_files(c, F.timestamp_seconds(F.lit(1_700_003_000)), cursor=F.timestamp_seconds(F.lit(1_700_002_900))).select(
        "path", iso("modificationTime").alias("modified"))


def _capture_tables(spark, sf_dir):
    book = S.RuleBook.of(spark, [event_rules.CAPTURE_PACK])
    lines = views.event_capture_lines(spark, sf_dir)
    return C.captures_from(lines, views.event_capture_catalog(lines), book.aliases), book


def capture_samples(spark, sf_dir):
    c, _ = _capture_tables(spark, sf_dir)
    return c.samples.select("dataset_id", "series_id", "metric", "instance", iso("ts").alias("stamp"), "value", "ord")


def capture_files(spark, sf_dir):
    """The event captures written as files and read again: digests, lines and samples of each."""
    folder = f"{shared_folder(spark).rstrip('/')}/perfcap-files-{uuid.uuid4().hex}"
    views.event_capture_files(spark, sf_dir, folder)
    book = S.RuleBook.of(spark, [event_rules.CAPTURE_PACK])
    c = C.read_captures(spark, folder, "*.txt", book.aliases)
    place = F.concat(F.lit("/captures/ws"), F.regexp_extract("path", "/ws=([0-9]+)/", 1), F.lit("/"),
                     F.regexp_extract("path", "/day=([0-9]+)/", 1), F.lit(".csv"))
    sums = c.samples.groupBy("dataset_id", "series_id", "metric").agg(
        F.count("*").alias("lines"), F.count("value").alias("valid"), F.round(F.sum("value"), 4).alias("total"))
    found = c.datasets.select("dataset_id", place.alias("path"), "input_digest", "machine_name", "gap_count", "row_count")
    result = cut_lineage(found.join(sums, "dataset_id").drop("dataset_id"))
    remove(spark, folder)
    return result


def stream_commits(spark, sf_dir):
    """The event captures through the folder watch: committed findings with their alert and report."""
    folder = f"{shared_folder(spark).rstrip('/')}/perfcap-stream-{uuid.uuid4().hex}"
    views.event_capture_files(spark, sf_dir, f"{folder}/in")
    book = S.RuleBook.of(spark, [event_rules.CAPTURE_PACK])
    out = f"{folder}/out"
    stream = live.capture_stream(spark, f"{folder}/in", "*.txt", max_files=1000)
    live.start_analysis(stream, book, out, f"{folder}/checkpoint", {"availableNow": True}, _hosts,
                        workspace=lambda path: F.concat(F.lit("ws"), F.regexp_extract(path, "/ws=([0-9]+)/", 1))).awaitTermination()
    place = F.concat(F.lit("/captures/ws"), F.regexp_extract("path", "/ws=([0-9]+)/", 1), F.lit("/"),
                     F.regexp_extract("path", "/day=([0-9]+)/", 1), F.lit(".csv"))
    runs = commits.committed(spark, out, "runs").select("workspace_id", "run_id", place.alias("path"))
    found = commits.committed(spark, out, "run_findings").select("run_id", "rule_id", F.col("metric").alias("primary_metric"), "severity")
    alerts = commits.committed(spark, out, "alert_history").groupBy("run_id", "rule_id").agg(F.count("*").alias("alert_rows"))
    reports = commits.committed(spark, out, "reports").groupBy("run_id").agg(F.count("*").alias("documents"))
    result = cut_lineage(runs.join(found, "run_id").join(alerts, ["run_id", "rule_id"], "left").join(reports, "run_id", "left").select(
        "workspace_id", "path", "rule_id", "primary_metric", "severity", "alert_rows", "documents"))
    remove(spark, folder)
    return result


def capture_datasets(spark, sf_dir):
    c, _ = _capture_tables(spark, sf_dir)
    return c.datasets.select("dataset_id", "path", "machine_name", iso("start_time").alias("start_time"),
                             iso("end_time").alias("end_time"), "series_count", "sample_count",
                             F.round("sample_interval_seconds", 3).alias("sample_interval_seconds"), "gap_count")


def capture_warnings(spark, sf_dir):
    c, _ = _capture_tables(spark, sf_dir)
    return c.warnings.select("dataset_id", "code", "message", "severity")


def capture_rejected(spark, sf_dir):
    """Captures of the head lines alone have no data."""
    lines = views.event_capture_lines(spark, sf_dir)
    only = lines.where((F.col("ord") == 0) | F.col("path").contains("ws1"))
    return C.captures_from(only, views.event_capture_catalog(lines)).rejected.select("path", "reason")


def capture_series(spark, sf_dir):
    c, _ = _capture_tables(spark, sf_dir)
    return c.series.select("dataset_id", "series_id", "counter_path", "metric", "instance")


def _hosts(datasets):
    return datasets.select(
        "dataset_id", F.when(F.col("machine_name") != "WS1", F.lit(3000.0)).alias("total_physical_memory_mb"),
        F.lit(None).cast("int").alias("logical_processor_count"))


def _analysis(spark, sf_dir):
    c, book = _capture_tables(spark, sf_dir)
    return Z.analyze(c, book, _hosts(c.datasets), F.lit("2024-02-01 00:00:00").cast("timestamp"))


def capture_findings(spark, sf_dir):
    return _analysis(spark, sf_dir).findings.select(
        "dataset_id", "rule_id", "primary_metric", F.col("finding_ord").cast("bigint").alias("finding_ord"),
        F.round(F.get("evidence", F.lit(0))["trigger_details"][0]["actual_value"], 5).alias("actual_value"),
        F.get("evidence", F.lit(0))["trigger_details"][0]["expression"].alias("expression"))


def report_documents(spark, sf_dir):
    j = F.col("json")
    at = lambda p: F.get_json_object(j, p)
    docs = R.report_json(_analysis(spark, sf_dir).reports)
    return docs.select(
        "dataset_id", at("$.report_id").alias("report_id"), at("$.summary.overall_status").alias("overall_status"),
        at("$.summary.analysis_status").alias("analysis_status"),
        at("$.summary.finding_counts.critical").cast("bigint").alias("critical"),
        at("$.summary.finding_counts.warning").cast("bigint").alias("warning"),
        at("$.dataset.start_time_utc").alias("start_time_utc"),
        F.json_array_length(at("$.series_index")).cast("bigint").alias("series"),
        F.coalesce(F.json_array_length(at("$.warnings")), F.lit(0)).cast("bigint").alias("warnings"),
        at("$.packs[0].pack_id").alias("pack"), at("$.findings[0].rule_id").alias("first_rule"))


def markdown(spark, sf_dir):
    return R.render_markdown(_analysis(spark, sf_dir).reports)


def html(spark, sf_dir):
    return R.render_html(_analysis(spark, sf_dir).reports)


def _used(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/perfcap-{name}-{uuid.uuid4().hex}"


def rewritten_results(spark, sf_dir):
    """Findings written for all runs, then again for runs of even days with their severity, and none for every fourth day."""
    f, path = views.findings_history(spark, sf_dir), _used(spark, "results")
    day = F.substring("run_id", -2, 2).cast("int")
    writers.write_results(f.withColumn("severity", F.lit("old")), path)
    writers.write_runs(f.where((day % 2 == 0) & (day % 4 != 0)), path, runs=f.where(day % 2 == 0).select("run_id").distinct())
    result = cut_lineage(writers.read_runs(spark, path).select("run_id", "rule_id", "metric", "severity", "finding_ord"))
    remove(spark, path)
    return result


def dataset_artifacts(spark, sf_dir):
    """Samples as parquet and as JSON lines, each written twice and read back."""
    s, parts = views.samples_ev(spark, sf_dir), []
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields)
    for kind, write in (("parquet", writers.write_dataset_artifact), ("json", writers.write_dataset_json)):
        path = _used(spark, kind)
        write(s.withColumn("value", F.lit(0.0)), path)
        write(s, path)
        back = writers.read_runs(spark, path, "dataset_id", kind=kind, schema=schema)
        parts.append(cut_lineage(back.groupBy("dataset_id", "metric").agg(
            F.count("*").alias("lines"), F.count("value").alias("valid"), F.round(F.sum("value"), 4).alias("total"),
            F.min(iso("ts")).alias("first_stamp")).withColumn("kind", F.lit(kind))))
        remove(spark, path)
    return parts[0].unionByName(parts[1])


def stored_runs(spark, sf_dir):
    f = views.findings_history(spark, sf_dir)
    docs = H.findings_json(f)
    broken = F.when(F.substring("run_id", -1, 1) == "3", F.concat(F.lit("{"), F.col("findings_json"))).when(
        F.substring("run_id", -1, 1) == "7", " ").otherwise(F.col("findings_json"))
    found, warnings = H.read_runs(docs.withColumn("findings_json", broken))
    return found.select("run_id", "rule_id", "metric", "severity", "finding_id", "finding_ord").unionByName(
        warnings.select("run_id", F.col("code").alias("rule_id")), allowMissingColumns=True)


def pack_list(spark, sf_dir):
    """The catalog of the packs of rules and of those made of parts, and how many samples the metrics of each pack name."""
    book = S.RuleBook.of(spark, event_rules.ALL_PACKS)
    packs, rules, conditions, _ = views.part_packs(spark, sf_dir)
    catalog = P.pack_catalog(book.packs.select(packs.columns).unionByName(packs), book.rules.select("pack_id").unionByName(rules.select("pack_id")))
    named = book.conditions.select("pack_id", "metric").unionByName(conditions.select("pack_id", "metric"))
    samples = views.samples_ev(spark, sf_dir).select("metric").unionByName(views.samples_li(spark, sf_dir).select("metric"))
    return catalog.join(P.named_samples(named, samples), "pack_id", "left").select(
        "pack_id", "pack_name", "version", "schema_version", "rule_count", "always_applicable", "applicability", "path",
        F.coalesce("samples", F.lit(0).cast("bigint")).alias("samples"))


def registry(spark, sf_dir):
    """Parts as packs: brand = pack, size = version, retail price order = load order."""
    p = views.table(spark, sf_dir, "part")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("p_partkey"))
    loads = p.where(F.col("p_partkey") % 2 == 0).select(
        F.col("p_brand").alias("pack_id"), F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("version"),
        F.col("p_name").alias("title"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("path"), at.alias("loaded_at"))
    old = p.where(F.col("p_partkey") % 2 == 1)
    current = old.groupBy(F.col("p_brand").alias("pack_id")).agg(F.lit("0.0.1").alias("current_version"), F.lit("old").alias("title"),
                                                                 F.lit("active").alias("status"), F.min(at).alias("created_at"), F.min(at).alias("updated_at"))
    versions = old.groupBy(F.col("p_brand").alias("pack_id"), F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("version")).agg(
        F.lit("/old").alias("storage_path"), F.min(at).alias("created_at"))
    now, history = P.upsert_pack_versions(current, versions, loads)
    return history.select("pack_id", "version", "storage_path", iso("created_at").alias("created_at")).unionByName(now.select(
        "pack_id", F.concat(F.lit("current "), F.col("current_version")).alias("version"), F.col("title").alias("storage_path"),
        iso("created_at").alias("created_at")))


def applicable(spark, sf_dir):
    e = Events(spark, sf_dir)
    return P.applicable_packs(e.book.packs, e.present)


def selected(spark, sf_dir):
    e = Events(spark, sf_dir)
    auto, _ = P.select_packs(e.book.packs, [], True, e.present, "no-block")
    named, errors = P.select_packs(e.book.packs, ["LINE-items", "nowhere"], False, e.present)
    tag = lambda n, df: df.withColumn("kind", F.lit(n))
    missing = errors.select(F.lit("").alias("dataset_id"), F.col("message").alias("pack_id"), F.lit("error").alias("resolution_mode"))
    return skew.union_all([tag("auto", auto), tag("explicit", named), tag("error", missing)])


def violations(spark, sf_dir):
    """Violations of the packs made of parts, and whether the pack may be used."""
    packs, rules, conditions, recommendations = views.part_packs(spark, sf_dir)
    found = P.validate_packs(packs, rules, conditions, recommendations)
    usable = P.valid_packs(packs, found).select("pack_id", F.lit(True).alias("usable"))
    counted = found.groupBy("pack_id", "subject", "level", "message").agg(F.count("*").alias("n"))
    return counted.join(usable, "pack_id", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def number_text(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.general(F.col("o_totalprice")).alias("price"),
                    text.general(F.col("o_orderkey") / F.lit(4.0)).alias("quarter"),
                    text.fixed2(F.col("o_totalprice")).alias("fixed"))


QUERIES = {
    "s2_split_cells": split_cells,
    "s3_timestamps": timestamps,
    "s4_numbers": numbers,
    "s5_machine_name": machines,
    "n4_n5_instances": instances,
    "n5_canonical_ids": canonical,
    "n1_metrics": metrics,
    "n2_pack_globs": pack_globs,
    "n3_unknown_names": unknown_names,
    "n6_ids": ids,
    "n7_unpivot": unpivoted,
    "s7_dispatch": dispatch,
    "s12_s13_upload_dedup": dedup,
    "s13_known_uploads": dedup_known,
    "l8_st3_pick_files": files_to_pick,
    "s1_capture_samples": capture_samples,
    "s1_s7_capture_files": capture_files,
    "st1_st4_st6_stream_commits": stream_commits,
    "s1_capture_series": capture_series,
    "s1_capture_datasets": capture_datasets,
    "s3_capture_warnings": capture_warnings,
    "s6_capture_rejected": capture_rejected,
    "c2_capture_findings": capture_findings,
    "k1_report_documents": report_documents,
    "k4_k5_dataset_artifacts": dataset_artifacts,
    "k8_rewritten_results": rewritten_results,
    "k2_markdown": markdown,
    "k3_html": html,
    "s14_stored_runs": stored_runs,
    "s10_pack_catalog": pack_list,
    "s11_pack_registry": registry,
    "f6_j3_applicable_packs": applicable,
    "j2_selected_packs": selected,
    "f11_pack_violations": violations,
    "c14_number_text": number_text,
}

_OBJ = "['" + "', '".join(o.replace("'", "''") for o in views.OBJECTS) + "']"
_NUM = r"'^[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
SRC = {
    "lines": r"""SELECT event_id, '"' || CASE event_id % 8 WHEN 0 THEN strftime(ts, '%m/%d/%Y %H:%M:%S.%g')
        WHEN 1 THEN strftime(ts, '%-m/%-d/%Y %-I:%M:%S.%g %p') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g')
        WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 4 THEN strftime(ts, '%-m/%-d/%Y %-H:%M:%S')
        WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END
        || '","' || CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '1,' || lpad(cents, 5, '0') WHEN 3 THEN '1d'
          WHEN 4 THEN '-' || cents ELSE cents END || '",x ' || event_type AS line, ts, cents
      FROM (SELECT *, round(value * 100)::BIGINT::VARCHAR AS cents FROM events)""",
    "cells": r"""SELECT event_id, regexp_extract_all(',' || line, ',((?:[^",]+|"[^"]*"?)*)', 1) AS cells, ts, cents FROM lines""",
    "paths": rf"""SELECT DISTINCT CASE WHEN l_linenumber = 6 THEN '\' || {_OBJ}[7] ELSE
        '\\SRV' || split_part(s_name, '#', 2)::INT || '\' || {_OBJ}[l_linenumber % 7 + 1] END AS counter_path
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "alias_list": values([(i, p, m) for i, (p, m) in enumerate(aliases.builtin_aliases())], ["ord", "pattern", "metric"],
                         ["INT", "VARCHAR", "VARCHAR"]),
    "resolved": """SELECT counter_path, arg_min(metric, ord) AS metric FROM paths
      JOIN alias_list ON regexp_matches(counter_path, pattern, 'i') GROUP BY ALL""",
    "unknown": r"""SELECT counter_path, 'unknown.' || trim(lower(regexp_replace(counter_path, '[^\p{L}\p{Nd}]', '_', 'g')), '_') AS metric
      FROM paths""",
    "cap": """SELECT *, '/captures/ws' || (user_id % 3) || '/' || strftime(ts, '%Y%m%d') || '.csv' AS path,
        event_id % 50 = 0 AS bad, row_number() OVER (PARTITION BY user_id % 3, strftime(ts, '%Y%m%d') ORDER BY event_id) AS line_no,
        list_position(['click','error','purchase','signup','view'], event_type) AS col FROM events""",
    "cap_text": r"""SELECT path, 0 AS line_no, '"(PDH-CSV 4.0)"' || string_agg(',"\\WS' || ws || '\Events(all)\' || t || '"', '' ORDER BY t) AS line
        FROM (SELECT DISTINCT path, user_id % 3 AS ws, unnest(['click','error','purchase','signup','view']) AS t FROM cap) GROUP BY path
      UNION ALL SELECT path, line_no, '"' || CASE WHEN bad THEN 'bad time' ELSE strftime(ts, '%m/%d/%Y %H:%M:%S.')
          || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') END || '"' || array_to_string(list_transform(
          CASE WHEN event_id % 30 = 0 THEN [1] ELSE [1, 2, 3, 4, 5] END,
          lambda c: ',"' || CASE WHEN c = col THEN value::VARCHAR ELSE '' END || '"'), '') FROM cap""",
    "cap_digests": """SELECT path, sha256(string_agg(line || chr(10), '' ORDER BY line_no)) AS input_digest FROM cap_text GROUP BY path""",
    "cap_good": """SELECT *, 'ds_' || substr(sha256(path), 1, 16) AS dataset_id, date_trunc('milliseconds', ts)::TIMESTAMP AS tms
      FROM cap WHERE NOT bad""",
    "cap_samples": """SELECT dataset_id, c AS series_ord, 'ser_00' || c AS series_id,
        CASE WHEN c = 5 THEN 'unknown.ws' || (user_id % 3) || '_events_all__view'
          ELSE 'events.' || ['click','error','purchase','signup'][c] END AS metric, 'all' AS instance, tms AS ts,
        CASE WHEN c = col AND (event_id % 30 <> 0 OR c = 1) THEN value END AS value, line_no AS ord
      FROM (SELECT *, unnest(range(1, 6)) AS c FROM cap_good)""",
    "cap_hits": """SELECT dataset_id, 'clicks' AS rule_id, 'events.click' AS primary_metric, round(quantile_cont(value, 0.95), 5) AS actual_value,
        'p95(events.click) > 90 for >= 12.5% of samples' AS expression, 'critical' AS severity, 'cpu' AS category
      FROM cap_samples WHERE series_ord = 1 AND value IS NOT NULL GROUP BY dataset_id HAVING 100.0 * count_if(value > 90) / count(*) >= 12.5
      UNION ALL SELECT dataset_id, 'errors', 'events.error', round(min(value), 5), 'min(events.error) < 10 for >= 15% of samples', 'warning', 'disk'
      FROM cap_samples WHERE series_ord = 2 AND value IS NOT NULL GROUP BY dataset_id HAVING 100.0 * count_if(value < 10) / count(*) >= 15
      UNION ALL SELECT dataset_id, 'memory', 'events.signup', round(avg(value), 5), 'avg(events.signup) > 60', 'warning', 'memory'
      FROM cap_samples WHERE series_ord = 4 AND value IS NOT NULL AND dataset_id NOT IN (SELECT dataset_id FROM cap_good WHERE user_id % 3 = 1)
      GROUP BY dataset_id HAVING 100.0 * count_if(value > 60) / count(*) >= 1""",
    "cap_gaps": """SELECT dataset_id, arg_min(diff, event_id) FILTER (WHERE diff IS NOT NULL) AS d0, list(diff) FILTER (WHERE diff IS NOT NULL) AS diffs
      FROM (SELECT dataset_id, event_id, (epoch_us(tms) - epoch_us(lag(tms) OVER (PARTITION BY dataset_id ORDER BY event_id))) / 1e6 AS diff
        FROM cap_good) GROUP BY dataset_id""",
    "pack_present": """SELECT dataset_id, list(metric) AS present FROM present_ev GROUP BY ALL""",
}

_PARTS = {
    "pk": "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'Pack_' ELSE 'pack-' END || p_partkey AS pack_id, * FROM part",
    "pk_rules": """SELECT *, 'rule-' || CASE WHEN k % 17 = 0 THEN 1 ELSE i END AS rule_id, (k + i) % 3 AS n_conditions
      FROM (SELECT *, unnest(range(1, k % 4 + 1)) AS i FROM pk)""",
    "pk_conds": """SELECT *, 'rule ' || rule_id || ', metric m' || j AS place, (k + i) % 4 = 0 AS windowed,
        CASE (k + i + j) % 8 WHEN 0 THEN 'sum' WHEN 4 THEN 'trend' ELSE 'avg' END AS agg
      FROM (SELECT *, unnest(range(1, n_conditions + 1)) AS j FROM pk_rules)""",
    "pk_found": """SELECT pack_id, 'pack' AS subject, 'error' AS level, unnest([
          CASE WHEN k % 13 = 0 THEN 'schema_version: unknown format ''other/v2''' END,
          CASE WHEN k % 7 = 0 THEN 'pack_id: ''' || pack_id || ''' is not a letter followed by a-z, 0-9 and hyphens' END,
          CASE WHEN k % 11 = 0 THEN 'pack_name: empty' END,
          CASE WHEN k % 5 = 0 THEN 'version: ''1.0'' is not three numbers joined by dots' END]) AS message FROM pk
      UNION ALL SELECT pack_id, 'pack', 'warning', 'pack ' || pack_id || ' has no rule' FROM pk WHERE k % 4 = 0
      UNION ALL SELECT pack_id, 'look', 'error', unnest([
          CASE WHEN k % 21 = 0 THEN 'recommendation look, priority: unknown value ''urgent''' END,
          CASE WHEN k % 22 = 0 THEN 'recommendation look, text: empty' END]) FROM pk
      UNION ALL SELECT pack_id, rule_id, 'error', unnest([
          CASE WHEN (k + i) % 9 = 0 THEN 'rule ' || rule_id || ', severity: unknown value ''fatal''' END,
          CASE WHEN (k + i) % 10 = 0 THEN 'rule ' || rule_id || ', category: unknown value ''none''' END,
          CASE WHEN (k + i) % 19 = 0 THEN 'rule ' || rule_id || ', title: empty' END,
          CASE WHEN (k + i) % 23 = 0 THEN 'rule ' || rule_id || ', summary: empty' END,
          CASE WHEN n_conditions = 0 THEN 'rule ' || rule_id || ', conditions: none' END,
          CASE WHEN (k + i) % 6 = 0 THEN 'rule ' || rule_id || ', recommendations: the pack has no ''missing''' END,
          CASE WHEN k % 17 = 0 AND i > 1 THEN 'rule ' || rule_id || ': the id is used more than once' END]) FROM pk_rules
      UNION ALL SELECT pack_id, rule_id, 'error', unnest([
          CASE WHEN agg = 'sum' THEN place || ', aggregation: unknown value ''sum''' END,
          CASE WHEN (k + j) % 12 = 0 THEN place || ', operator: unknown value ''ne''' END,
          CASE WHEN (k + i + j) % 14 = 0 THEN place || ', duration_percent: outside 0 to 100' END,
          CASE WHEN (k + j) % 15 = 0 THEN 'rule ' || rule_id || ', host variable: unknown value ''disk''' END,
          CASE WHEN windowed AND (k % 13 = 0 OR k % 2 = 0) THEN place || ', window: not known before format 1.1' END,
          CASE WHEN windowed AND agg <> 'avg' THEN place || ', window: ''' || agg || ''' has no rolling form' END,
          CASE WHEN windowed AND k % 50 + 10 < 30 THEN place || ', window duration: under 30 s' END,
          CASE WHEN windowed AND (k + j) % 60 < 1 THEN place || ', window step: under 1 s' END,
          CASE WHEN windowed AND (k + j) % 60 > k % 50 + 10 THEN place || ', window step: longer than the window' END,
          CASE WHEN windowed AND k % 3 < 1 THEN place || ', window min_samples: under 1' END]) FROM pk_conds""",
}


def src(body):
    from perfcap.plans.queries_runs import HIST
    return query(body, extra={**HIST, **SRC})


SQL = {
    "s2_split_cells": src("""SELECT event_id, unnest(range(0, len(cells))) AS pos, unnest(cells) AS cell FROM cells"""),
    "s3_timestamps": src(f"""SELECT event_id, CASE event_id % 8 WHEN 6 THEN '' WHEN 3 THEN {sql_iso("date_trunc('second', ts)")}
        WHEN 4 THEN {sql_iso("date_trunc('second', ts)")} WHEN 5 THEN {sql_iso("date_trunc('second', ts)")}
        ELSE {sql_iso("date_trunc('milliseconds', ts)")} END AS stamp FROM events"""),
    "s4_numbers": src(f"""SELECT event_id, CASE WHEN regexp_matches(trim(cells[2], '"'), {_NUM})
        THEN replace(trim(cells[2], '"'), ',', '')::DOUBLE END AS value, NULL::DOUBLE AS beyond FROM cells"""),
    "s5_machine_name": src(r"SELECT counter_path, nullif(regexp_extract(counter_path, '^\\\\([^\\]+)\\', 1), '') AS machine FROM paths"),
    "n4_n5_instances": src(r"""SELECT counter_path, CASE WHEN o > 0 AND c > o + 1 THEN substr(seg, o + 1, c - o - 1) END AS instance,
        CASE WHEN po > 0 AND pc > po THEN substr(counter_path, po + 1, pc - po - 1) ELSE '' END AS path_instance,
        CASE WHEN po > 0 THEN substr(counter_path, 1, po - 1) || substr(counter_path, pc + 1) ELSE counter_path END AS stripped
      FROM (SELECT *, CASE WHEN contains(seg, '(') THEN length(seg) - strpos(reverse(seg), '(') + 1 ELSE 0 END AS o,
          CASE WHEN contains(seg, ')') THEN length(seg) - strpos(reverse(seg), ')') + 1 ELSE 0 END AS c,
          CASE WHEN contains(counter_path, '(') THEN length(counter_path) - strpos(reverse(counter_path), '(') + 1 ELSE 0 END AS po,
          CASE WHEN contains(counter_path, ')') THEN length(counter_path) - strpos(reverse(counter_path), ')') + 1 ELSE 0 END AS pc
        FROM (SELECT counter_path, left(counter_path, length(counter_path) - strpos(reverse(counter_path), '\')) AS seg FROM paths))"""),
    "n5_canonical_ids": src("""SELECT DISTINCT metric, metric = lower(metric) AND NOT contains(metric, ' ') AND NOT contains(metric, '%') AS valid
      FROM (SELECT coalesce(r.metric, u.metric) AS metric FROM unknown u LEFT JOIN resolved r USING (counter_path)
        UNION ALL SELECT counter_path FROM paths)"""),
    "n1_metrics": src("""SELECT counter_path, coalesce(r.metric, u.metric) AS metric FROM unknown u
      LEFT JOIN resolved r USING (counter_path)"""),
    "n2_pack_globs": src(r"""SELECT counter_path, coalesce(r.metric, CASE
          WHEN contains(counter_path, '\Custom Object\Counter Name (m') THEN 'custom.counter'
          WHEN regexp_matches(counter_path, '\\\\.*\\Database ==> Instances\(.*\)\\Reads \(Attached\) Latency', 'i') THEN 'db.reads' END, u.metric) AS metric
      FROM unknown u LEFT JOIN resolved r USING (counter_path)"""),
    "n3_unknown_names": src("SELECT counter_path, metric FROM unknown"),
    "n6_ids": """SELECT doc_id, 'ds_' || substr(sha256(text), 1, 16) AS dataset_id,
        'ser_' || CASE WHEN doc_id % 1200 + 1 < 1000 THEN lpad((doc_id % 1200 + 1)::VARCHAR, 3, '0') ELSE (doc_id % 1200 + 1)::VARCHAR END
        AS series_id FROM documents""",
    "n7_unpivot": query(f"""SELECT dataset_id, metric, instance, count(*) AS n, round(sum(value), 2) AS total, {sql_iso('max(ts)')} AS latest
      FROM samples_li GROUP BY ALL"""),
    "s7_dispatch": "SELECT 'csv' AS source_type, count(*) AS files FROM pages WHERE page_id % 3 = 0",
    "s12_s13_upload_dedup": """SELECT DISTINCT ON (workspace_id, sha256) doc_id AS upload_id, source AS workspace_id, sha256(text) AS sha256,
        'cap_' || doc_id || '.csv' AS file_name FROM documents ORDER BY workspace_id, sha256, doc_id % 997, doc_id""",
    "s13_known_uploads": """SELECT DISTINCT ON (source, sha256(text)) doc_id AS upload_id, source AS workspace_id FROM documents d
      WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 3 = 0 AND k.source = d.source
        AND sha256(k.text) = sha256(d.text)) ORDER BY source, sha256(text), doc_id % 997, doc_id""",
    "l8_st3_pick_files": f"""SELECT doc_id::VARCHAR AS path, {sql_iso("make_timestamp((1700000000 + doc_id * 7 % 5003) * 1000000)")} AS modified
      FROM documents WHERE doc_id * 7 % 5003 <= 3000 - 30 AND doc_id * 7 % 5003 > 2900 - 120
      ORDER BY doc_id * 7 % 5003 DESC, doc_id::VARCHAR LIMIT 10""",
    "s1_capture_samples": src(f"""SELECT dataset_id, series_id, metric, instance, {sql_iso('ts')} AS stamp, value, ord FROM cap_samples"""),
    "st1_st4_st6_stream_commits": src("""SELECT 'ws' || (user_id % 3) AS workspace_id, path, rule_id, primary_metric, severity,
        1 AS alert_rows, 3 AS documents
      FROM cap_hits JOIN (SELECT DISTINCT dataset_id, path, user_id % 3 AS user_id FROM cap_good) USING (dataset_id)"""),
    "s1_s7_capture_files": src("""SELECT g.path, input_digest, 'WS' || (user_id % 3) AS machine_name, gap_count, row_count,
        series_id, metric, lines, valid, total
      FROM (SELECT DISTINCT path, user_id % 3 AS user_id, dataset_id FROM cap_good) g JOIN cap_digests USING (path)
      JOIN (SELECT dataset_id, series_id, metric, count(*) AS lines, count(value) AS valid, round(sum(value), 4) AS total
        FROM cap_samples GROUP BY ALL) USING (dataset_id)
      JOIN (SELECT dataset_id, len(list_filter(diffs, lambda x: abs(x - d0) > 0.5 * d0)) AS gap_count, len(diffs) + 1 AS row_count
        FROM cap_gaps) USING (dataset_id)"""),
    "s1_capture_series": src(r"""SELECT DISTINCT 'ds_' || substr(sha256(path), 1, 16) AS dataset_id, 'ser_00' || c AS series_id,
        '"\\WS' || (user_id % 3) || '\Events(all)\' || t || '"' AS counter_path,
        CASE WHEN c = 5 THEN 'unknown.ws' || (user_id % 3) || '_events_all__view' ELSE 'events.' || t END AS metric, 'all' AS instance
      FROM (SELECT *, unnest(range(1, 6)) AS c, unnest(['click','error','purchase','signup','view']) AS t FROM cap)"""),
    "s1_capture_datasets": src(f"""SELECT dataset_id, path, 'WS' || (user_id % 3) AS machine_name, {sql_iso('arg_min(tms, event_id)')} AS start_time,
        {sql_iso('arg_max(tms, event_id)')} AS end_time, 5::BIGINT AS series_count, 5 * count(*) AS sample_count,
        round(any_value(d0), 3) AS sample_interval_seconds,
        len(list_filter(any_value(diffs), lambda x: abs(x - any_value_d0) > 0.5 * any_value_d0)) AS gap_count
      FROM cap_good JOIN (SELECT *, d0 AS any_value_d0 FROM cap_gaps) USING (dataset_id) GROUP BY dataset_id, path, user_id % 3, any_value_d0"""),
    "s3_capture_warnings": src("""SELECT 'ds_' || substr(sha256(path), 1, 16) AS dataset_id, 'collector.warning' AS code,
        'line ' || (line_no + 1) || ' left out: no time in ''"bad time"''' AS message, 'warning' AS severity
      FROM cap WHERE bad"""),
    "s6_capture_rejected": src("SELECT DISTINCT path, 'no parseable data rows' AS reason FROM cap WHERE user_id % 3 <> 1"),
    "c2_capture_findings": src("""SELECT dataset_id, rule_id, primary_metric, actual_value, expression, row_number() OVER (PARTITION BY dataset_id
        ORDER BY severity, category, rule_id) AS finding_ord FROM cap_hits"""),
    "k1_report_documents": src(f"""SELECT g.dataset_id, 'rep_' || substr(sha256(sha256(any_value(path)) || '|event-captures@2.0.0'), 1, 20) AS report_id,
        CASE WHEN any_value(worst) = 'critical' THEN 'critical' WHEN any_value(worst) = 'warning' THEN 'warning' ELSE 'healthy' END AS overall_status,
        CASE WHEN any_value(bads) + any_value(user_id % 3 = 1)::INT > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS analysis_status,
        coalesce(any_value(c), 0) AS critical, coalesce(any_value(w), 0) AS warning,
        regexp_replace(strftime(min(tms), '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS start_time_utc, 5::BIGINT AS series,
        any_value(bads) + any_value(user_id % 3 = 1)::INT AS warnings, 'event-captures' AS pack, any_value(first_rule) AS first_rule
      FROM cap_good g LEFT JOIN (SELECT dataset_id, min(severity) AS worst, count_if(severity = 'critical') AS c, count_if(severity = 'warning') AS w,
          arg_min(rule_id, severity || category || rule_id) AS first_rule FROM cap_hits GROUP BY ALL) h USING (dataset_id)
        JOIN (SELECT 'ds_' || substr(sha256(path), 1, 16) AS dataset_id, count_if(bad) AS bads FROM cap GROUP BY ALL) b USING (dataset_id)
      GROUP BY g.dataset_id"""),
    "k4_k5_dataset_artifacts": src("""SELECT dataset_id, metric, count(*) AS lines, count(value) AS valid, round(sum(value), 4) AS total,
        """ + sql_iso("min(ts)") + """ AS first_stamp, kind FROM samples_ev, (SELECT unnest(['parquet', 'json']) AS kind) GROUP BY ALL"""),
    "k8_rewritten_results": src("""SELECT run_id, rule_id, metric, CASE WHEN right(run_id, 2)::INT % 2 = 0 THEN severity ELSE 'old' END AS severity,
        finding_ord FROM findings_hist WHERE right(run_id, 2)::INT % 4 <> 0"""),
    "s14_stored_runs": src("""SELECT run_id, rule_id, metric, severity, finding_id, row_number() OVER (PARTITION BY run_id ORDER BY finding_ord) AS finding_ord
      FROM findings_hist WHERE right(run_id, 1) NOT IN ('3', '7')
      UNION ALL SELECT DISTINCT run_id, 'run.findings_malformed', NULL, NULL, NULL, NULL FROM findings_hist WHERE right(run_id, 1) = '3'"""),
    "s10_pack_catalog": query("""SELECT *, coalesce((SELECT sum(n) FROM named JOIN counted USING (metric) WHERE named.pack_id = c.pack_id), 0)::BIGINT AS samples
      FROM (SELECT pack_id, CASE WHEN k % 11 = 0 THEN ' ' ELSE p_name END AS pack_name,
        CASE WHEN k % 5 = 0 THEN '1.0' ELSE '1.0.' || p_size END AS version,
        CASE WHEN k % 13 = 0 THEN 'other/v2' WHEN k % 2 = 0 THEN 'perfcap.pack/v1' ELSE 'perfcap.pack/v1.1' END AS schema_version,
        k % 4 AS rule_count, k % 3 = 1 AS always_applicable, CASE WHEN k % 3 = 0 THEN 'never (no applicability block)' WHEN k % 3 = 1 THEN 'always'
          WHEN k % 4 = 1 THEN 'all of: ' || p_brand WHEN k % 4 = 2 THEN 'any of: ' || p_brand ELSE 'never (empty applicability block)' END AS applicability,
        '/packs/' || k AS path FROM pk
      UNION ALL SELECT p.pack_id, p.pack_name, p.version, p.schema_version, (SELECT count(*) FROM rules r WHERE r.pack_id = p.pack_id), p.always,
        CASE WHEN NOT has_applicability THEN 'never (no applicability block)' WHEN always THEN 'always'
          WHEN len(requires_all) > 0 THEN 'all of: ' || array_to_string(requires_all, ', ')
          WHEN len(requires_any) > 0 THEN 'any of: ' || array_to_string(requires_any, ', ') ELSE 'never (empty applicability block)' END, p.path FROM packs p) c""",
        extra={**_PARTS, "named": "SELECT pack_id, lower(metric) AS metric FROM conditions UNION SELECT pack_id, 'm' || j FROM pk_conds",
               "counted": "SELECT metric, count(*) AS n FROM (SELECT metric FROM samples_ev UNION ALL SELECT metric FROM samples_li) GROUP BY ALL"}),
    "s11_pack_registry": f"""WITH p AS (SELECT *, p_size || '.0.0' AS v, make_timestamp((1600000000 + p_partkey) * 1000000) AS t FROM part)
      SELECT p_brand AS pack_id, v AS version, coalesce('/p/' || max(p_partkey) FILTER (WHERE p_partkey % 2 = 0), '/old') AS storage_path,
        {sql_iso('coalesce(min(t) FILTER (WHERE p_partkey % 2 = 1), min(t))')} AS created_at FROM p GROUP BY ALL
      UNION ALL SELECT p_brand, 'current ' || coalesce(arg_max(v, p_partkey) FILTER (WHERE p_partkey % 2 = 0), '0.0.1'),
        coalesce(arg_max(p_name, p_partkey) FILTER (WHERE p_partkey % 2 = 0), 'old'),
        {sql_iso('coalesce(min(t) FILTER (WHERE p_partkey % 2 = 1), min(t))')} FROM p GROUP BY p_brand""",
    "f6_j3_applicable_packs": src("""SELECT dataset_id, pack_id FROM pack_present, packs WHERE has_applicability AND (always OR CASE
        WHEN len(requires_all) > 0 THEN list_has_all(present, list_transform(requires_all, lambda x: lower(x)))
        ELSE list_has_any(present, list_transform(requires_any, lambda x: lower(x))) END)"""),
    "j2_selected_packs": src("""SELECT dataset_id, pack_id, 'auto' AS resolution_mode, 'auto' AS kind FROM pack_present, packs
        WHERE pack_id = 'no-block' OR (has_applicability AND (always OR CASE
          WHEN len(requires_all) > 0 THEN list_has_all(present, list_transform(requires_all, lambda x: lower(x)))
          ELSE list_has_any(present, list_transform(requires_any, lambda x: lower(x))) END))
      UNION ALL SELECT dataset_id, 'line-items', 'explicit', 'explicit' FROM pack_present
      UNION ALL SELECT '', 'no pack has the id ''nowhere''', 'error', 'error'"""),
    "f11_pack_violations": query("""SELECT pack_id, subject, level, message, count(*) AS n,
        pack_id NOT IN (SELECT pack_id FROM pk_found WHERE level = 'error' AND message IS NOT NULL) AS usable
      FROM pk_found WHERE message IS NOT NULL GROUP BY ALL""", extra=_PARTS),
    "c14_number_text": """SELECT o_orderkey, regexp_replace(o_totalprice::VARCHAR, '\\.0$', '') AS price,
        regexp_replace((o_orderkey / 4.0)::DOUBLE::VARCHAR, '\\.0$', '') AS quarter, printf('%.2f', o_totalprice) AS fixed FROM orders""",
}
