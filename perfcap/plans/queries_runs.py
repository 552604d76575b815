"""Registered queries over run history, alerts, retention, schedules and notifications, with their SQL."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from perfcap import fixed
from perfcap.operators import alerts as A, crossrun as X, listing as L, retention as T, schedules as G
from perfcap.plans import views
from perfcap.plans.queries_rules import iso, sql_iso
from perfcap.plans.sqltext import query, rank
from perfcap.session import cut_lineage, remove, shared_folder
from perfcap.streaming import alerts as live

NOW = datetime(1999, 1, 1)
NOW_SCHEDULE = datetime(2023, 11, 14, 23, 0)


def _hist(spark, sf_dir):
    return views.runs_history(spark, sf_dir), views.findings_history(spark, sf_dir)


def keyed(spark, sf_dir):
    _, f = _hist(spark, sf_dir)
    doubled = f.unionByName(f.withColumn("rule_id", F.upper("rule_id")).withColumn("finding_ord", F.col("finding_ord") + 100))
    return X.keyed_findings(doubled).select("run_id", "key", "correlation_key", "severity", "finding_ord")


def recent(spark, sf_dir):
    r, _ = _hist(spark, sf_dir)
    return X.recent_runs(r, 12).select("workspace_id", "run_id", F.col("run_ord").cast("bigint").alias("run_ord"))


def run_numbers(spark, sf_dir):
    r, _ = _hist(spark, sf_dir)
    return X.numbered_runs(r).select("workspace_id", "run_id", "run_ord")


def compare_adjacent(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    n = X.numbered_runs(r).select("workspace_id", "run_id", "run_ord")
    nxt = n.select("workspace_id", F.col("run_id").alias("candidate_run_id"), (F.col("run_ord") - 1).alias("run_ord"))
    pairs = n.withColumnRenamed("run_id", "baseline_run_id").join(nxt, ["workspace_id", "run_ord"])
    return pairs, f


def compare(spark, sf_dir):
    d = X.compare_runs(*compare_adjacent(spark, sf_dir))
    return d.select("baseline_run_id", "candidate_run_id", "status", "correlation_key",
                    F.col("baseline_finding.severity").alias("baseline_severity"),
                    F.col("candidate_finding.severity").alias("candidate_severity"),
                    F.col("candidate_finding.finding_id").alias("candidate_finding_id"),
                    F.col("diff_ord").cast("bigint").alias("diff_ord"))


def compare_summary(spark, sf_dir):
    return X.compare_summary(X.compare_runs(*compare_adjacent(spark, sf_dir)))


def changed(spark, sf_dir):
    return X.changed_keys(*compare_adjacent(spark, sf_dir))


def auto_compare(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    return X.auto_compare(r, f).groupBy("candidate_run_id", "baseline_run_id", "status").agg(F.count("*").alias("n"))


def trends(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    return X.trends(r, f).select(
        "workspace_id", "correlation_key", "direction", "run_count", "total_runs", "latest_severity",
        F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


def short_trends(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    return X.trends(r, f, 3).groupBy("workspace_id", "direction").agg(F.count("*").alias("n"))


def trend_points(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    t = X.trends(r, f, 6, with_points=True)
    point = lambda p: F.concat_ws("=", p["run_id"], F.coalesce(p["severity"], F.lit("none")))
    return t.select("workspace_id", "correlation_key", F.array_join(F.transform("run_points", point), ",").alias("points"))


def union_keys(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    return X.presence(r, f).select("workspace_id", "key").distinct()


def _trends(spark, sf_dir, last=fixed.TREND_DEFAULT_RUNS):
    """(findings, trend rows), the trends written once."""
    r, f = _hist(spark, sf_dir)
    return f, cut_lineage(X.trends_of(X.presence(r, f, last)))


def _trends_pairs(spark, sf_dir, last=fixed.TREND_DEFAULT_RUNS):
    f, t = _trends(spark, sf_dir, last)
    return f, t, X.correlations(t, materialize=cut_lineage)


def correlations(spark, sf_dir):
    _, _, p = _trends_pairs(spark, sf_dir)
    return p.select("workspace_id", "key_a", "key_b", "direction_a", "direction_b", "co_run_count", "total_runs",
                    F.round("co_score", 6).alias("co_score"), F.col("pair_ord").cast("bigint").alias("pair_ord"))


def correlations_short(spark, sf_dir):
    """A window of two runs: many keys in every run, so the worsening pairs decide."""
    _, _, p = _trends_pairs(spark, sf_dir, 2)
    return p.select("workspace_id", "key_a", "key_b", "direction_a", "direction_b", "co_run_count",
                    F.col("pair_ord").cast("bigint").alias("pair_ord"))


def correlations_long(spark, sf_dir):
    """A window of 100 runs (months of orders) with a key per customer: nearly every key has a run set of its own."""
    t = cut_lineage(X.trends_of(X.presence(views.order_months(spark, sf_dir), views.order_findings(spark, sf_dir), fixed.TREND_MAX_RUNS)))
    return X.correlations(t, materialize=cut_lineage).select(
        "workspace_id", "key_a", "key_b", "direction_a", "direction_b", "co_run_count", "total_runs",
        F.round("co_score", 6).alias("co_score"), F.col("pair_ord").cast("bigint").alias("pair_ord"))


def diagnostics(spark, sf_dir, last=fixed.TREND_DEFAULT_RUNS):
    f, t, p = _trends_pairs(spark, sf_dir, last)
    return X.diagnostics(f, t.drop("low", "high"), p).select(
        "run_id", "insight_id", "severity", "category", "title", "narrative",
        F.array_join("recommendations", "|").alias("recommendations"),
        F.array_join("affected_rule_ids", "|").alias("affected_rule_ids"), "source_type",
        "source_correlation_key", "source_direction")


def diagnostics_short(spark, sf_dir):
    """A window of two runs, in which pairs worsen together."""
    return diagnostics(spark, sf_dir, 2)


def run_trend_hits(spark, sf_dir, last=fixed.TREND_DEFAULT_RUNS):
    f, t = _trends(spark, sf_dir, last)
    keys = f.withColumn("correlation_key", X.correlation_key())
    rising = t.where(F.col("direction").isin("worsening", "appearing"))
    return keys.join(rising, ["workspace_id", "correlation_key"], "left_semi").select("run_id", "finding_id")


def baseline_versions(spark, sf_dir):
    r, _ = _hist(spark, sf_dir)
    return X.baseline_versions(r).select("workspace_id", "run_id", "baseline_type",
                                         F.col("version_rank").cast("bigint").alias("version_rank"))


def baseline_requests(spark, sf_dir):
    r, _ = _hist(spark, sf_dir)
    dom = F.dayofmonth("created_at")
    requests = r.where(dom % 2 == 0).select(
        "run_id", (dom % 4 != 0).alias("is_baseline"), F.concat(F.lit("day "), dom.cast("string")).alias("label"),
        F.when(dom % 3 == 0, "Workload").when(dom % 5 == 0, "other").otherwise("machine").alias("type"),
        F.when(dom % 7 == 0, "{bad").otherwise('{"a": 1}').alias("context_json"))
    out, rejected = X.set_baselines(r.withColumn("baseline_label", F.lit(None).cast("string")), requests)
    return out.join(rejected, "run_id", "left").select(
        "run_id", "is_baseline", "baseline_label", "baseline_type", "reason")


def baseline_page(spark, sf_dir):
    r, _ = _hist(spark, sf_dir)
    page = L.list_rows(X.baselines(r, "Release"), {}, [F.col("created_at").desc(), F.col("run_id").desc()], 4, 1)
    return page.select("run_id", "baseline_type")


def filtered_runs(spark, sf_dir):
    r, _ = _hist(spark, sf_dir)
    rows = L.list_rows(L.in_workspace(r, "ws1"), {"status": "completed", "workspace_id": None},
                       [F.col("created_at").desc(), F.col("run_id").desc()], -5, -1)
    return rows.select("workspace_id", "run_id", "status")


def order_page(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    return L.list_rows(o, {"o_orderstatus": "F"}, ["o_orderkey"], 9999, 25).select("o_orderkey", "o_custkey")


def workspace_rows(spark, sf_dir):
    return L.in_workspace(views.findings_history(spark, sf_dir), "ws2").groupBy("severity").agg(F.count("*").alias("n"))


def rule_dedup(spark, sf_dir):
    _, f = _hist(spark, sf_dir)
    return A.dedup_findings(f).select("run_id", "rule_id", "severity", "finding_ord", "finding_id")


def policy(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    return A.escalations(r, f).select("workspace_id", "run_id", F.col("rule_key").alias("rule_id"), "new_severity",
                                      "policy_rule_id", "total_hits", "window_runs")


def _history(spark, sf_dir):
    r, f = _hist(spark, sf_dir)
    events = A.finding_events(r, f, A.escalations(r, f))
    return A.alert_history(events, views.alert_commands(spark, sf_dir))


def history(spark, sf_dir):
    return _history(spark, sf_dir).select(
        "workspace_id", "rule_id", "segment", iso("at").alias("event_at"), "action", F.coalesce("run_id", F.lit("")).alias("run_id"),
        "outcome", F.coalesce("event", F.lit("")).alias("event"), F.coalesce("alert_severity", F.lit("")).alias("alert_severity"))


def _streamed_history(spark, sf_dir):
    """The alert history by the keyed state of a stream that is stopped and started again in the middle."""
    r, f = _hist(spark, sf_dir)
    rows = cut_lineage(A.lifecycle_input(A.finding_events(r, f, A.escalations(r, f)), views.alert_commands(spark, sf_dir)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = f"{shared_folder(spark).rstrip('/')}/perfcap-alerts-{uuid.uuid4().hex}"
    for part in (F.dayofmonth("at") <= 15, F.dayofmonth("at") > 15):  # the events are of one month
        rows.where(part).write.mode("append").parquet(f"{folder}/in")
        live.alert_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).writeStream.format("parquet").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    result = cut_lineage(spark.read.parquet(f"{folder}/out"))
    remove(spark, folder)
    return result


def streamed_history(spark, sf_dir):
    return _streamed_history(spark, sf_dir).select(
        "workspace_id", "rule_id", "segment", iso("at").alias("event_at"), "action", F.coalesce("run_id", F.lit("")).alias("run_id"),
        "outcome", F.coalesce("event", F.lit("")).alias("event"), F.coalesce("alert_severity", F.lit("")).alias("alert_severity"))


def streamed_outbox(spark, sf_dir):
    box = live.outbox_stream(_streamed_history(spark, sf_dir), views.sinks(spark, sf_dir))
    return box.select("sink_id", "workspace_id", "rule_id", "segment", iso("at").alias("event_at"), "event",
                      F.get_json_object("payload", "$.alert.severity").alias("severity"),
                      F.get_json_object("payload", "$.timestamp").alias("stamp"),
                      F.coalesce(F.length("signature"), F.lit(0)).cast("bigint").alias("signature_length"))


def alert_rows(spark, sf_dir):
    return A.alerts_of(_history(spark, sf_dir)).select(
        "workspace_id", "rule_id", "segment", "severity", "status", "triggering_run_id", "latest_run_id",
        iso("triggered_at").alias("triggered_at"), iso("last_seen_at").alias("last_seen_at"),
        F.coalesce("policy_applied", F.lit("")).alias("policy_applied"),
        F.coalesce(iso("snoozed_until"), F.lit("")).alias("snoozed_until"))


def outbox(spark, sf_dir):
    box = A.notification_outbox(A.alert_events(_history(spark, sf_dir)), views.sinks(spark, sf_dir))
    return box.select("sink_id", "workspace_id", "rule_id", "segment", iso("at").alias("event_at"), "event",
                      F.get_json_object("payload", "$.alert.severity").alias("severity"),
                      F.get_json_object("payload", "$.timestamp").alias("stamp"),
                      F.coalesce(F.length("signature"), F.lit(0)).cast("bigint").alias("signature_length"))


def _plan(spark, sf_dir, days=365):
    o = views.purge_runs(spark, sf_dir)
    return T.purge_plan(o, o.select("upload_id").distinct(), views.purge_compares(spark, sf_dir), NOW, days)


def purged_runs(spark, sf_dir):
    return _plan(spark, sf_dir)["runs"].select("run_id", "upload_id", "status")


def purged_compares(spark, sf_dir):
    return _plan(spark, sf_dir)["compares"]


def orphan_uploads(spark, sf_dir):
    return _plan(spark, sf_dir)["uploads"]


def purge_audit_row(spark, sf_dir):
    return _plan(spark, sf_dir)["audit"].select(
        "event_type", "entity_id", "jobs_deleted", "compare_results_deleted", "uploads_deleted", iso("cutoff_utc").alias("cutoff_utc"))


def audit_purge(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("created_at"))
    kept, gone = T.purge_audit(o, NOW, 90)
    return kept.select(F.lit("kept").alias("kind"), "event_id").unionByName(gone.select(F.lit("deleted").alias("kind"), "event_id")) \
        .groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def schedule_violations(spark, sf_dir):
    return G.validate_schedules(views.schedules(spark, sf_dir))


def schedules_due(spark, sf_dir):
    s = views.schedules(spark, sf_dir)
    now = F.lit(NOW_SCHEDULE).cast("timestamp")
    after = G.record_run(s, G.due_schedules(s, now), now)
    return after.select("schedule_id", "enabled", F.coalesce(iso("last_run_at"), F.lit("")).alias("last_run_at"),
                        F.coalesce(iso("next_run_at"), F.lit("")).alias("next_run_at"))


QUERIES = {
    "w8_keyed_findings": keyed,
    "l2_recent_runs": recent,
    "w5_run_numbers": run_numbers,
    "c3_j6_l3_compare": compare,
    "a14_compare_summary": compare_summary,
    "u2_new_and_resolved": changed,
    "j12_auto_compare": auto_compare,
    "c4_a15_l4_trends": trends,
    "c4_short_window": short_trends,
    "j8_trend_points": trend_points,
    "u1_union_of_keys": union_keys,
    "c5_j7_a16_l5_correlations": correlations,
    "c5_correlations_short_window": correlations_short,
    "c5_correlations_long_window": correlations_long,
    "c6_l6_u3_diagnostics": diagnostics,
    "c6_diagnostics_short_window": diagnostics_short,
    "j9_run_trend_hits": run_trend_hits,
    "w7_baseline_versions": baseline_versions,
    "c7_baseline_requests": baseline_requests,
    "c7_baseline_page": baseline_page,
    "f9_filtered_runs": filtered_runs,
    "l7_paged_orders": order_page,
    "f10_workspace_rows": workspace_rows,
    "a17_rule_dedup": rule_dedup,
    "c8_a18_w5_policy": policy,
    "c9_c10_w6_alert_history": history,
    "st7_alert_stream": streamed_history,
    "st8_outbox_stream": streamed_outbox,
    "c9_alerts": alert_rows,
    "k6_notification_outbox": outbox,
    "c11_l9_purged_runs": purged_runs,
    "j11_purged_compares": purged_compares,
    "j10_orphan_uploads": orphan_uploads,
    "a19_purge_audit_row": purge_audit_row,
    "c12_audit_purge": audit_purge,
    "f12_schedule_violations": schedule_violations,
    "st5_due_schedules": schedules_due,
}

_DIR = "list_position(['worsening','appearing','stable','intermittent','de-escalating','resolving'], {d})"
_SEV = "(CASE {s} WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'informational' THEN 1 WHEN 'info' THEN 1 ELSE 0 END)"


def _trend_views(last: int) -> dict:
    return {
        "recent": f"""SELECT *, count(*) OVER (PARTITION BY workspace_id) AS total_runs FROM (
            SELECT workspace_id, run_id, completed_at, row_number() OVER (PARTITION BY workspace_id ORDER BY rn DESC) AS run_ord
            FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY coalesce(completed_at, created_at) DESC,
              created_at DESC, run_id DESC) AS rn FROM runs_hist WHERE status = 'completed') WHERE rn <= {last})""",
        "presence": """SELECT DISTINCT ON (f.run_id, lower(rule_id || ':' || metric)) r.workspace_id, r.run_id, r.run_ord, r.total_runs,
            r.completed_at, rule_id || ':' || metric AS correlation_key, severity
          FROM findings_hist f JOIN recent r USING (run_id) ORDER BY f.run_id, lower(rule_id || ':' || metric), finding_ord""",
        "trend_rows": f"""SELECT *, CASE
              WHEN run_count = total_runs THEN CASE WHEN {_SEV.format(s='last_sev')} > {_SEV.format(s='first_sev')} THEN 'worsening'
                WHEN {_SEV.format(s='last_sev')} < {_SEV.format(s='first_sev')} THEN 'de-escalating'
                WHEN kinds = 1 THEN 'stable' ELSE 'intermittent' END
              WHEN first_ord > 1 AND last_ord = total_runs THEN 'appearing'
              WHEN first_ord = 1 AND last_ord < total_runs THEN 'resolving' ELSE 'intermittent' END AS direction
          FROM (SELECT workspace_id, correlation_key, total_runs, count(*) AS run_count, min(run_ord) AS first_ord,
              max(run_ord) AS last_ord, arg_min(severity, run_ord) AS first_sev, arg_max(severity, run_ord) AS last_sev,
              arg_min(completed_at, run_ord) AS first_seen, arg_max(completed_at, run_ord) AS last_seen,
              count(DISTINCT lower(severity)) AS kinds, list(run_ord) AS ords FROM presence GROUP BY ALL)""",
        "trend_pos": f"""SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY {_DIR.format(d='direction')}, correlation_key)
            AS trend_pos FROM trend_rows""",
        "pairs": """SELECT * FROM (SELECT *, co_run_count / total_runs::DOUBLE AS co_score, row_number() OVER (PARTITION BY workspace_id
              ORDER BY (direction_a = 'worsening' AND direction_b = 'worsening') DESC, (direction_a = direction_b) DESC,
              co_run_count DESC, key_a, key_b) AS pair_ord
            FROM (SELECT a.workspace_id, a.correlation_key AS key_a, b.correlation_key AS key_b, a.direction AS direction_a,
              b.direction AS direction_b, len(list_intersect(a.ords, b.ords)) AS co_run_count, a.total_runs
              FROM trend_pos a JOIN trend_pos b ON a.workspace_id = b.workspace_id AND a.trend_pos < b.trend_pos
              WHERE a.run_count >= 2 AND b.run_count >= 2) WHERE co_run_count >= 2) WHERE pair_ord <= 20""",
    }


HIST = {
    "last_ev": """SELECT workspace_id, dataset_id, series_ord, metric, instance, arg_max(e.value, s.ord) AS v,
        date_trunc('day', max(s.ts))::TIMESTAMP AS day FROM samples_ev s JOIN events e ON e.event_id = s.ord
        GROUP BY workspace_id, dataset_id, series_ord, metric, instance""",
    "findings_hist": """SELECT workspace_id, 'run_' || substr(dataset_id, 4) AS run_id, series_ord::BIGINT AS finding_ord,
        'rule-' || split_part(metric, '.', 2) || '-' || (series_ord % 2) AS rule_id, metric || '.' || instance AS metric,
        CASE WHEN v > 85 THEN 'critical' WHEN v > 60 THEN 'warning' ELSE 'informational' END AS severity,
        CASE WHEN series_ord <= 8 THEN 'cpu' WHEN series_ord <= 14 THEN 'memory' ELSE 'disk' END AS category,
        'High ' || split_part(metric, '.', 2) AS title, 'Last ' || split_part(metric, '.', 2) || ' above limit.' AS summary,
        'fd_' || substr(dataset_id, 4) || '_' || series_ord AS finding_id, day FROM last_ev WHERE v > 45""",
    "runs_hist": """SELECT workspace_id, 'run_' || substr(dataset_id, 4) AS run_id, dom,
        CASE WHEN dom % 13 = 0 THEN 'failed' ELSE 'completed' END AS status, day AS created_at,
        CASE WHEN dom % 13 <> 0 THEN day + INTERVAL 1 DAY END AS completed_at, dom % 7 = 1 AS is_baseline,
        CASE WHEN dom % 7 = 1 THEN CASE WHEN dom % 2 = 0 THEN 'machine' ELSE 'release' END END AS baseline_type,
        CASE WHEN dom % 7 <> 1 THEN 'run_' || workspace_id || '_' || strftime(day - to_days(((dom - 1) % 7)::INT), '%Y%m%d') END
          AS selected_baseline_id
      FROM (SELECT DISTINCT workspace_id, dataset_id, date_trunc('day', ts)::TIMESTAMP AS day, day(ts) AS dom FROM samples_ev)""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY coalesce(completed_at, created_at), created_at, run_id)
        AS run_ord FROM runs_hist WHERE status = 'completed'""",
    "adjacent": """SELECT a.run_id AS baseline_run_id, b.run_id AS candidate_run_id FROM numbered a
        JOIN numbered b ON a.workspace_id = b.workspace_id AND b.run_ord = a.run_ord + 1""",
    "keyed_hist": """SELECT DISTINCT ON (run_id, lower(rule_id || ':' || metric)) *, rule_id || ':' || metric AS correlation_key
        FROM findings_hist ORDER BY run_id, lower(rule_id || ':' || metric), finding_ord""",
    "diffs": """SELECT p.baseline_run_id, p.candidate_run_id, coalesce(b.correlation_key, c.correlation_key) AS correlation_key,
        CASE WHEN b.run_id IS NULL THEN 'new' WHEN c.run_id IS NULL THEN 'resolved' WHEN b.severity = c.severity THEN 'unchanged'
          ELSE 'severity_changed' END AS status, b.severity AS baseline_severity, c.severity AS candidate_severity,
        c.finding_id AS candidate_finding_id
      FROM (SELECT p.*, k.key FROM adjacent p JOIN (SELECT DISTINCT run_id, lower(correlation_key) AS key FROM keyed_hist) k
          ON k.run_id IN (p.baseline_run_id, p.candidate_run_id) GROUP BY ALL) p
      LEFT JOIN keyed_hist b ON b.run_id = p.baseline_run_id AND lower(b.correlation_key) = p.key
      LEFT JOIN keyed_hist c ON c.run_id = p.candidate_run_id AND lower(c.correlation_key) = p.key""",
    "policy": """SELECT w.workspace_id, w.run_id, w.rule_id, 1 + count(DISTINCT h.run_id) AS total_hits,
        least(any_value(w.run_ord) - 1, 4) + 1 AS window_runs, any_value(w.run_ord) AS run_ord
      FROM (SELECT DISTINCT workspace_id, run_id, rule_id, run_ord FROM findings_hist JOIN numbered USING (workspace_id, run_id)
          WHERE severity = 'warning') w
      LEFT JOIN (SELECT DISTINCT workspace_id, run_id, rule_id, run_ord FROM findings_hist JOIN numbered USING (workspace_id, run_id)) h
        ON h.workspace_id = w.workspace_id AND h.rule_id = w.rule_id AND h.run_ord BETWEEN w.run_ord - 4 AND w.run_ord - 1
      GROUP BY w.workspace_id, w.run_id, w.rule_id HAVING 1 + count(DISTINCT h.run_id) >= 3 AND any_value(w.run_ord) - 1 >= 2""",
    "dedup_hist": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rule_id
        ORDER BY {rank('severity')} DESC, finding_ord) AS rn FROM findings_hist) WHERE rn = 1""",
    "commands": """SELECT workspace_id, rule_id, day + INTERVAL 12 HOUR AS tm, action,
        CASE WHEN action = 'snooze' THEN CASE WHEN dom % 2 = 0 THEN day + INTERVAL 3 DAY ELSE day + INTERVAL 45 DAY END END AS until
      FROM (SELECT f.workspace_id, f.rule_id, r.created_at AS day, r.dom, CASE WHEN (length(rule_id) + dom) % 5 = 0 THEN 'acknowledge'
          WHEN (length(rule_id) + dom) % 7 = 0 THEN 'resolve' WHEN (length(rule_id) + dom) % 11 = 0 THEN 'snooze'
          WHEN (length(rule_id) + dom) % 9 = 0 THEN 'unsnooze' END AS action
        FROM (SELECT DISTINCT workspace_id, rule_id FROM findings_hist) f JOIN runs_hist r USING (workspace_id))
      WHERE action IS NOT NULL""",
    "steps": """SELECT workspace_id, rule_id, row_number() OVER (PARTITION BY workspace_id, rule_id ORDER BY tm, k, action, run_id) AS n,
        tm, action, run_id, severity, policy, until FROM (
        SELECT d.workspace_id, d.rule_id, r.completed_at AS tm, 0 AS k, 'finding' AS action, d.run_id,
          CASE WHEN p.run_id IS NULL THEN d.severity ELSE 'critical' END AS severity,
          CASE WHEN p.run_id IS NULL THEN '' ELSE 'warning-3of5-critical' END AS policy, NULL::TIMESTAMP AS until
        FROM dedup_hist d JOIN numbered r USING (workspace_id, run_id) LEFT JOIN policy p USING (workspace_id, run_id, rule_id)
        UNION ALL SELECT workspace_id, rule_id, tm, 1, action, '', NULL, '', until FROM commands)""",
    # The state machine one step at a time: state = (segment, status, rank, snoozed until).
    "machine": f"""SELECT workspace_id, rule_id, 0::BIGINT AS n, 0::BIGINT AS segment, 'none' AS status, 0 AS rnk,
        NULL::TIMESTAMP AS snoozed, NULL::TIMESTAMP AS tm, '' AS action, '' AS run_id, '' AS outcome, '' AS event, '' AS policy
      FROM (SELECT DISTINCT workspace_id, rule_id FROM steps)
      UNION ALL
      SELECT workspace_id, rule_id, n, CASE WHEN creates THEN segment + 1 ELSE segment END,
        CASE WHEN creates THEN 'open' WHEN ok AND action = 'acknowledge' THEN 'acknowledged'
          WHEN ok AND action = 'resolve' THEN 'resolved' ELSE status END,
        CASE WHEN creates THEN r WHEN action = 'finding' THEN greatest(r, rnk) ELSE rnk END,
        CASE WHEN creates THEN NULL WHEN ok AND action = 'snooze' THEN until WHEN ok AND action = 'unsnooze' THEN NULL ELSE snoozed END,
        tm, action, run_id,
        CASE WHEN creates THEN 'created' WHEN escalates THEN 'escalated' WHEN action = 'finding' THEN 'updated'
          WHEN ok THEN 'accepted' ELSE 'rejected' END,
        CASE WHEN creates THEN 'alert.created' WHEN escalates AND NOT coalesce(snoozed > tm, FALSE) THEN 'alert.escalated'
          WHEN ok AND action = 'acknowledge' THEN 'alert.acknowledged' WHEN ok AND action = 'resolve' THEN 'alert.resolved' ELSE '' END,
        policy
      FROM (SELECT s.*, m.segment, m.status, m.rnk, m.snoozed, {rank('s.severity')} AS r,
          s.action = 'finding' AND m.status IN ('none', 'resolved') AS creates,
          s.action = 'finding' AND m.status NOT IN ('none', 'resolved') AND {rank('s.severity')} > m.rnk AS escalates,
          m.status NOT IN ('none', 'resolved') AND (s.action IN ('resolve', 'unsnooze') OR (s.action = 'acknowledge' AND m.status = 'open')
            OR (s.action = 'snooze' AND s.until > s.tm - INTERVAL 30 SECOND AND s.until <= s.tm + INTERVAL 30 DAY)) AS ok
        FROM machine m JOIN steps s ON s.workspace_id = m.workspace_id AND s.rule_id = m.rule_id AND s.n = m.n + 1)""",
    "sinks": """SELECT 'sink' || n_nationkey AS sink_id, 'ws' || (n_nationkey % 3) AS workspace_id, n_nationkey % 2 = 0 AS has_secret,
        CASE WHEN n_nationkey % 2 = 0 THEN ['alert.created', 'alert.escalated'] WHEN n_nationkey % 5 = 0 THEN ['alert.resolved']
          ELSE ['alert.acknowledged', 'alert.created'] END AS events FROM nation WHERE n_nationkey % 4 <> 0""",
    "old_runs": """SELECT o_orderkey AS run_id, o_orderkey // 2 AS upload_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END AS status
      FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 10 <> 0 AND o_orderdate < TIMESTAMP '1998-01-01'
      ORDER BY o_orderdate, o_orderkey LIMIT 1000""",
    "order_pairs": """SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS baseline_run_id,
        o_orderkey AS candidate_run_id FROM orders""",
    "gone_compares": """SELECT baseline_run_id || '-' || candidate_run_id AS compare_id, baseline_run_id, candidate_run_id FROM order_pairs
      WHERE baseline_run_id IS NOT NULL AND (baseline_run_id IN (SELECT run_id FROM old_runs)
        OR candidate_run_id IN (SELECT run_id FROM old_runs))""",
    "gone_uploads": """SELECT DISTINCT upload_id FROM old_runs WHERE upload_id NOT IN (
      SELECT o_orderkey // 2 FROM orders WHERE o_orderkey NOT IN (SELECT run_id FROM old_runs))""",
    "sched": """SELECT 'sch' || s_suppkey AS schedule_id, s_suppkey AS k, s_suppkey * 37 % 1600 AS interval_minutes, s_suppkey % 3 <> 0 AS enabled,
        CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2023-11-14 22:13:20' + to_minutes(s_suppkey) END AS next_run_at,
        s_suppkey % 9 = 0 AS no_name, s_suppkey % 10 = 0 AND length(s_name) * 8 > 100 AS long_name FROM supplier""",
}


def hist(body: str, last: int | None = None) -> str:
    text = query(body, extra={**HIST, **(_trend_views(last) if last else {})})
    return text.replace("WITH ", "WITH RECURSIVE ", 1) if "machine AS" in text else text


_INSIGHTS = """
SELECT run_id, substr(sha256(run_id || ':finding:' || rule_id), 1, 16) AS insight_id, severity, category, title, summary AS narrative,
  'Find out what made rule ''' || rule_id || ''' fire, starting from what changed here last.' AS recommendations,
  rule_id AS affected_rule_ids, 'finding' AS source_type, NULL::VARCHAR AS source_correlation_key, NULL::VARCHAR AS source_direction
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY severity <> 'critical', category, finding_ord) AS rn
  FROM findings_hist WHERE severity IN ('critical', 'warning')) WHERE rn <= 5
  QUALIFY row_number() OVER (PARTITION BY run_id, rule_id ORDER BY rn) = 1)
UNION ALL
SELECT run_id, substr(sha256(run_id || ':trend:' || k), 1, 16), last_sev, 'trend',
  upper(direction[1]) || substr(direction, 2) || ' pattern: ' || k,
  'Seen as ' || direction || ' in ' || run_count || ' of ' || total_runs || ' recent runs, since '
    || strftime(first_seen, '%Y-%m-%d') || '.',
  'Look up in the timeline of ' || k || ' where this starts, and what was deployed or configured then.',
  split_part(k, ':', 1), 'trend', k, direction
FROM (SELECT f.run_id, t.correlation_key AS k, t.*, row_number() OVER (PARTITION BY f.run_id ORDER BY trend_pos) AS rn
  FROM (SELECT DISTINCT run_id, workspace_id, rule_id || ':' || metric AS k FROM findings_hist) f
  JOIN trend_pos t ON t.workspace_id = f.workspace_id AND t.correlation_key = f.k WHERE direction IN ('worsening', 'appearing'))
WHERE rn <= 3
UNION ALL
SELECT run_id, substr(sha256(run_id || ':correlation:' || key_a || '+' || key_b), 1, 16), 'warning', 'correlation',
  'Worse together: ' || key_a || ' and ' || key_b,
  'Both are present in ' || co_run_count || ' of ' || total_runs || ' runs and both get worse (score ' || printf('%.2f', co_score)
    || ').',
  'Look for one cause behind ' || key_a || ' and ' || key_b || '.',
  CASE WHEN split_part(key_a, ':', 1) = split_part(key_b, ':', 1) THEN split_part(key_a, ':', 1)
    ELSE split_part(key_a, ':', 1) || '|' || split_part(key_b, ':', 1) END, 'correlation', key_a || '+' || key_b, 'worsening'
FROM (SELECT DISTINCT f.run_id, p.*, dense_rank() OVER (PARTITION BY f.run_id ORDER BY pair_ord) AS rn
  FROM findings_hist f JOIN pairs p ON p.workspace_id = f.workspace_id AND rule_id || ':' || metric IN (key_a, key_b)
  WHERE direction_a = 'worsening' AND direction_b = 'worsening') WHERE rn <= 3"""

SQL = {
    "w8_keyed_findings": hist("""SELECT run_id, key, arg_min(correlation_key, finding_ord) AS correlation_key,
        arg_min(severity, finding_ord) AS severity, min(finding_ord) AS finding_ord
      FROM (SELECT run_id, lower(rule_id || ':' || metric) AS key, rule_id || ':' || metric AS correlation_key, severity, finding_ord
        FROM findings_hist) GROUP BY ALL"""),
    "l2_recent_runs": hist("SELECT workspace_id, run_id, run_ord FROM recent", 12),
    "w5_run_numbers": hist("SELECT workspace_id, run_id, run_ord FROM numbered"),
    "c3_j6_l3_compare": hist("""SELECT *, row_number() OVER (PARTITION BY baseline_run_id, candidate_run_id ORDER BY
        list_position(['new','severity_changed','resolved','unchanged'], status), correlation_key) AS diff_ord FROM diffs"""),
    "a14_compare_summary": hist("""SELECT baseline_run_id, candidate_run_id, count_if(status = 'new') AS new_findings,
        count_if(status = 'resolved') AS resolved_findings, count_if(status = 'unchanged') AS unchanged_findings,
        count_if(status = 'severity_changed') AS severity_changes FROM diffs GROUP BY ALL"""),
    "u2_new_and_resolved": hist("""
      SELECT baseline_run_id, candidate_run_id, 'resolved' AS status, correlation_key FROM (
        SELECT baseline_run_id, candidate_run_id, correlation_key FROM adjacent JOIN keyed_hist ON run_id = baseline_run_id
        EXCEPT SELECT baseline_run_id, candidate_run_id, correlation_key FROM adjacent JOIN keyed_hist ON run_id = candidate_run_id)
      UNION ALL SELECT baseline_run_id, candidate_run_id, 'new', correlation_key FROM (
        SELECT baseline_run_id, candidate_run_id, correlation_key FROM adjacent JOIN keyed_hist ON run_id = candidate_run_id
        EXCEPT SELECT baseline_run_id, candidate_run_id, correlation_key FROM adjacent JOIN keyed_hist ON run_id = baseline_run_id)"""),
    "j12_auto_compare": query("""SELECT baseline_run_id, candidate_run_id, status, count(*) AS n FROM diffs GROUP BY ALL""", extra={
        **HIST, "adjacent": """SELECT c.selected_baseline_id AS baseline_run_id, c.run_id AS candidate_run_id FROM runs_hist c
          JOIN runs_hist b ON b.run_id = c.selected_baseline_id WHERE c.status = 'completed' AND b.status = 'completed'"""}),
    "c4_a15_l4_trends": hist("""SELECT workspace_id, correlation_key, direction, run_count, total_runs, last_sev AS latest_severity,
        strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM trend_rows""", 10),
    "c4_short_window": hist("SELECT workspace_id, direction, count(*) AS n FROM trend_rows GROUP BY ALL", 3),
    "j8_trend_points": hist("""SELECT k.workspace_id, k.correlation_key, string_agg(r.run_id || '=' || coalesce(p.severity, 'none'), ','
        ORDER BY r.run_ord) AS points
      FROM (SELECT DISTINCT workspace_id, correlation_key FROM presence) k JOIN recent r USING (workspace_id)
      LEFT JOIN presence p ON p.run_id = r.run_id AND p.correlation_key = k.correlation_key GROUP BY ALL""", 6),
    "u1_union_of_keys": hist("SELECT DISTINCT workspace_id, lower(correlation_key) AS key FROM presence", 10),
    "c5_j7_a16_l5_correlations": hist("""SELECT workspace_id, key_a, key_b, direction_a, direction_b, co_run_count, total_runs,
        round(co_score, 6) AS co_score, pair_ord FROM pairs""", 10),
    "c5_correlations_short_window": hist("""SELECT workspace_id, key_a, key_b, direction_a, direction_b, co_run_count, pair_ord
      FROM pairs""", 2),
    "c5_correlations_long_window": query("""SELECT workspace_id, key_a, key_b, direction_a, direction_b, co_run_count, total_runs,
        round(co_score, 6) AS co_score, pair_ord FROM pairs""", extra={**_trend_views(100),
        "runs_hist": """SELECT DISTINCT 'ws' || o_custkey % 3 AS workspace_id, 'ws' || o_custkey % 3 || '_' || strftime(o_orderdate, '%Y-%m')
            AS run_id, 'completed' AS status, date_trunc('month', o_orderdate) AS created_at,
            date_trunc('month', o_orderdate) AS completed_at FROM orders""",
        "findings_hist": """SELECT 'ws' || o_custkey % 3 || '_' || strftime(o_orderdate, '%Y-%m') AS run_id, o_orderkey AS finding_ord,
            'orders' AS rule_id, 'c' || o_custkey AS metric, CASE o_orderpriority[1] WHEN '1' THEN 'critical' WHEN '2' THEN 'warning'
            ELSE 'informational' END AS severity FROM orders"""}),
    "c6_l6_u3_diagnostics": hist(_INSIGHTS, 10),
    "c6_diagnostics_short_window": hist(_INSIGHTS, 2),
    "j9_run_trend_hits": hist("""SELECT run_id, finding_id FROM findings_hist f WHERE EXISTS (SELECT 1 FROM trend_rows t
      WHERE t.workspace_id = f.workspace_id AND t.correlation_key = f.rule_id || ':' || f.metric
        AND direction IN ('worsening', 'appearing'))""", 10),
    "w7_baseline_versions": hist("""SELECT workspace_id, run_id, baseline_type, row_number() OVER (PARTITION BY workspace_id, baseline_type
      ORDER BY created_at DESC, run_id DESC) AS version_rank FROM runs_hist WHERE is_baseline"""),
    "c7_baseline_requests": hist("""SELECT run_id, CASE WHEN touched AND reason IS NULL THEN wanted ELSE is_baseline END AS is_baseline,
        CASE WHEN touched AND reason IS NULL AND wanted THEN 'day ' || dom END AS baseline_label,
        CASE WHEN touched AND reason IS NULL THEN CASE WHEN wanted THEN CASE WHEN dom % 3 = 0 THEN 'workload' ELSE 'machine' END END
          ELSE baseline_type END AS baseline_type, reason
      FROM (SELECT *, dom % 2 = 0 AS touched, dom % 4 <> 0 AS wanted, CASE WHEN dom % 2 = 1 THEN NULL
          WHEN dom % 4 <> 0 AND dom % 3 <> 0 AND dom % 5 = 0 THEN 'type must be one of: machine, role, workload, release'
          WHEN dom % 4 <> 0 AND dom % 7 = 0 THEN 'contextJson must be valid JSON'
          WHEN status <> 'completed' THEN 'Only completed jobs can be designated as baselines' END AS reason FROM runs_hist)"""),
    "c7_baseline_page": hist("""SELECT run_id, baseline_type FROM runs_hist WHERE baseline_type = 'release'
      ORDER BY created_at DESC, run_id DESC LIMIT 4 OFFSET 1"""),
    "f9_filtered_runs": hist("""SELECT workspace_id, run_id, status FROM runs_hist WHERE workspace_id = 'ws1' AND status = 'completed'
      ORDER BY created_at DESC, run_id DESC LIMIT 100"""),
    "l7_paged_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500 OFFSET 25",
    "f10_workspace_rows": hist("SELECT severity, count(*) AS n FROM findings_hist WHERE workspace_id = 'ws2' GROUP BY ALL"),
    "a17_rule_dedup": hist("SELECT run_id, rule_id, severity, finding_ord, finding_id FROM dedup_hist"),
    "c8_a18_w5_policy": hist("""SELECT workspace_id, run_id, rule_id, 'critical' AS new_severity,
        'warning-3of5-critical' AS policy_rule_id, total_hits, window_runs FROM policy"""),
    "c9_c10_w6_alert_history": hist(f"""SELECT workspace_id, rule_id, segment, {sql_iso('tm')} AS event_at, action, run_id, outcome, event,
        CASE WHEN segment = 0 OR (outcome = 'rejected' AND status IN ('none', 'resolved') AND segment = 0) THEN ''
          ELSE CASE rnk WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'informational' ELSE '' END END AS alert_severity
      FROM machine WHERE n > 0"""),
    "c9_alerts": hist(f"""SELECT workspace_id, rule_id, segment,
        CASE max(rnk) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'informational' END AS severity,
        arg_max(status, n) AS status, arg_min(run_id, n) FILTER (WHERE action = 'finding') AS triggering_run_id,
        arg_max(run_id, n) FILTER (WHERE action = 'finding') AS latest_run_id,
        {sql_iso("min(tm) FILTER (WHERE action = 'finding')")} AS triggered_at,
        {sql_iso("max(tm) FILTER (WHERE action = 'finding')")} AS last_seen_at,
        arg_max(policy, n) FILTER (WHERE action = 'finding') AS policy_applied,
        coalesce({sql_iso('arg_max(snoozed, n) FILTER (WHERE snoozed IS NOT NULL AND n = top)')}, '') AS snoozed_until
      FROM (SELECT *, max(n) OVER (PARTITION BY workspace_id, rule_id, segment) AS top FROM machine WHERE n > 0 AND segment > 0)
      GROUP BY workspace_id, rule_id, segment"""),
    "k6_notification_outbox": hist(f"""SELECT s.sink_id, m.workspace_id, m.rule_id, m.segment, {sql_iso('m.tm')} AS event_at, m.event,
        CASE rnk WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'informational' END AS severity,
        strftime(m.tm, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN s.has_secret THEN 71 ELSE 0 END AS signature_length
      FROM machine m JOIN sinks s ON s.workspace_id = m.workspace_id AND list_contains(s.events, m.event) WHERE m.event <> ''"""),
    "c11_l9_purged_runs": hist("SELECT run_id, upload_id, status FROM old_runs"),
    "j11_purged_compares": hist("SELECT compare_id, baseline_run_id, candidate_run_id FROM gone_compares"),
    "j10_orphan_uploads": hist("SELECT upload_id FROM gone_uploads"),
    "a19_purge_audit_row": hist("""SELECT 'retention.jobs_purged' AS event_type, 'system' AS entity_id,
        (SELECT count(*) FROM old_runs) AS jobs_deleted, (SELECT count(*) FROM gone_compares) AS compare_results_deleted,
        (SELECT count(*) FROM gone_uploads) AS uploads_deleted, '1998-01-01T00:00:00.000000' AS cutoff_utc"""),
    "c12_audit_purge": """SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 90 DAY THEN 'deleted' ELSE 'kept' END AS kind,
        count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1""",
    "f12_schedule_violations": hist("""SELECT schedule_id, message FROM (SELECT schedule_id, CASE
        WHEN no_name OR long_name THEN 'name must be 1–100 non-whitespace characters'
        WHEN interval_minutes NOT BETWEEN 5 AND 1440 THEN 'intervalMinutes must be between 5 and 1440 (1 day)'
        WHEN k % 4 <> 0 THEN 'packIds must contain at least one non-empty, non-duplicate pack ID'
        WHEN k % 6 = 1 THEN 'unsupported source type ''ftp'' — v1 supports only ''directory'''
        WHEN k % 6 = 2 THEN 'source ''path'' must be absolute and free of ''..'' segments'
        WHEN k % 6 = 3 THEN 'sourceConfigJson must be a JSON object'
        WHEN k % 6 = 4 THEN 'sourceConfigJson is not valid JSON'
        WHEN k % 6 = 5 THEN 'source ''glob'' is required and must be non-empty' END AS message FROM sched) WHERE message IS NOT NULL"""),
    "st5_due_schedules": hist(f"""SELECT schedule_id, enabled, CASE WHEN due THEN '2023-11-14T23:00:00.000000' ELSE '' END AS last_run_at,
        coalesce(CASE WHEN due THEN {sql_iso("TIMESTAMP '2023-11-14 23:00:00' + to_minutes(interval_minutes)")}
          ELSE {sql_iso('next_run_at')} END, '') AS next_run_at
      FROM (SELECT *, enabled AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '2023-11-14 23:00:00') AS due FROM sched)"""),
}
SQL["st7_alert_stream"] = SQL["c9_c10_w6_alert_history"]  # the stream gives what the batch gives
SQL["st8_outbox_stream"] = SQL["k6_notification_outbox"]
