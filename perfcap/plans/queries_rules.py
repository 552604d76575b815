"""Registered queries over statistics, windows, rules, findings and scoring, with their SQL."""

from pyspark.sql import functions as F

from perfcap.functions.compare import aggregation, compare
from perfcap.operators import rolling, rules as R, scoring, stats as S
from perfcap.plans import event_rules, views
from perfcap.plans.sqltext import STAT_AGGS, base32, cmp, query, rank
from perfcap.session import cut_lineage
from perfcap.sources import packs as P

STAT_ROUND = ", ".join(f"round({c}, 5) AS {c}" for c in (
    "min", "max", "avg", "median", "p90", "p95", "p99", "stddev", "trend_per_hour"))


class Events:
    """The event view with everything the rule operators need."""

    def __init__(self, spark, sf_dir, packs=None):
        self.samples = views.samples_ev(spark, sf_dir)
        self.series = views.series_of(self.samples)
        self.hosts = views.hosts_ev(self.samples)
        self.stats = S.series_stats(self.samples)
        self.datasets = self.samples.groupBy("dataset_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
        self.present = S.present_metrics(self.series)
        self.book = P.RuleBook.of(spark, packs or event_rules.ALL_PACKS)
        self.rules, self.conditions = self.book.rules, self.book.conditions

    def evaluate(self, selected=None):
        """Statistics and findings are shared by several outputs and written once."""
        findings, warnings = R.evaluate_rules(
            self.samples, self.series, cut_lineage(self.stats), self.datasets, self.hosts, self.book, selected,
            materialize=cut_lineage)
        return cut_lineage(findings), warnings


def iso(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def sql_iso(column):
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _stats(df):
    names = ["min", "max", "avg", "median", "p90", "p95", "p99", "stddev", "trend_per_hour"]
    return rounded(df, 5, *[n for n in names if n in df.columns])


def series_stats_events(spark, sf_dir):
    e = views.samples_ev(spark, sf_dir)
    return _stats(S.series_stats(e)).drop("valid_count", "first_valid_ts", "last_valid_ts")


def series_stats_lines(spark, sf_dir):
    return _stats(S.series_stats(views.samples_li(spark, sf_dir))).drop("valid_count", "first_valid_ts", "last_valid_ts")


def hot_series_stats(spark, sf_dir):
    """Long series of few different values."""
    li = views.samples_li(spark, sf_dir)
    return _stats(S.series_stats(li)).select("dataset_id", "series_id", "median", "p90", "p95", "p99")


def counts(spark, sf_dir):
    return S.series_moments(views.samples_ev(spark, sf_dir)).select("dataset_id", "series_id", "count", "missing_sample_count")


def moments(spark, sf_dir):
    return _stats(S.series_moments(views.samples_ev(spark, sf_dir))).select(
        "dataset_id", "series_id", "min", "max", "avg", "stddev", "trend_per_hour")


def percentiles(spark, sf_dir):
    return _stats(S.series_stats(views.samples_ev(spark, sf_dir))).select(
        "dataset_id", "series_id", "median", "p90", "p95", "p99")


def named_aggregation(spark, sf_dir):
    st = S.series_stats(views.samples_li(spark, sf_dir))
    names = F.explode(F.array(*[F.lit(a) for a in ["avg", "min", "max", "p90", "p95", "p99", "trend"]]))
    return st.withColumn("aggregation", names).select(
        "dataset_id", "series_id", "aggregation", F.round(aggregation(F.col("aggregation")), 5).alias("value"))


def dataset_summary(spark, sf_dir):
    e = views.samples_ev(spark, sf_dir)
    d = S.dataset_summary(e, views.series_of(e))
    return d.select("dataset_id", iso("start_time").alias("start_time"), iso("end_time").alias("end_time"),
                    "series_count", "sample_count", F.round("sample_interval_seconds", 4).alias("sample_interval_seconds"),
                    "gap_count")


def nominal_interval(spark, sf_dir):
    q = S.row_quality(views.samples_ev(spark, sf_dir))
    return q.select("dataset_id", F.round("sample_interval_seconds", 4).alias("sample_interval_seconds"))


def gaps(spark, sf_dir):
    li = views.samples_li(spark, sf_dir).where(F.col("metric") == "lineitem.tax")
    return S.row_quality(li, "month").select("dataset_id", "gap_count", F.round("sample_interval_seconds", 4).alias(
        "sample_interval_seconds"))


def inspection(spark, sf_dir):
    e = views.samples_ev(spark, sf_dir)
    series = views.series_of(e)
    i = S.inspect(S.dataset_summary(e, series), series)
    return i.select("dataset_id", "series_count", "sample_count", "gap_count",
                    F.array_join("top_metrics", ",").alias("top_metrics"))


def present_metrics(spark, sf_dir):
    return S.present_metrics(views.series_of(views.samples_ev(spark, sf_dir)))


def find_series(spark, sf_dir):
    s = views.series_of(views.samples_ev(spark, sf_dir))
    tagged = lambda tag, df: df.select(F.lit(tag).alias("kind"), "dataset_id", "series_id")
    return (
        tagged("all", S.find_series(s, "EVENTS.Click"))
        .unionByName(tagged("first", S.find_series(s, "events.view", first=True)))
        .unionByName(tagged("instance", S.find_series(s, "events.error", "I2"))))


def comparator(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    ops = F.explode(F.array(*[F.lit(o) for o in ["gt", "ge", "lt", "le", "eq"]]))
    value = F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).when(
        F.col("l_orderkey") % 13 != 0, F.col("l_quantity"))
    return li.select(value.alias("v"), ops.alias("op")).groupBy("op").agg(
        F.count_if(compare(F.col("v"), F.col("op"), F.lit(25.0))).alias("satisfied"), F.count("*").alias("rows"))


def duration_events(spark, sf_dir):
    e = Events(spark, sf_dir)
    return rounded(R.duration_hits(e.samples, e.conditions, e.hosts), 6, "percent", "threshold")


def duration_lines(spark, sf_dir):
    e = Events(spark, sf_dir)
    hits = R.duration_hits(views.samples_li(spark, sf_dir), e.conditions)
    return rounded(hits, 6, "percent")


def trend_predicate(spark, sf_dir):
    e = Events(spark, sf_dir)
    return rounded(R.trend_hits(e.stats, e.series, e.conditions, e.hosts), 5, "actual_value")


def rolling_events(spark, sf_dir):
    e = Events(spark, sf_dir)
    w = rolling.rolling_windows(e.samples, R.window_specs(e.conditions), materialize=cut_lineage)
    return w.select("dataset_id", "series_id", "spec_id", F.col("k").cast("bigint").alias("k"),
                    iso("window_start").alias("window_start"), iso("window_end").alias("window_end"), "n",
                    F.round("value", 5).alias("value"))


LONG_WINDOWS = "spec_id string, metric string, instance string, duration_s long, step_s long, min_samples int, aggregation string"
_DAY = [(f"{a}-day", "events.view", None, 86400, 1200, 3, a) for a in ("avg", "min", "max", "p90", "p95", "p99")]
_UNEVEN = [(f"{a}-uneven", "events.click", "*", 50000, 777, 2, a) for a in ("avg", "p95")]


def long_windows(spark, sf_dir):
    """Windows of 72 steps, and of 64 steps and a part of one."""
    specs = spark.createDataFrame(_DAY + _UNEVEN, LONG_WINDOWS)
    w = rolling.rolling_windows(views.samples_ev(spark, sf_dir), specs, materialize=cut_lineage)
    return w.groupBy("dataset_id", "series_id", "spec_id").agg(
        F.count("*").alias("windows"), F.sum("n").alias("covered"), F.round(F.sum("value"), 6).alias("total"),
        F.round(F.min("value"), 5).alias("lowest"), F.round(F.max("value"), 5).alias("highest"),
        F.max(F.col("k")).cast("bigint").alias("last_k"))


def default_step(spark, sf_dir):
    b = rolling.default_step_seconds(rolling.series_bounds(views.samples_ev(spark, sf_dir)))
    return b.select("dataset_id", "series_id", F.round("default_step_s", 4).alias("default_step_s"))


def window_predicate(spark, sf_dir):
    e = Events(spark, sf_dir)
    w = rolling.rolling_windows(e.samples, R.window_specs(e.conditions), materialize=cut_lineage)
    return rounded(R.window_hits(w, e.conditions, e.hosts), 5, "actual_value")


def guarded_rules(spark, sf_dir):
    e = Events(spark, sf_dir)
    return R.applicable_rules(e.rules, e.present)


def host_missing(spark, sf_dir):
    e = Events(spark, sf_dir)
    _, warnings = R.split_host_missing(e.conditions, e.hosts)
    return warnings.select("dataset_id", "code", "message", "severity")


def thresholds(spark, sf_dir):
    e = Events(spark, sf_dir)
    return R.resolve_thresholds(e.conditions, e.hosts).select(
        "dataset_id", "rule_id", F.round("threshold", 6).alias("threshold"))


def candidates(spark, sf_dir):
    e = Events(spark, sf_dir)
    return R.candidate_series(e.conditions, e.series).select(
        "dataset_id", "series_id", "pack_id", "rule_id", F.col("cond_ord").cast("int").alias("cond_ord"))


def findings(spark, sf_dir):
    f, _ = Events(spark, sf_dir).evaluate()
    return f.select("dataset_id", "finding_id", "pack_id", "rule_id", "primary_metric", "severity", "category", "title",
                    F.size("evidence").cast("bigint").alias("evidence_count"),
                    F.col("finding_ord").cast("bigint").alias("finding_ord"))


def evidence(spark, sf_dir):
    f, _ = Events(spark, sf_dir).evaluate()
    item = lambda e: F.concat_ws(
        " ", e["series_id"], e["trigger_details"][0]["expression"],
        F.round(e["trigger_details"][0]["actual_value"], 4).cast("string"))
    return f.select("dataset_id", "pack_id", "rule_id",
                    F.array_join(F.transform("evidence", item), "; ").alias("evidence_text"))


def trigger_text(spark, sf_dir):
    f, _ = Events(spark, sf_dir).evaluate()
    x = f.select(F.explode("evidence").alias("e")).select(F.explode("e.trigger_details").alias("t"))
    return x.groupBy(F.col("t.expression").alias("expression")).agg(F.count("*").alias("n"))


def finding_recommendations(spark, sf_dir):
    f, _ = Events(spark, sf_dir).evaluate()
    return f.select("dataset_id", "rule_id", F.posexplode("recommendations").alias("pos", "r")).select(
        "dataset_id", "rule_id", F.col("pos").cast("bigint").alias("pos"), F.col("r.rec_id").alias("rec_id"),
        F.col("r.priority").alias("priority"), F.col("r.text").alias("text"))


def finding_rollup(spark, sf_dir):
    f, _ = Events(spark, sf_dir).evaluate()
    return f.groupBy("pack_id", "rule_id").agg(F.count("*").alias("findings"))


def _scored(spark, sf_dir):
    e = Events(spark, sf_dir)
    f, w = e.evaluate()
    return scoring.score(f, w, e.datasets), f, w, e


def overall_status(spark, sf_dir):
    s, *_ = _scored(spark, sf_dir)
    return s.select("dataset_id", "overall_status", "critical", "warning", "informational", "analysis_status")


def category_status(spark, sf_dir):
    _, f, _, _ = _scored(spark, sf_dir)
    return scoring.category_statuses(f)


def warning_gate(spark, sf_dir):
    _, f, _, e = _scored(spark, sf_dir)
    return scoring.gate_on_warning(f, e.datasets)


def line_findings(spark, sf_dir):
    """The flagship over line items: which (flag, status) datasets fire which rule."""
    li = views.samples_li(spark, sf_dir)
    c = P.condition_table(P.packs_from(spark, [event_rules.LINE_PACK]))
    hits = R.duration_hits(li, c).where("fired")
    return hits.groupBy("dataset_id", "rule_id").agg(F.count("*").alias("series"), F.round(F.max("percent"), 6).alias("worst"))


_STATUS = "CASE max({r}) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'healthy' END"
_GAPS = """WITH samples_rows AS ({rows}), o AS (SELECT dataset_id, ts, lag(ts) OVER w AS p, row_number() OVER w AS rn
    FROM samples_rows WINDOW w AS (PARTITION BY dataset_id ORDER BY ts)),
  d AS (SELECT dataset_id, rn, (epoch_us(ts) - epoch_us(p)) / 1e6 AS diff FROM o WHERE p IS NOT NULL),
  nominal AS (SELECT dataset_id, arg_min(diff, rn) AS d0 FROM d GROUP BY ALL)
SELECT {columns} FROM (SELECT DISTINCT dataset_id FROM samples_rows) LEFT JOIN nominal USING (dataset_id)
  LEFT JOIN d USING (dataset_id) GROUP BY dataset_id"""
_STEP = "round(CASE WHEN n < 2 THEN 60.0 ELSE greatest(1.0, (t1 - t0) / 1e7 / (n - 1)) END, 4)"

QUERIES = {
    "a1_counts": counts,
    "a2_a4_a5_moments": moments,
    "a3_percentiles": percentiles,
    "a3_percentiles_hot_groups": hot_series_stats,
    "a1_a5_series_stats_events": series_stats_events,
    "a1_a5_series_stats_lineitem": series_stats_lines,
    "a6_named_aggregation": named_aggregation,
    "a7_dataset_summary": dataset_summary,
    "w3_nominal_interval": nominal_interval,
    "w4_gap_count": gaps,
    "k7_inspection": inspection,
    "u5_present_metrics": present_metrics,
    "f1_find_series": find_series,
    "f2_comparator": comparator,
    "f3_duration_percent_events": duration_events,
    "f3_duration_percent_lineitem": duration_lines,
    "f4_trend_predicate": trend_predicate,
    "w1_rolling_windows": rolling_events,
    "w1_long_windows": long_windows,
    "w2_default_step": default_step,
    "f5_window_predicate": window_predicate,
    "f7_rule_guards": guarded_rules,
    "f8_missing_host_variable": host_missing,
    "j5_host_thresholds": thresholds,
    "j1_candidate_series": candidates,
    "c1_l1_c13_findings": findings,
    "a9_evidence": evidence,
    "c14_trigger_text": trigger_text,
    "j4_recommendations": finding_recommendations,
    "a8_finding_rollup": finding_rollup,
    "a10_a11_a13_status": overall_status,
    "a12_category_status": category_status,
    "f13_warning_gate": warning_gate,
    "f3_a8_line_findings": line_findings,
}

SQL = {
    "a1_counts": query("SELECT dataset_id, series_id, count, missing_sample_count FROM stats_ev"),
    "a2_a4_a5_moments": query(
        "SELECT dataset_id, series_id, round(min, 5) AS min, round(max, 5) AS max, round(avg, 5) AS avg, "
        "round(stddev, 5) AS stddev, round(trend_per_hour, 5) AS trend_per_hour FROM stats_ev"),
    "a3_percentiles": query(
        "SELECT dataset_id, series_id, round(median, 5) AS median, round(p90, 5) AS p90, round(p95, 5) AS p95, "
        "round(p99, 5) AS p99 FROM stats_ev"),
    "a3_percentiles_hot_groups": query(
        f"SELECT dataset_id, series_id, round(median, 5) AS median, round(p90, 5) AS p90, round(p95, 5) AS p95, "
        f"round(p99, 5) AS p99 FROM (SELECT dataset_id, series_id, {STAT_AGGS} FROM samples_li GROUP BY ALL)"),
    "a1_a5_series_stats_events": query(
        f"SELECT dataset_id, series_id, count, {STAT_ROUND}, missing_sample_count FROM stats_ev"),
    "a1_a5_series_stats_lineitem": query(
        f"SELECT dataset_id, series_id, count, {STAT_ROUND}, missing_sample_count FROM "
        f"(SELECT dataset_id, series_id, {STAT_AGGS} FROM samples_li GROUP BY ALL)"),
    "a6_named_aggregation": query(
        f"""SELECT dataset_id, series_id, unnest(['avg','min','max','p90','p95','p99','trend']) AS aggregation,
          round(unnest([avg, min, max, p90, p95, p99, trend_per_hour]), 5) AS value
          FROM (SELECT dataset_id, series_id, {STAT_AGGS} FROM samples_li GROUP BY ALL)"""),
    "a7_dataset_summary": query(f"""SELECT s.dataset_id, {sql_iso('min(ts)')} AS start_time, {sql_iso('max(ts)')} AS end_time,
        count(DISTINCT series_id) AS series_count, count(*) AS sample_count,
        any_value(g.sample_interval_seconds) AS sample_interval_seconds, any_value(g.gap_count) AS gap_count
      FROM samples_ev s JOIN gaps_distinct g USING (dataset_id) GROUP BY s.dataset_id""", extra={
        "gaps_distinct": _GAPS.format(rows="SELECT DISTINCT dataset_id, ts FROM samples_ev", columns="""dataset_id,
          round(coalesce(max(d0), 0), 4) AS sample_interval_seconds,
          count_if(abs(diff - d0) > 0.5 * d0) AS gap_count""")}),
    "w3_nominal_interval": query("SELECT * FROM gaps_rows", extra={"gaps_rows": _GAPS.format(
        rows="SELECT dataset_id, ts FROM samples_ev",
        columns="dataset_id, round(coalesce(max(d0), 0), 4) AS sample_interval_seconds")}),
    "w4_gap_count": query("SELECT * FROM gaps_rows", extra={"gaps_rows": _GAPS.format(
        rows="SELECT dataset_id, ts FROM samples_li WHERE metric = 'lineitem.tax'",
        columns="""dataset_id, round(coalesce(max(d0), 0), 4) AS sample_interval_seconds,
          count_if(abs(diff - d0) > 0.5 * d0) AS gap_count""")}),
    "k7_inspection": query("""SELECT dataset_id, n AS series_count, sample_count, gap_count, top_metrics FROM
      (SELECT dataset_id, count(*) AS n, string_agg(metric, ',' ORDER BY series_ord) FILTER (WHERE series_ord <= 10) AS top_metrics
        FROM series_ev GROUP BY ALL)
      JOIN (SELECT dataset_id, count(*) AS sample_count FROM samples_ev GROUP BY ALL) USING (dataset_id)
      JOIN gaps_distinct USING (dataset_id)""", extra={
        "gaps_distinct": _GAPS.format(rows="SELECT DISTINCT dataset_id, ts FROM samples_ev", columns="""dataset_id,
          count_if(abs(diff - d0) > 0.5 * d0) AS gap_count""")}),
    "u5_present_metrics": query("SELECT dataset_id, metric FROM present_ev"),
    "f1_find_series": query("""SELECT 'all' AS kind, dataset_id, series_id FROM series_ev WHERE metric = 'events.click'
      UNION ALL SELECT 'first', dataset_id, arg_min(series_id, series_ord) FROM series_ev WHERE metric = 'events.view' GROUP BY 2
      UNION ALL SELECT 'instance', dataset_id, series_id FROM series_ev WHERE metric = 'events.error' AND instance = 'i2'"""),
    "f2_comparator": f"""SELECT op, count_if(l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 AND {cmp('l_quantity', 'op', '25')})
        AS satisfied, count(*) AS rows
      FROM lineitem, (SELECT unnest(['gt','ge','lt','le','eq']) AS op) GROUP BY op""",
    "f3_duration_percent_events": query(
        "SELECT * REPLACE (round(percent, 6) AS percent, round(threshold, 6) AS threshold) FROM duration_ev"),
    "f3_duration_percent_lineitem": query(f"""SELECT s.dataset_id, s.series_id, c.pack_id, c.rule_id, c.cond_ord, c.threshold,
        round(count_if({cmp('s.value', 'c.operator', 'c.threshold')}) * 100.0 / count(*), 6) AS percent,
        count_if({cmp('s.value', 'c.operator', 'c.threshold')}) * 100.0 / count(*) >= max(c.duration_percent) AS fired
      FROM samples_li s JOIN conditions c ON lower(s.metric) = lower(c.metric) AND (c.instance IS NULL OR c.instance = '*'
        OR lower(s.instance) = lower(c.instance))
      WHERE s.value IS NOT NULL AND c.window_s IS NULL AND c.aggregation <> 'trend' AND c.hc_variable IS NULL GROUP BY ALL"""),
    "f4_trend_predicate": query("SELECT * REPLACE (round(actual_value, 5) AS actual_value) FROM trend_ev"),
    "w1_rolling_windows": query(f"""SELECT dataset_id, series_id, spec_id, k,
        {sql_iso('make_timestamp(w0 // 10)')} AS window_start,
        {sql_iso('make_timestamp(w0 // 10 + window_s * 1000000)')} AS window_end, n, round(value, 5) AS value FROM windows_ev"""),
    "w1_long_windows": query("""SELECT dataset_id, series_id, spec_id, count(*) AS windows, sum(n)::BIGINT AS covered,
        round(sum(value), 6) AS total, round(min(value), 5) AS lowest, round(max(value), 5) AS highest, max(k) AS last_k
      FROM (SELECT dataset_id, series_id, spec_id, k, count(*) AS n,
          CASE any_value(aggregation) WHEN 'avg' THEN avg(value) WHEN 'min' THEN min(value) WHEN 'max' THEN max(value)
            WHEN 'p90' THEN quantile_cont(value, 0.9) WHEN 'p95' THEN quantile_cont(value, 0.95)
            WHEN 'p99' THEN quantile_cont(value, 0.99) END AS value
        FROM (SELECT b.dataset_id, b.series_id, p.*, unnest(range(0, (b.t1 - b.t0) // (p.step_s * 10000000) + 1)) AS k, t0
            FROM win_bounds b JOIN long_specs p ON lower(b.metric) = p.metric) w
          JOIN samples_ev s USING (dataset_id, series_id)
        WHERE s.value IS NOT NULL AND epoch_us(s.ts) * 10 >= t0 + k * step_s * 10000000
          AND epoch_us(s.ts) * 10 < t0 + (k * step_s + duration_s) * 10000000
        GROUP BY dataset_id, series_id, spec_id, k, min_samples HAVING count(*) >= min_samples)
      GROUP BY ALL""", extra={"long_specs": "SELECT spec_id, metric, duration_s::BIGINT AS duration_s, step_s::BIGINT AS step_s, min_samples, aggregation FROM (VALUES " + ", ".join(
        f"('{i}', '{m}', {d}, {s}, {n}, '{a}')" for i, m, _, d, s, n, a in _DAY + _UNEVEN)
        + ") t(spec_id, metric, duration_s, step_s, min_samples, aggregation)"}),
    "w2_default_step": query(f"SELECT dataset_id, series_id, {_STEP} AS default_step_s FROM win_bounds"),
    "f5_window_predicate": query("SELECT * REPLACE (round(actual_value, 5) AS actual_value) FROM window_hits_ev"),
    "f7_rule_guards": query("""SELECT g.* FROM guards_ok g JOIN rules r USING (pack_id, rule_id)
      WHERE len(requires_any) + len(requires_all) > 0"""),
    "f8_missing_host_variable": query("""SELECT dataset_id, 'rule.host_context_unavailable' AS code,
        'Rule ''' || rule_id || ''' in pack ''' || pack_id || ''' skipped: host_context.' || hc_variable || ' not provided.'
          AS message, 'informational' AS severity
      FROM thresholds WHERE hc_variable IS NOT NULL AND resolved IS NULL"""),
    "j5_host_thresholds": query("""SELECT dataset_id, rule_id, round(resolved, 6) AS threshold FROM thresholds
      WHERE hc_variable IS NOT NULL AND resolved IS NOT NULL"""),
    "j1_candidate_series": query(
        "SELECT s.dataset_id, s.series_id, c.pack_id, c.rule_id, c.cond_ord FROM series_ev s JOIN conditions c ON "
        "lower(s.metric) = lower(c.metric) AND (c.instance IS NULL OR c.instance = '*' OR lower(s.instance) = lower(c.instance))"),
    "c1_l1_c13_findings": query(f"""SELECT dataset_id, finding_id, pack_id, rule_id, primary_metric, severity, category, title,
        evidence_count, row_number() OVER (PARTITION BY dataset_id
          ORDER BY {rank('severity')} DESC, category, rule_id, finding_id) AS finding_ord
      FROM (SELECT *, 'fd_' || {base32('digest')} AS finding_id FROM findings_ev)"""),
    "a9_evidence": query("SELECT dataset_id, pack_id, rule_id, evidence_text FROM findings_ev"),
    "c14_trigger_text": query("""SELECT expression, count(*) AS n FROM evidence_ev e
      SEMI JOIN findings_ev f USING (dataset_id, pack_id, rule_id) GROUP BY ALL"""),
    "j4_recommendations": query("""SELECT dataset_id, rule_id, row_number() OVER (PARTITION BY dataset_id, rule_id ORDER BY i) - 1
        AS pos, rec_id, priority, text
      FROM (SELECT dataset_id, pack_id, rule_id, unnest(recommendation_ids) AS rec_id,
        unnest(range(1, len(recommendation_ids) + 1)) AS i FROM findings_ev) JOIN recommendations USING (pack_id, rec_id)"""),
    "a8_finding_rollup": query("SELECT pack_id, rule_id, count(*) AS findings FROM findings_ev GROUP BY ALL"),
    "a10_a11_a13_status": query(f"""SELECT d.dataset_id, {_STATUS.format(r=rank('f.severity'))} AS overall_status,
        count_if(f.severity = 'critical') AS critical, count_if(f.severity = 'warning') AS warning,
        count_if(f.severity NOT IN ('critical', 'warning')) AS informational,
        CASE WHEN d.dataset_id IN (SELECT dataset_id FROM skipped_ev) THEN 'completed_with_warnings' ELSE 'completed' END
          AS analysis_status
      FROM datasets_ev d LEFT JOIN findings_ev f USING (dataset_id) GROUP BY d.dataset_id"""),
    "a12_category_status": query(
        f"SELECT dataset_id, category, {_STATUS.format(r=rank('severity'))} AS status FROM findings_ev GROUP BY ALL"),
    "f13_warning_gate": query("""SELECT dataset_id, coalesce(bool_or(severity IN ('warning', 'critical')), FALSE) AS failed
      FROM datasets_ev LEFT JOIN findings_ev USING (dataset_id) GROUP BY dataset_id"""),
    "f3_a8_line_findings": query(f"""SELECT dataset_id, rule_id, count(*) AS series, round(max(percent), 6) AS worst FROM (
      SELECT s.dataset_id, s.series_id, c.rule_id, count_if({cmp('s.value', 'c.operator', 'c.threshold')}) * 100.0 / count(*) AS percent,
        max(c.duration_percent) AS need
      FROM samples_li s JOIN conditions c ON c.pack_id = 'line-items' AND lower(s.metric) = lower(c.metric)
        AND (c.instance IS NULL OR c.instance = '*' OR lower(s.instance) = lower(c.instance))
      GROUP BY ALL) WHERE percent >= need GROUP BY ALL"""),
}
