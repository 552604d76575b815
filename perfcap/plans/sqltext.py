"""Named SQL views shared by the oracle queries (DuckDB dialect), and VALUES lists of the rule packs."""

from perfcap.plans import event_rules
from perfcap.sources.packs import pack_record


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(lit(v) for v in value) + "]::VARCHAR[]"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list, columns: list, types: list) -> str:
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns, types))
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT {casts} FROM (VALUES {body}) AS v({', '.join(columns)})"


def _pack_rows(packs: list):
    records = [pack_record(p, f"inline/{p['pack_id']}") for p in packs]
    pack, rule, cond, rec = [], [], [], []
    for p in records:
        pack.append((p["pack_id"], p["pack_name"], p["version"], p["schema_version"], p["has_applicability"],
                     p["always"], p["requires_any"], p["requires_all"], p["path"]))
        for i, r in enumerate(p["rules"]):
            rule.append((p["pack_id"], i, r["rule_id"], r["severity"], r["category"], r["title"], r["summary"],
                         r["requires_any"], r["requires_all"], r["recommendation_ids"], len(r["conditions"])))
            for j, c in enumerate(r["conditions"]):
                cond.append((p["pack_id"], i, r["rule_id"], j, c["metric"], c["instance"], c["aggregation"],
                             c["operator"], c["threshold"], c["hc_variable"], c["hc_factor"], c["hc_min"],
                             c["hc_max"], c["duration_percent"], c["window_s"], c["step_s"], c["min_samples"]))
        for r in p["recommendations"]:
            rec.append((p["pack_id"], r["rec_id"], r["priority"], r["text"]))
    return pack, rule, cond, rec


def pack_views(packs: list, suffix: str = "") -> dict:
    pack, rule, cond, rec = _pack_rows(packs)
    return {
        f"packs{suffix}": values(
            pack, ["pack_id", "pack_name", "version", "schema_version", "has_applicability", "always", "requires_any",
                   "requires_all", "path"],
            ["VARCHAR"] * 4 + ["BOOLEAN"] * 2 + ["VARCHAR[]"] * 2 + ["VARCHAR"]),
        f"rules{suffix}": values(
            rule, ["pack_id", "rule_ord", "rule_id", "severity", "category", "title", "summary", "requires_any",
                   "requires_all", "recommendation_ids", "n_conditions"],
            ["VARCHAR", "INT"] + ["VARCHAR"] * 5 + ["VARCHAR[]"] * 3 + ["INT"]),
        f"conditions{suffix}": values(
            cond, ["pack_id", "rule_ord", "rule_id", "cond_ord", "metric", "instance", "aggregation", "operator",
                   "threshold", "hc_variable", "hc_factor", "hc_min", "hc_max", "duration_percent", "window_s",
                   "step_s", "min_samples"],
            ["VARCHAR", "INT", "VARCHAR", "INT"] + ["VARCHAR"] * 4 + ["DOUBLE", "VARCHAR"] + ["DOUBLE"] * 4
            + ["BIGINT"] * 3),
        f"recommendations{suffix}": values(
            rec or [(None, None, None, None)], ["pack_id", "rec_id", "priority", "text"], ["VARCHAR"] * 4),
    }


B32 = "abcdefghijklmnopqrstuvwxyz234567"


def base32(hex_expr: str) -> str:
    """Five hex digits at a time: one lookup per five bits."""
    parts = []
    for g in range(4):
        n = f"CAST('0x' || substr({hex_expr}, {g * 5 + 1}, 5) AS BIGINT)"
        parts += [f"substr('{B32}', ((({n}) >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


def cmp(value: str, op: str, threshold: str) -> str:
    return (f"coalesce(CASE {op} WHEN 'gt' THEN {value} > {threshold} WHEN 'ge' THEN {value} >= {threshold} "
            f"WHEN 'lt' THEN {value} < {threshold} WHEN 'le' THEN {value} <= {threshold} "
            f"WHEN 'eq' THEN {value} = {threshold} END, FALSE)")


def rank(severity: str) -> str:
    return f"(CASE {severity} WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'informational' THEN 1 ELSE 0 END)"


MATCH = ("lower(s.metric) = lower(c.metric) AND (c.instance IS NULL OR c.instance = '*' "
         "OR lower(s.instance) = lower(c.instance))")

STAT_AGGS = """count(*) AS count, coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max,
  coalesce(avg(value), 0) AS avg, coalesce(quantile_cont(value, 0.5), 0) AS median,
  coalesce(quantile_cont(value, 0.9), 0) AS p90, coalesce(quantile_cont(value, 0.95), 0) AS p95,
  coalesce(quantile_cont(value, 0.99), 0) AS p99, coalesce(stddev_pop(value), 0) AS stddev,
  CASE WHEN count(DISTINCT CASE WHEN value IS NOT NULL THEN ts END) < 2 THEN 0
    ELSE coalesce(regr_slope(value, (epoch_us(ts) - 1700000000000000) / 3.6e9), 0) END AS trend_per_hour,
  count(*) - count(value) AS missing_sample_count, count(value) AS valid_count,
  min(ts) FILTER (WHERE value IS NOT NULL) AS first_valid_ts, max(ts) FILTER (WHERE value IS NOT NULL) AS last_valid_ts"""

VIEWS = {
    "samples_ev": """SELECT 'ws' || (user_id % 3) AS workspace_id,
      'ds_ws' || (user_id % 3) || '_' || strftime(ts, '%Y%m%d') AS dataset_id,
      'ser_' || lpad(((list_position(['click','error','purchase','signup','view'], event_type) - 1) * 4
        + user_id % 4 + 1)::VARCHAR, 3, '0') AS series_id,
      ((list_position(['click','error','purchase','signup','view'], event_type) - 1) * 4 + user_id % 4 + 1)::INT
        AS series_ord,
      'events.' || event_type AS metric, 'i' || (user_id % 4) AS instance, ts,
      CASE WHEN event_id % 17 <> 0 THEN value END AS value, event_id AS ord FROM events""",
    "series_ev": "SELECT DISTINCT dataset_id, series_id, series_ord, metric, instance FROM samples_ev",
    "hosts_ev": """SELECT DISTINCT dataset_id,
      CASE WHEN right(dataset_id, 2)::INT % 5 <> 0 THEN 1000.0 * (1 + right(dataset_id, 2)::INT % 4) END::DOUBLE
        AS total_physical_memory_mb,
      CASE WHEN workspace_id <> 'ws1' THEN 4 + right(dataset_id, 2)::INT % 4 END AS logical_processor_count
      FROM samples_ev""",
    "samples_li": """SELECT dataset_id, measure || '/' || instance AS series_id,
      'lineitem.' || substr(measure, 3) AS metric, instance, ts, value FROM (
      SELECT l_returnflag || l_linestatus AS dataset_id, 'line' || l_linenumber AS instance, l_shipdate AS ts,
        unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) AS measure,
        unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)""",
    "stats_ev": f"SELECT dataset_id, series_id, {STAT_AGGS} FROM samples_ev GROUP BY ALL",
    "datasets_ev": """SELECT dataset_id, min(ts) AS start_time, max(ts) AS end_time FROM samples_ev GROUP BY ALL""",
    "present_ev": "SELECT DISTINCT dataset_id, lower(metric) AS metric FROM samples_ev",
    **pack_views(event_rules.ALL_PACKS),
    "thresholds": """SELECT h.dataset_id, c.*, CASE WHEN c.hc_variable IS NULL THEN c.threshold ELSE
        CASE WHEN v IS NULL THEN NULL ELSE least(coalesce(hc_max, 'inf'::DOUBLE),
          greatest(coalesce(hc_min, '-inf'::DOUBLE), v * hc_factor)) END END AS resolved
      FROM (SELECT c.*, h.dataset_id AS did, CASE c.hc_variable WHEN 'total_physical_memory_mb'
        THEN total_physical_memory_mb WHEN 'logical_processor_count' THEN logical_processor_count::DOUBLE END AS v
        FROM conditions c, hosts_ev h) c JOIN hosts_ev h ON h.dataset_id = c.did""",
    "duration_ev": f"""SELECT s.dataset_id, s.series_id, c.pack_id, c.rule_id, c.cond_ord, c.resolved AS threshold,
        count_if({cmp('s.value', 'c.operator', 'c.resolved')}) * 100.0 / count(*) AS percent,
        count_if({cmp('s.value', 'c.operator', 'c.resolved')}) * 100.0 / count(*) >= max(c.duration_percent) AS fired
      FROM samples_ev s JOIN thresholds c ON s.dataset_id = c.dataset_id AND {MATCH}
      WHERE s.value IS NOT NULL AND c.window_s IS NULL AND c.aggregation <> 'trend' AND c.resolved IS NOT NULL
      GROUP BY ALL""",
    "trend_ev": f"""SELECT s.dataset_id, s.series_id, c.pack_id, c.rule_id, c.cond_ord, c.resolved AS threshold,
        t.trend_per_hour AS actual_value, {cmp('t.trend_per_hour', 'c.operator', 'c.resolved')} AS fired
      FROM series_ev s JOIN stats_ev t USING (dataset_id, series_id)
      JOIN thresholds c ON s.dataset_id = c.dataset_id AND {MATCH}
      WHERE c.window_s IS NULL AND c.aggregation = 'trend'""",
    # Windows straight from the definition: every start from the first valid sample on, then a range join.
    "win_bounds": """SELECT dataset_id, series_id, metric, instance, min(epoch_us(ts)) * 10 AS t0,
        max(epoch_us(ts)) * 10 AS t1, count(*) AS n FROM samples_ev WHERE value IS NOT NULL GROUP BY ALL""",
    "win_specs": """SELECT DISTINCT metric, instance, window_s, step_s, min_samples, aggregation,
        lower(metric) || '|' || coalesce(lower(instance), '') || '|' || aggregation || '|' || window_s || '|'
          || coalesce(step_s::VARCHAR, '') || '|' || min_samples AS spec_id
      FROM conditions WHERE window_s IS NOT NULL""",
    "win_starts": """SELECT s.dataset_id, s.series_id, c.spec_id, c.window_s, c.min_samples, c.aggregation, t0, t1,
        CASE WHEN step_s > 0 THEN step_s * 10000000 WHEN n < 2 THEN 600000000
          ELSE floor(greatest(1.0, (t1 / 10 - t0 / 10) / 1e6 / (n - 1)) * 1e7)::BIGINT END AS step
      FROM win_bounds s JOIN win_specs c ON """ + MATCH,
    "windows_ev": """SELECT dataset_id, series_id, spec_id, k, w0, window_s, count(*) AS n,
        CASE any_value(aggregation) WHEN 'avg' THEN avg(value) WHEN 'min' THEN min(value) WHEN 'max' THEN max(value)
          WHEN 'p90' THEN quantile_cont(value, 0.9) WHEN 'p95' THEN quantile_cont(value, 0.95)
          WHEN 'p99' THEN quantile_cont(value, 0.99) END AS value
      FROM (SELECT w.*, s.value FROM (SELECT *, t0 + k * step AS w0 FROM (
          SELECT *, unnest(range(0, (t1 - t0) // step + 1)) AS k FROM win_starts)) w
        JOIN samples_ev s ON s.dataset_id = w.dataset_id AND s.series_id = w.series_id
          AND s.value IS NOT NULL AND epoch_us(s.ts) * 10 >= w.w0
          AND epoch_us(s.ts) * 10 < w.w0 + w.window_s * 10000000)
      GROUP BY dataset_id, series_id, spec_id, k, w0, window_s, min_samples HAVING count(*) >= min_samples""",
    "window_hits_ev": f"""SELECT w.dataset_id, w.series_id, c.pack_id, c.rule_id, c.cond_ord, c.resolved AS threshold,
        bool_or({cmp('w.value', 'c.operator', 'c.resolved')}) AS fired,
        CASE WHEN any_value(c.operator) IN ('gt','ge') THEN max(w.value) WHEN any_value(c.operator) IN ('lt','le')
          THEN min(w.value) ELSE coalesce(arg_min(w.value, w.k) FILTER (WHERE {cmp('w.value', 'c.operator', 'c.resolved')}),
          arg_min(w.value, w.k)) END AS actual_value
      FROM windows_ev w JOIN win_specs p USING (spec_id)
      JOIN thresholds c ON c.dataset_id = w.dataset_id AND c.metric = p.metric AND c.instance IS NOT DISTINCT FROM p.instance
        AND c.window_s = p.window_s AND c.step_s IS NOT DISTINCT FROM p.step_s AND c.aggregation = p.aggregation
        AND c.min_samples = p.min_samples
      GROUP BY ALL""",
    "guards_ok": """SELECT d.dataset_id, r.pack_id, r.rule_id FROM datasets_ev d, rules r
      WHERE list_has_all((SELECT list(metric) FROM present_ev p WHERE p.dataset_id = d.dataset_id),
          list_transform(requires_all, lambda x: lower(x)))
        AND (len(requires_any) = 0 OR list_has_any((SELECT list(metric) FROM present_ev p
          WHERE p.dataset_id = d.dataset_id), list_transform(requires_any, lambda x: lower(x))))""",
    "skipped_ev": """SELECT DISTINCT dataset_id, pack_id, rule_id FROM thresholds
      WHERE hc_variable IS NOT NULL AND resolved IS NULL""",
    "hits_ev": """SELECT h.* FROM (
        SELECT dataset_id, series_id, pack_id, rule_id, cond_ord, threshold, NULL::DOUBLE AS actual_value
          FROM duration_ev WHERE fired
        UNION ALL SELECT dataset_id, series_id, pack_id, rule_id, cond_ord, threshold, actual_value FROM trend_ev WHERE fired
        UNION ALL SELECT dataset_id, series_id, pack_id, rule_id, cond_ord, threshold, actual_value FROM window_hits_ev WHERE fired) h
      SEMI JOIN guards_ok USING (dataset_id, pack_id, rule_id) ANTI JOIN skipped_ev USING (dataset_id, pack_id, rule_id)""",
    "evidence_ev": """SELECT h.dataset_id, h.pack_id, h.rule_id, h.cond_ord, s.series_ord, h.series_id, s.metric AS series_metric,
        h.threshold, coalesce(h.actual_value, CASE c.aggregation WHEN 'avg' THEN t.avg WHEN 'min' THEN t.min
          WHEN 'max' THEN t.max WHEN 'p90' THEN t.p90 WHEN 'p95' THEN t.p95 WHEN 'p99' THEN t.p99
          ELSE t.trend_per_hour END) AS actual_value,
        c.aggregation || '(' || c.metric || CASE WHEN c.instance IS NULL THEN '' ELSE '[' || c.instance || ']' END || ')'
        || CASE WHEN c.window_s IS NULL THEN '' ELSE ' over ' || CASE WHEN c.window_s % 3600 = 0 THEN (c.window_s // 3600) || 'h'
            WHEN c.window_s % 60 = 0 THEN (c.window_s // 60) || 'm' ELSE c.window_s || 's' END || ' rolling window' END
        || CASE c.operator WHEN 'gt' THEN ' > ' WHEN 'ge' THEN ' >= ' WHEN 'lt' THEN ' < ' WHEN 'le' THEN ' <= ' ELSE ' == ' END
        || regexp_replace(h.threshold::VARCHAR, '\\.0$', '')
        || CASE WHEN c.window_s IS NULL AND c.duration_percent > 1 THEN ' for >= '
            || regexp_replace(c.duration_percent::VARCHAR, '\\.0$', '') || '% of samples' ELSE '' END AS expression
      FROM hits_ev h JOIN conditions c USING (pack_id, rule_id, cond_ord) JOIN series_ev s USING (dataset_id, series_id)
      JOIN stats_ev t USING (dataset_id, series_id)""",
    "findings_ev": """SELECT f.*, r.rule_ord, r.severity, r.category, r.title, r.summary, r.recommendation_ids,
        d.start_time, d.end_time,
        sha256(f.rule_id || '|' || primary_metric || '|' || strftime(d.start_time, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00|'
          || strftime(d.end_time, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00') AS digest
      FROM (SELECT dataset_id, pack_id, rule_id, count(DISTINCT cond_ord) AS fired_conditions,
          arg_min(series_metric, cond_ord * 100000 + series_ord) AS primary_metric, count(*) AS evidence_count,
          string_agg(series_id || ' ' || expression || ' ' || round(actual_value, 4)::VARCHAR, '; '
            ORDER BY cond_ord, series_ord) AS evidence_text
        FROM evidence_ev GROUP BY ALL) f
      JOIN rules r USING (pack_id, rule_id) JOIN datasets_ev d USING (dataset_id)
      WHERE fired_conditions = n_conditions""",
}


def query(body: str, *roots: str, extra: dict | None = None) -> str:
    """``body`` with the WITH clause of every view it needs (transitively)."""
    views = {**VIEWS, **(extra or {})}
    needed, order = set(), []

    def add(name):
        if name in needed:
            return
        needed.add(name)
        for other in views:
            if other != name and _mentions(views[name], other):
                add(other)
        order.append(name)

    for name in roots or [n for n in views if _mentions(body, n)]:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n{views[n]}\n)" for n in order) + "\n" + body


def _mentions(sql: str, name: str) -> bool:
    import re
    return re.search(rf"(?<![\w.']){name}(?![\w'])", sql) is not None
