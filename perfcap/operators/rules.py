"""Rule evaluation: predicates, thresholds, findings, evidence."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from perfcap import fixed
from perfcap.functions import names, text
from perfcap.functions.compare import aggregation, compare, greatest, least, severity_rank
from perfcap.operators import rolling, skew
from perfcap.operators.stats import SERIES, STATISTICS, present_metrics

COND = ["pack_id", "rule_id", "cond_ord"]


def metric_match(condition: str = "c", series: str = "s") -> Column:
    """Metric equal ignoring case; instance unset, ``*`` or equal ignoring case."""
    wanted = F.col(f"{condition}.instance")
    return (F.lower(F.col(f"{series}.metric")) == F.lower(F.col(f"{condition}.metric"))) & (
        wanted.isNull() | (wanted == "*") | (F.lower(F.col(f"{series}.instance")) == F.lower(wanted)))


def candidate_series(conditions: DataFrame, series: DataFrame) -> DataFrame:
    """Every (condition, series) pair to evaluate.  Conditions are a rule book: thousands of rows at most."""
    c = F.broadcast(conditions).alias("c")
    s = series.alias("s")
    return s.join(c, metric_match()).select(
        "s.dataset_id", "s.series_id", "s.series_ord", F.col("s.metric").alias("series_metric"),
        F.col("s.instance").alias("series_instance"), "c.*")


# --- thresholds and guards -----------------------------------------------------

def host_variables(hosts: DataFrame) -> DataFrame:
    """(dataset_id, variable, host_value); the empty name stands for any unknown variable."""
    known = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("host_value"))
             for v in fixed.HOST_VARIABLES]
    other = F.struct(F.lit("").alias("variable"), F.lit(None).cast("double").alias("host_value"))
    return hosts.select("dataset_id", F.inline(F.array(*known, other)))


def _variable_key() -> Column:
    return F.when(F.col("hc_variable").isin(fixed.HOST_VARIABLES), F.col("hc_variable")).otherwise("")


def clamp(value: Column, low: Column, high: Column) -> Column:
    raised = F.when(value < low, low).otherwise(value)
    return F.when(raised > high, high).otherwise(raised)


def resolve_thresholds(conditions: DataFrame, hosts: DataFrame) -> DataFrame:
    """Host-relative conditions per dataset with the resolved threshold; unknown hosts drop out.

    Literal conditions do not depend on the dataset and are not expanded here.
    """
    relative = conditions.where(F.col("hc_variable").isNotNull()).withColumn("variable", _variable_key())
    value = F.col("host_value") * F.col("hc_factor")
    known = host_variables(hosts).where(F.col("host_value").isNotNull())
    return known.join(F.broadcast(relative), "variable").withColumn(
        "threshold", clamp(value, F.col("hc_min"), F.col("hc_max"))).drop("variable", "host_value")


def split_host_missing(conditions: DataFrame, hosts: DataFrame):
    """(dataset, pack, rule) skipped for a missing host variable, and the warnings that say so."""
    relative = conditions.where(F.col("hc_variable").isNotNull()).select(
        *COND, "rule_ord", "hc_variable", _variable_key().alias("variable"))
    unknown = host_variables(hosts).where(F.col("host_value").isNull())
    missing = unknown.join(F.broadcast(relative), "variable")
    skipped = missing.groupBy("dataset_id", "pack_id", "rule_id").agg(
        F.min("rule_ord").cast("long").alias("ord"),
        F.array_sort(F.collect_set(F.struct("cond_ord", "hc_variable"))).alias("_v"))
    variables = F.array_distinct(F.transform("_v", lambda v: F.concat(F.lit("host_context."), v["hc_variable"])))
    warnings = skipped.select(
        "dataset_id", F.lit("rule.host_context_unavailable").alias("code"),
        F.concat(F.lit("Rule '"), F.col("rule_id"), F.lit("' in pack '"), F.col("pack_id"), F.lit("' skipped: "),
                 F.array_join(variables, ", "), F.lit(" not provided.")).alias("message"),
        F.lit("informational").alias("severity"), "ord", "pack_id", "rule_id")
    return skipped.select("dataset_id", "pack_id", "rule_id"), warnings


def requirement_counts(items: DataFrame, ids: list, present: DataFrame) -> DataFrame:
    """How many of the ``requires_any`` / ``requires_all`` metrics of an item a dataset has.

    Only (dataset, item) pairs with at least one match appear.  The requirements are broadcast (rule book
    size); ``present`` is (dataset_id, lower-case metric), distinct.
    """
    def wanted(kind):
        return items.select(*ids, F.lit(kind).alias("_kind"), F.explode(F.array_distinct(
            F.transform(f"requires_{kind}", F.lower))).alias("metric"))

    need = F.broadcast(wanted("any").unionByName(wanted("all")))
    return present.join(need, "metric").groupBy("dataset_id", *ids).agg(
        F.count_if(F.col("_kind") == "any").alias("n_any"), F.count_if(F.col("_kind") == "all").alias("n_all"))


def _distinct_size(column: str) -> Column:
    return F.size(F.array_distinct(F.transform(column, F.lower)))


def guarded(rules: DataFrame) -> DataFrame:
    return rules.where((F.size("requires_any") > 0) | (F.size("requires_all") > 0))


def applicable_rules(rules: DataFrame, present: DataFrame) -> DataFrame:
    """(dataset, pack, rule) of the *guarded* rules whose guard holds: all of ``requires_all`` and, if given,
    one of ``requires_any``.  A rule without guard applies everywhere and is not listed."""
    ids = ["pack_id", "rule_id"]
    g = guarded(rules)
    counts = requirement_counts(g, ids, present)
    sized = counts.join(F.broadcast(g.select(
        *ids, _distinct_size("requires_all").alias("_all"), F.size("requires_any").alias("_any"))), ids)
    return sized.where((F.col("n_all") == F.col("_all")) & ((F.col("_any") == 0) | (F.col("n_any") > 0))).select(
        "dataset_id", *ids)


# --- predicates ----------------------------------------------------------------

def _sample_conditions(conditions: DataFrame) -> DataFrame:
    return conditions.where(F.col("window_s").isNull() & (F.col("aggregation") != "trend"))


def duration_hits(samples: DataFrame, conditions: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Share of valid samples that satisfy each condition, per series.

    The conditions are broadcast and the shares are partial aggregates, so the samples themselves are
    never shuffled and a hot series is no problem.
    """
    usable = _sample_conditions(conditions)
    valid = samples.where(F.col("value").isNotNull()).select(
        *SERIES, "metric", "instance", "value").alias("s")

    def shares(joined: DataFrame) -> DataFrame:
        return joined.groupBy(*SERIES, *COND, "operator", "threshold", "duration_percent").agg(
            F.count("*").alias("_valid"),
            F.count_if(compare(F.col("value"), F.col("operator"), F.col("threshold"))).alias("_hits"))

    columns = [*COND, "operator", "threshold", "duration_percent"]
    literal = F.broadcast(usable.where(F.col("hc_variable").isNull())).alias("c")
    parts = [shares(valid.join(literal, metric_match()).select(
        "s.dataset_id", "s.series_id", "s.value", *[f"c.{k}" for k in columns]))]
    if hosts is not None:
        relative = usable.where(F.col("hc_variable").isNotNull())
        named = F.broadcast(relative.select(F.lower("metric").alias("_m")).distinct())
        big = valid.select("*", F.lower("metric").alias("_m")).join(named, "_m", "left_semi")
        small = resolve_thresholds(relative, hosts).select(
            "dataset_id", F.lower("metric").alias("_m"), F.lower("instance").alias("_i"), *columns)
        pairs = skew.salted_join(big, small, ["dataset_id", "_m"], F.struct("series_id", "value"))
        parts.append(shares(pairs.where(
            F.col("_i").isNull() | (F.col("_i") == "*") | (F.lower("instance") == F.col("_i")))))
    percent = F.col("_hits") * 100.0 / F.col("_valid")
    return skew.union_all(parts).select(
        *SERIES, *COND, "threshold", percent.alias("percent"),
        (percent >= F.col("duration_percent")).alias("fired"))


def with_threshold(rows: DataFrame, hosts: DataFrame | None) -> DataFrame:
    """Rows of conditions per dataset with the threshold of a host-relative condition filled in.

    An unknown host variable leaves it null, which satisfies no comparison.
    """
    if hosts is None:
        return rows
    value = F.when(F.col("hc_variable") == "total_physical_memory_mb", F.col("total_physical_memory_mb")).when(
        F.col("hc_variable") == "logical_processor_count", F.col("logical_processor_count").cast("double"))
    resolved = F.coalesce("threshold", clamp(value * F.col("hc_factor"), F.col("hc_min"), F.col("hc_max")))
    return rows.join(hosts, "dataset_id", "left").withColumn("threshold", resolved).drop(
        "total_physical_memory_mb", "logical_processor_count")


def trend_hits(stats: DataFrame, series: DataFrame, conditions: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Slope against the threshold; the share of samples plays no part."""
    wanted = F.broadcast(conditions.where(F.col("window_s").isNull() & (F.col("aggregation") == "trend"))).alias("c")
    named = series.join(stats.select(*SERIES, "trend_per_hour"), SERIES).alias("s")
    rows = named.join(wanted, metric_match()).select(
        "s.dataset_id", "s.series_id", *[f"c.{k}" for k in COND], "c.operator", "c.threshold", "c.hc_variable",
        "c.hc_factor", "c.hc_min", "c.hc_max", F.col("s.trend_per_hour").alias("actual_value"))
    return with_threshold(rows, hosts).select(
        *SERIES, *COND, "threshold", "actual_value",
        compare(F.col("actual_value"), F.col("operator"), F.col("threshold")).alias("fired"))


def window_specs(conditions: DataFrame) -> DataFrame:
    """Distinct rolling-window specifications of the windowed conditions."""
    w = conditions.where(F.col("window_s").isNotNull())
    return w.select(
        spec_of_condition().alias("spec_id"), "metric", "instance", F.col("window_s").alias("duration_s"), "step_s",
        "min_samples", "aggregation").distinct()


def spec_of_condition() -> Column:
    return F.concat_ws("|", F.lower("metric"), F.coalesce(F.lower("instance"), F.lit("")), "aggregation",
                       F.col("window_s").cast("string"), F.coalesce(F.col("step_s").cast("string"), F.lit("")),
                       F.col("min_samples").cast("string"))


def window_hits(windows: DataFrame, conditions: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Fires if any window satisfies; reports the worst window (highest for gt/ge, lowest for lt/le, for eq
    the first that matches, else the first)."""
    wanted = conditions.where(F.col("window_s").isNotNull()).select(
        spec_of_condition().alias("spec_id"), *COND, "operator", "threshold", "hc_variable", "hc_factor", "hc_min",
        "hc_max")
    rows = with_threshold(windows.select(*SERIES, "spec_id", "k", "value").join(F.broadcast(wanted), "spec_id"), hosts)
    op, k = F.col("operator"), F.col("k")
    ok = compare(F.col("value"), op, F.col("threshold"))
    grouped = rows.groupBy(*SERIES, *COND, "operator", "threshold").agg(
        F.bool_or(ok).alias("fired"), greatest(F.col("value")).alias("_max"), least(F.col("value")).alias("_min"),
        F.min_by("value", F.when(ok, k)).alias("_match"), F.min_by("value", "k").alias("_first"))
    worst = F.when(op.isin("gt", "ge"), F.col("_max")).when(op.isin("lt", "le"), F.col("_min")).otherwise(
        F.coalesce("_match", "_first"))
    return grouped.select(*SERIES, *COND, "threshold", worst.alias("actual_value"), "fired")


# --- findings ------------------------------------------------------------------

def build_findings(detail: DataFrame, rules: DataFrame, recommendations: DataFrame, datasets: DataFrame) -> DataFrame:
    """Findings with ordered evidence, recommendations, content id and per-dataset ordinal.

    ``detail``: one row per fired (condition, series) with the condition and the statistics of the series;
    a null ``actual_value`` means the aggregate named by the condition.
    """
    actual = F.coalesce(F.col("actual_value"), aggregation(F.col("aggregation")))
    trigger = F.struct(
        text.trigger_expression(F.col, F.col("threshold")).alias("expression"), F.lit(True).alias("result"),
        actual.alias("actual_value"), F.col("threshold").alias("expected_value"))
    item = F.struct(
        "cond_ord", "series_ord", "series_id", F.col("series_metric").alias("canonical_metric"),
        F.struct(*STATISTICS).alias("statistics"), F.array(trigger).alias("trigger_details"))
    # Evidence of one finding: at most conditions x counters of one capture line.
    grouped = detail.groupBy("dataset_id", "pack_id", "rule_id").agg(
        F.count_distinct("cond_ord").alias("_fired_conditions"), F.array_sort(F.collect_list(item)).alias("_items"))
    joined = grouped.join(F.broadcast(rules), ["pack_id", "rule_id"]).where(
        (F.col("_fired_conditions") == F.col("n_conditions")) & (F.col("n_conditions") > 0))
    joined = joined.join(datasets.select("dataset_id", "start_time", "end_time"), "dataset_id")
    evidence = F.transform("_items", lambda e: e.dropFields("cond_ord", "series_ord"))
    primary = F.get("_items", F.lit(0))["canonical_metric"]
    out = joined.select(
        "dataset_id",
        names.finding_id(F.col("rule_id"), primary, F.col("start_time"), F.col("end_time")).alias("finding_id"),
        "pack_id", "rule_id", "rule_ord", primary.alias("primary_metric"), "severity", "category", "title", "summary",
        F.coalesce("explanation", F.lit("")).alias("explanation"), "start_time", "end_time",
        evidence.alias("evidence"), "recommendation_ids")
    return finding_order(with_recommendations(out, recommendations))


def with_recommendations(findings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Recommendation ids -> definitions of the same pack, in order; undefined ids are dropped."""
    defs = F.broadcast(recommendations.groupBy("pack_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "rec_id", F.struct("rec_id", "priority", "text", "rationale", "links")))).alias("_defs")))
    found = F.filter(F.transform("recommendation_ids", lambda i: F.try_element_at("_defs", i)), lambda r: r.isNotNull())
    empty = F.filter(F.array(F.struct(
        F.lit("").alias("rec_id"), F.lit("").alias("priority"), F.lit("").alias("text"),
        F.lit(None).cast("string").alias("rationale"), F.array().cast("array<string>").alias("links"))), lambda r: F.lit(False))
    return findings.join(defs, "pack_id", "left").withColumn(
        "recommendations", F.when(F.col("_defs").isNull(), empty).otherwise(found)).drop("_defs", "recommendation_ids")


def finding_order(findings: DataFrame) -> DataFrame:
    """``finding_ord`` from 1: severity descending, category, rule, finding id."""
    order = Window.partitionBy("dataset_id").orderBy(
        severity_rank(F.col("severity")).desc(), "category", "rule_id", "finding_id")
    return findings.withColumn("finding_ord", F.row_number().over(order))


def evaluate_rules(samples: DataFrame, series: DataFrame, stats: DataFrame, datasets: DataFrame, hosts: DataFrame,
                   book, selected: DataFrame | None = None, materialize=None):
    """(findings, warnings) of every dataset against every rule in one pass.

    ``book`` is a :class:`perfcap.sources.packs.RuleBook`.  ``hosts`` has one row per dataset (columns null when
    unknown).  ``selected`` restricts packs per dataset (dataset_id, pack_id).
    ``materialize`` writes what the window percentiles read more than once.
    """
    conditions, rules = book.conditions, book.rules
    hits = skew.union_all([
        duration_hits(samples, conditions, hosts if book.has_host_samples else None).where("fired").select(
            *SERIES, *COND, "threshold", F.lit(None).cast("double").alias("actual_value")),
        *([window_hits(
            rolling.rolling_windows(samples, window_specs(conditions), book.has_window_percentiles, materialize),
            conditions, hosts if book.has_host else None).where("fired").drop("fired")] if book.has_windows else []),
    ])
    detail = _series_detail(hits, stats, series, conditions, hosts if book.has_host else None)
    keys = ["dataset_id", "pack_id", "rule_id"]
    if book.has_guards:
        free = F.broadcast(guarded(rules).select("pack_id", "rule_id", F.lit(True).alias("_guarded")))
        passed = applicable_rules(rules, present_metrics(series)).withColumn("_passed", F.lit(True))
        detail = detail.join(free, ["pack_id", "rule_id"], "left").join(passed, keys, "left").where(
            F.col("_guarded").isNull() | F.col("_passed")).drop("_guarded", "_passed")
    skipped, warnings = split_host_missing(conditions, hosts)
    if book.has_host:
        detail = detail.join(skipped, keys, "left_anti")
    if selected is not None:
        detail = detail.join(selected, ["dataset_id", "pack_id"], "left_semi")
        warnings = warnings.join(selected, ["dataset_id", "pack_id"], "left_semi")
    return build_findings(detail, rules, book.recommendations, datasets), warnings


def _series_detail(hits: DataFrame, stats: DataFrame, series: DataFrame, conditions: DataFrame,
                   hosts: DataFrame | None) -> DataFrame:
    """Fired conditions with the statistics of their series.

    Trend conditions need nothing but the statistics, so they are decided here, in the same pass over them.
    """
    fired = hits.groupBy(*SERIES).agg(
        F.collect_list(F.struct(*COND, "threshold", "actual_value")).alias("_hits"))  # at most one per condition
    rows = series.join(stats, SERIES).join(fired, SERIES, "left")
    trend = conditions.where(F.col("window_s").isNull() & (F.col("aggregation") == "trend"))
    trend = F.broadcast(trend.groupBy(F.lower("metric").alias("_m")).agg(F.collect_list(F.struct(
        *COND, "instance", "operator", "threshold", "hc_variable", "hc_factor", "hc_min", "hc_max")).alias("_trend")))
    rows = rows.withColumn("_m", F.lower("metric")).join(trend, "_m", "left")
    rows = rows.where(F.col("_hits").isNotNull() | F.col("_trend").isNotNull())
    if hosts is not None:
        rows = rows.join(hosts, "dataset_id", "left")

    def resolved(c):
        if hosts is None:
            return c["threshold"]
        value = F.when(c["hc_variable"] == "total_physical_memory_mb", F.col("total_physical_memory_mb")).when(
            c["hc_variable"] == "logical_processor_count", F.col("logical_processor_count").cast("double"))
        return F.coalesce(c["threshold"], clamp(value * c["hc_factor"], c["hc_min"], c["hc_max"]))

    def trend_hit(c):
        return F.struct(*[c[k].alias(k) for k in COND], resolved(c).alias("threshold"),
                        F.col("trend_per_hour").alias("actual_value"))

    matches = F.filter("_trend", lambda c: (
        c["instance"].isNull() | (c["instance"] == "*") | (F.lower("instance") == F.lower(c["instance"])))
        & compare(F.col("trend_per_hour"), c["operator"], resolved(c)))
    empty = F.array().cast("array<struct<pack_id:string,rule_id:string,cond_ord:int,threshold:double,actual_value:double>>")
    rows = rows.withColumn("_hits", F.concat(
        F.coalesce("_hits", empty), F.coalesce(F.transform(matches, trend_hit), empty)))
    rows = rows.select(
        *SERIES, "series_ord", F.col("metric").alias("series_metric"), *STATISTICS, F.inline("_hits"))
    cond = F.broadcast(conditions.select(*COND, "metric", "instance", "aggregation", "operator", "duration_percent",
                                         "window_s"))
    return rows.join(cond, COND)
