"""Alerts: policy escalation, life cycle over runs and commands, notification outbox.

The life cycle of an alert (workspace, rule) is a function of its time-ordered findings and commands.  It is
computed with running aggregates over that history, sliced by time (see ``skew.running``), for all alerts at once.
"""

from pyspark.sql import Column, DataFrame, functions as F

from perfcap import fixed
from perfcap.functions.compare import severity_of_rank, severity_rank
from perfcap.operators import crossrun, skew
from perfcap.session import cut_lineage

ALERT = ["workspace_id", "rule_id"]


def dedup_findings(findings: DataFrame) -> DataFrame:
    """One finding per (run, rule): the most severe, the first on a tie."""
    rest = [c for c in findings.columns if c not in ("workspace_id", "run_id", "rule_id")]
    order = F.struct((-severity_rank(F.col("severity"))).alias("r"), F.col("finding_ord").alias("o"))
    return findings.groupBy("workspace_id", "run_id", "rule_id").agg(
        F.min_by(F.struct(*rest), order).alias("_f")).select("workspace_id", "run_id", "rule_id", "_f.*")


def escalations(runs: DataFrame, findings: DataFrame, window: int = fixed.POLICY_WINDOW,
                hits: int = fixed.POLICY_HITS) -> DataFrame:
    """Warnings of a run that fired in enough of the preceding runs.

    A hit at ordinal n counts for the runs n+1 … n+window-1, so the sliding count is a plain grouped sum.
    """
    order = crossrun.numbered_runs(runs).select("workspace_id", "run_id", "run_ord")
    ordered = findings.select("workspace_id", "run_id", F.lower("rule_id").alias("_rule"), F.lower("severity").alias("_s"))
    fired = ordered.groupBy("workspace_id", "run_id", "_rule").agg(F.bool_or(F.col("_s") == "warning").alias("_warning"))
    fired = fired.join(order, ["workspace_id", "run_id"])
    later = fired.select(
        "workspace_id", "_rule",
        F.explode(F.sequence(F.col("run_ord") + 1, F.col("run_ord") + (window - 1))).alias("run_ord"))
    prior = later.groupBy("workspace_id", "_rule", "run_ord").agg(F.count("*").alias("prior_hits"))
    rows = fired.where("_warning").join(prior, ["workspace_id", "_rule", "run_ord"], "left")
    total = F.coalesce("prior_hits", F.lit(0)) + 1
    available = F.least(F.col("run_ord") - 1, F.lit(window - 1))
    return rows.where((total >= hits) & (available >= hits - 1)).select(
        "workspace_id", "run_id", F.col("_rule").alias("rule_key"), F.lit("critical").alias("new_severity"),
        F.lit(fixed.POLICY_ID).alias("policy_rule_id"), total.cast("long").alias("total_hits"),
        (available + 1).cast("long").alias("window_runs"))


def finding_events(runs: DataFrame, findings: DataFrame, escalated: DataFrame | None = None) -> DataFrame:
    """Deduplicated findings of completed runs as life-cycle events, with the effective severity."""
    done = runs.where(F.col("status") == "completed").select(
        "workspace_id", "run_id", F.coalesce("completed_at", "created_at").alias("at"))
    rows = dedup_findings(findings).join(done, ["workspace_id", "run_id"])
    if escalated is None:
        rows = rows.withColumns({"new_severity": F.lit(None).cast("string"), "policy_rule_id": F.lit(None).cast("string")})
    else:
        rows = rows.withColumn("rule_key", F.lower("rule_id")).join(
            escalated.select("workspace_id", "run_id", "rule_key", "new_severity", "policy_rule_id"),
            ["workspace_id", "run_id", "rule_key"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "workspace_id", "rule_id", "at", F.lit("finding").alias("action"), "run_id",
        F.coalesce("new_severity", "severity").alias("severity"), "category", "title",
        F.col("policy_rule_id").alias("policy_applied"), none("timestamp").alias("until"), none("string").alias("note"))


def lifecycle_input(events: DataFrame, commands: DataFrame | None) -> DataFrame:
    """Findings and commands in one table.  At the same instant findings come first."""
    if commands is None:
        return events
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return events.unionByName(commands.select(
        "workspace_id", "rule_id", "at", "action", none("string", "run_id"), none("string", "severity"),
        none("string", "category"), none("string", "title"), none("string", "policy_applied"), "until", "note"))


def alert_history(events: DataFrame, commands: DataFrame | None = None, slice_unit: str = "month",
                  materialize=cut_lineage) -> DataFrame:
    """Every event with its segment (the n-th alert of the rule), its outcome and the notification it causes.

    outcome: ``created``, ``updated``, ``escalated``, ``accepted`` or ``rejected``.  The passes read their input
    twice, so the input and the middle result are written once (``materialize``).
    """
    keep = materialize or (lambda df: df)
    rows = lifecycle_input(events, commands)
    rank = F.when(F.col("action") == "finding", 0).otherwise(1)
    # A total order: commands given at one instant apply in alphabetical order of their action.
    rows = keep(rows).withColumn("_o", F.struct("at", rank.alias("r"), "action", F.coalesce("run_id", F.lit("")).alias("id")))
    slice_col = F.date_trunc(slice_unit, "at")
    is_finding, is_resolve = F.col("action") == "finding", F.col("action") == "resolve"

    # Active before this event = the last finding or resolve was a finding.
    one = skew.running(rows, ALERT, ["_o"], slice_col,
                       {"_last": ("last", F.when(is_finding, F.lit(1)).when(is_resolve, F.lit(0)))})
    one = one.withColumn("_active", F.coalesce(F.col("_last") == 1, F.lit(False)))
    one = one.withColumn("_creates", is_finding & ~F.col("_active"))

    two = skew.running(one, ALERT, ["_o"], slice_col, {"_created": ("sum", F.col("_creates").cast("long"))})
    two = two.withColumn("segment", F.col("_created") + F.col("_creates").cast("long"))
    two = keep(two)
    at, until = F.unix_micros("at"), F.unix_micros("until")
    in_range = (until > at - fixed.SNOOZE_SKEW_SECONDS * 1_000_000) & (until <= at + fixed.SNOOZE_MAX_DAYS * 86_400_000_000)
    snoozes = F.col("_active") & (((F.col("action") == "snooze") & in_range) | (F.col("action") == "unsnooze"))

    # The segment never decreases, so "within the segment" is a comparison of the last or largest value.
    three = skew.running(two, ALERT, ["_o"], slice_col, {
        "_worst": ("max", F.when(is_finding, F.col("segment") * 10 + severity_rank(F.col("severity")))),
        "_acked": ("max", F.when((F.col("action") == "acknowledge") & F.col("_active"), F.col("segment"))),
        "_snooze": ("last", F.when(snoozes, F.struct("segment", F.when(F.col("action") == "snooze", F.col("until")).alias("until")))),
    })
    mine = F.col("segment")
    before = F.when(F.floor(F.col("_worst") / 10) == mine, (F.col("_worst") % 10).cast("int"))
    now_rank = severity_rank(F.col("severity"))
    acked = F.coalesce(F.col("_acked") == mine, F.lit(False))
    snoozed_until = F.when(F.col("_snooze.segment") == mine, F.col("_snooze.until"))
    escalates = is_finding & F.col("_active") & (now_rank > before)
    accepted = F.col("_active") & (
        ((F.col("action") == "acknowledge") & ~acked) | is_resolve | (F.col("action") == "unsnooze")
        | ((F.col("action") == "snooze") & F.coalesce(in_range, F.lit(False))))
    outcome = (
        F.when(F.col("_creates"), "created").when(escalates, "escalated").when(is_finding, "updated")
        .when(accepted, "accepted").otherwise("rejected"))
    quiet = F.coalesce(snoozed_until > F.col("at"), F.lit(False))
    notify = (
        F.when(F.col("_creates"), "alert.created").when(escalates & ~quiet, "alert.escalated")
        .when(accepted & (F.col("action") == "acknowledge"), "alert.acknowledged")
        .when(accepted & is_resolve, "alert.resolved"))
    current = F.greatest(F.coalesce(before, F.lit(-1)), F.when(is_finding, now_rank).otherwise(-1))
    return three.select(
        *ALERT, "segment", "at", "action", "run_id", outcome.alias("outcome"), notify.alias("event"),
        F.when(current >= 0, F.coalesce(severity_of_rank(current), F.col("severity"))).alias("alert_severity"),
        "severity", "category", "title", "policy_applied", "until", "note", F.col("_o").alias("event_order"))


def alerts_of(history: DataFrame) -> DataFrame:
    """Current state of every alert from its history."""
    o = F.col("event_order")
    finding, ok = F.col("action") == "finding", F.col("outcome") == "accepted"
    valid = history.where((F.col("outcome") != "rejected") & (F.col("segment") > 0))
    at_first = lambda c: F.min_by(c, F.when(finding, o))
    at_last = lambda c: F.max_by(c, F.when(finding, o))
    command = lambda name: ok & (F.col("action") == name)
    snooze = ok & F.col("action").isin("snooze", "unsnooze")
    rows = valid.groupBy(*ALERT, "segment").agg(
        at_last("alert_severity").alias("severity"), at_first("category").alias("category"), at_first("title").alias("title"),
        F.min(F.when(command("acknowledge"), F.col("at"))).alias("acknowledged_at"),
        F.max(F.when(command("resolve"), F.col("at"))).alias("resolved_at"),
        F.max_by("note", F.when(command("resolve"), o)).alias("resolution_note"),
        at_first("run_id").alias("triggering_run_id"), at_last("run_id").alias("latest_run_id"),
        at_first("at").alias("triggered_at"), at_last("at").alias("last_seen_at"),
        at_last("policy_applied").alias("policy_applied"),
        F.max_by(F.when(F.col("action") == "snooze", F.col("until")), F.when(snooze, o)).alias("snoozed_until"))
    status = F.when(F.col("resolved_at").isNotNull(), "resolved").when(
        F.col("acknowledged_at").isNotNull(), "acknowledged").otherwise("open")
    return rows.withColumn("status", status)


def alert_events(history: DataFrame) -> DataFrame:
    """Notifications in the order they arise."""
    return history.where(F.col("event").isNotNull())


# --- notifications -------------------------------------------------------------

def hmac_pads(secret: Column) -> tuple[Column, Column]:
    """Inner and outer padded key of HMAC-SHA256: the key (its digest beyond 64 bytes), zeros, each byte XORed."""
    key = F.when(F.octet_length(secret) > 64, F.unhex(F.sha2(F.encode(secret, "UTF-8"), 256))).otherwise(F.encode(secret, "UTF-8"))
    digits = F.rpad(F.hex(key), 128, "0")

    def xored(byte: int) -> Column:
        pair = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int").bitwiseXOR(F.lit(byte))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(pair(i)), 2, "0")), ""))

    return xored(0x36), xored(0x5C)


def hmac_sha256(inner: Column, outer: Column, payload: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a text, from the padded keys."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(payload, "UTF-8")), 256))), 256)


def notification_outbox(events: DataFrame, sinks: DataFrame) -> DataFrame:
    """One row per event and enabled sink of the workspace that subscribes to it, with payload and signature."""
    names = F.filter(F.transform(F.split("events", ","), lambda e: F.trim(e)), lambda e: e != "")
    signed = F.coalesce(F.col("secret") != "", F.lit(False))
    pads = [F.when(signed, pad).alias(name) for name, pad in zip(("_inner", "_outer"), hmac_pads(F.col("secret")))]  # once a sink
    enabled = sinks.where("enabled").select(
        "workspace_id", "sink_id", F.col("name").alias("sink_name"), *pads, F.explode(F.array_distinct(names)).alias("event"))
    alert = F.struct("workspace_id", "rule_id", F.col("alert_severity").alias("severity"), "category", "title",
                     F.col("run_id").alias("latest_run_id"))
    payload = F.to_json(F.struct("event", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), alert.alias("alert")))
    rows = events.join(enabled, ["workspace_id", "event"]).select(
        "sink_id", "sink_name", "workspace_id", "rule_id", "segment", "at", "event", payload.alias("payload"), "_inner", "_outer")
    signature = F.concat(F.lit("sha256="), hmac_sha256(F.col("_inner"), F.col("_outer"), F.col("payload")))
    return rows.withColumn("signature", signature).drop("_inner", "_outer")
