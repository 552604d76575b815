"""Alert life cycle as keyed streaming state; the same outcomes as ``operators.alerts.alert_history``."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from perfcap import fixed
from perfcap.operators.alerts import ALERT, notification_outbox

OUTPUT = ("workspace_id STRING, rule_id STRING, segment BIGINT, at TIMESTAMP, action STRING, run_id STRING, outcome STRING, "
          "event STRING, alert_severity STRING, severity STRING, category STRING, title STRING, policy_applied STRING, "
          "until TIMESTAMP, note STRING")
STATE = "segment BIGINT, status STRING, severity STRING, snoozed_until TIMESTAMP"
_RANK = {"critical": 3, "warning": 2, "informational": 1}


def step(state: dict, row: dict) -> tuple:
    """(new state, outcome, notification) for one event of an alert."""
    active = state["status"] in ("open", "acknowledged")
    now = dict(state)
    if row["action"] == "finding":
        if not active:
            now.update(segment=state["segment"] + 1, status="open", severity=row["severity"], snoozed_until=None)
            return now, "created", "alert.created"
        if _RANK.get(row["severity"], 0) <= _RANK.get(state["severity"], 0):
            return now, "updated", None
        now["severity"] = row["severity"]
        snoozed = state["snoozed_until"] is not None and state["snoozed_until"] > row["at"]
        return now, "escalated", None if snoozed else "alert.escalated"
    accepted, event = False, None
    if row["action"] == "acknowledge" and state["status"] == "open":
        accepted, event, now["status"] = True, "alert.acknowledged", "acknowledged"
    elif row["action"] == "resolve" and active:
        accepted, event, now["status"] = True, "alert.resolved", "resolved"
    elif row["action"] == "unsnooze" and active:
        accepted, now["snoozed_until"] = True, None
    elif row["action"] == "snooze" and active and row["until"] is not None:
        skew, limit = pd.Timedelta(seconds=fixed.SNOOZE_SKEW_SECONDS), pd.Timedelta(days=fixed.SNOOZE_MAX_DAYS)
        accepted = row["at"] - skew < row["until"] <= row["at"] + limit
        if accepted:
            now["snoozed_until"] = row["until"]
    return now, "accepted" if accepted else "rejected", event


class AlertProcessor(StatefulProcessor):
    """One value per (workspace, rule): segment, status, severity, snooze."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alert = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The events of one alert in one micro-batch, in the same total order as the batch operator.
        events = pd.concat(list(rows), ignore_index=True)
        events["_kind"] = (events["action"] != "finding").astype(int)
        events = events.assign(_run=events["run_id"].fillna("")).sort_values(["at", "_kind", "action", "_run"])
        state = {"segment": 0, "status": "none", "severity": None, "snoozed_until": None}
        if self.alert.exists():
            state = dict(zip(state, self.alert.get()))
            if state["snoozed_until"] is not None:
                state["snoozed_until"] = pd.Timestamp(state["snoozed_until"]).tz_localize(None)
        out = []
        for row in events.astype(object).where(events.notna(), None).to_dict("records"):
            state, outcome, event = step(state, row)
            out.append({
                **{c: row[c] for c in ("at", "action", "run_id", "severity", "category", "title", "policy_applied", "until", "note")},
                "workspace_id": key[0], "rule_id": key[1], "segment": state["segment"], "outcome": outcome, "event": event,
                "alert_severity": state["severity"]})
        snoozed = state["snoozed_until"]
        self.alert.update((state["segment"], state["status"], state["severity"],
                           None if snoozed is None else pd.Timestamp(snoozed).to_pydatetime()))
        columns = [c.split(" ")[0] for c in OUTPUT.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        frame["until"] = pd.to_datetime(frame["until"])
        yield frame

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame) -> DataFrame:
    """Life-cycle rows of a stream of findings and commands (columns of ``alerts.lifecycle_input``).

    Needs the RocksDB state store.  State is one small row per alert; events must arrive in time order between
    micro-batches.
    """
    return events.groupBy(*ALERT).transformWithStateInPandas(
        statefulProcessor=AlertProcessor(), outputStructType=OUTPUT, outputMode="append", timeMode="none")


def outbox_stream(history: DataFrame, sinks: DataFrame) -> DataFrame:
    """Notifications of a stream of life-cycle rows for a static table of sinks."""
    return notification_outbox(history.where("event IS NOT NULL"), sinks)
