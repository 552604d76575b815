"""Rule packs over the event and line-item views, in the structure of a pack file."""

EVENT_PACK = {
    "schema_version": "perfcap.pack/v1.1",
    "pack_id": "event-core",
    "pack_name": "Event core",
    "version": "1.2.0",
    "description": "Thresholds over the event series.",
    "applicability": {"always": True},
    "metric_aliases": {"custom.counter": ["\\\\*\\Custom Object\\Counter Name (ms)"]},
    "recommendations": {
        "check-source": {"priority": "high", "text": "Check the source of the events.", "rationale": "It leads.",
                         "links": ["https://example.org/a"]},
        "add-capacity": {"priority": "low", "text": "Add capacity."},
        "review-limits": {"text": "Review the limits."},
    },
    "rules": [
        {"rule_id": "high-click-value", "severity": "warning", "category": "cpu", "title": "High click values",
         "summary": "Clicks above 80.", "explanation": "Many clicks carry a high value.",
         "conditions": [{"metric": "events.click", "aggregation": "avg", "operator": "gt", "threshold": 80,
                         "duration_percent": 20}],
         "recommendations": ["check-source", "add-capacity"]},
        {"rule_id": "critical-error-value", "severity": "critical", "category": "cpu", "title": "Critical errors",
         "summary": "Errors at 95 or more.",
         "conditions": [{"metric": "EVENTS.ERROR", "instance": "*", "aggregation": "max", "operator": "ge",
                         "threshold": 95, "duration_percent": 10}],
         "recommendations": ["missing-id", "check-source"]},
        {"rule_id": "error-and-view", "severity": "warning", "category": "memory", "title": "Errors with views",
         "summary": "Errors and views are both high.",
         "conditions": [{"metric": "events.error", "aggregation": "avg", "operator": "gt", "threshold": 50,
                         "duration_percent": 50},
                        {"metric": "events.view", "aggregation": "p95", "operator": "ge", "threshold": 60,
                         "duration_percent": 30}],
         "recommendations": ["review-limits"]},
        {"rule_id": "rising-purchase", "severity": "warning", "category": "disk", "title": "Rising purchases",
         "summary": "Purchases rise.",
         "conditions": [{"metric": "events.purchase", "aggregation": "trend", "operator": "gt", "threshold": 2}]},
        {"rule_id": "signup-window", "severity": "critical", "category": "network", "title": "Signup burst",
         "summary": "Signups are high over six hours.",
         "conditions": [{"metric": "events.signup", "aggregation": "avg", "operator": "gt", "threshold": 75,
                         "window": {"duration_seconds": 21600, "step_seconds": 3600, "min_samples": 2}}],
         "recommendations": ["check-source"]},
        {"rule_id": "view-tail", "severity": "informational", "category": "network", "title": "View tail",
         "summary": "A window of views has a low p90.",
         "conditions": [{"metric": "events.view", "instance": "I1", "aggregation": "p90", "operator": "lt",
                         "threshold": 30, "window": {"duration_seconds": 28800, "min_samples": 1}}]},
        {"rule_id": "low-view", "severity": "informational", "category": "system", "title": "Low views",
         "summary": "A view below 5.",
         "conditions": [{"metric": "events.view", "instance": "i0", "aggregation": "min", "operator": "lt",
                         "threshold": 5}]},
        {"rule_id": "view-against-memory", "severity": "warning", "category": "memory", "title": "Views for memory",
         "summary": "Views are high for the memory of the host.",
         "conditions": [{"metric": "events.view", "aggregation": "avg", "operator": "gt", "duration_percent": 25,
                         "threshold": {"host_context": "total_physical_memory_mb", "factor": 0.02, "minimum": 50,
                                       "maximum": 75}}]},
        {"rule_id": "clicks-per-cpu", "severity": "critical", "category": "cpu", "title": "Clicks for CPUs",
         "summary": "Clicks are high for the CPU count.",
         "conditions": [{"metric": "events.click", "aggregation": "max", "operator": "ge", "duration_percent": 40,
                         "threshold": {"host_context": "logical_processor_count", "factor": 10}}]},
        {"rule_id": "guarded-any", "severity": "warning", "category": "system", "title": "Guarded by any",
         "summary": "Applies where signups exist.",
         "applies_when": {"requires_any": ["events.signup", "events.none"], "requires_all": ["events.click"]},
         "conditions": [{"metric": "events.click", "aggregation": "max", "operator": "le", "threshold": 10,
                         "duration_percent": 20}]},
        {"rule_id": "guarded-never", "severity": "critical", "category": "system", "title": "Never applies",
         "summary": "Needs a metric no capture has.", "applies_when": {"requires_all": ["events.none"]},
         "conditions": [{"metric": "events.click", "aggregation": "max", "operator": "ge", "threshold": 0}]},
        {"rule_id": "absent-metric", "severity": "critical", "category": "system", "title": "Absent metric",
         "summary": "One condition has no series.",
         "conditions": [{"metric": "events.click", "aggregation": "max", "operator": "ge", "threshold": 0},
                        {"metric": "events.none", "aggregation": "max", "operator": "ge", "threshold": 0}]},
    ],
}

LINE_PACK = {
    "schema_version": "perfcap.pack/v1",
    "pack_id": "line-items",
    "pack_name": "Line items",
    "version": "0.3.1",
    "applicability": {"requires_any": ["lineitem.quantity", "events.purchase"]},
    "rules": [
        {"rule_id": "large-quantity", "severity": "warning", "category": "sql", "title": "Large quantity",
         "summary": "Quantities above 45.",
         "conditions": [{"metric": "lineitem.quantity", "aggregation": "p95", "operator": "gt", "threshold": 45,
                         "duration_percent": 10}]},
        {"rule_id": "no-discount", "severity": "informational", "category": "sql", "title": "No discount",
         "summary": "Discount is zero.",
         "conditions": [{"metric": "lineitem.discount", "aggregation": "min", "operator": "eq", "threshold": 0,
                         "duration_percent": 9}]},
        {"rule_id": "high-price", "severity": "critical", "category": "sql", "title": "High price",
         "summary": "Prices above 90000.",
         "conditions": [{"metric": "lineitem.extendedprice", "instance": "line3", "aggregation": "avg",
                         "operator": "ge", "threshold": 90000, "duration_percent": 5}]},
    ],
}

CALL_PACK = {
    "schema_version": "perfcap.pack/v1",
    "pack_id": "needs-all",
    "pack_name": "Needs all",
    "version": "1.0.0",
    "applicability": {"requires_any": ["events.click"], "requires_all": ["events.click", "Events.Signup", "events.view"]},
    "rules": [{"rule_id": "any-click", "severity": "informational", "category": "system", "title": "Any click",
               "summary": "There are clicks.",
               "conditions": [{"metric": "events.click", "aggregation": "max", "operator": "ge", "threshold": 0}]}],
}

NO_BLOCK_PACK = {"schema_version": "perfcap.pack/v1", "pack_id": "no-block", "pack_name": "No block",
                 "version": "1.0.0", "rules": []}

BROKEN_PACK = {
    "schema_version": "other/v2",
    "pack_id": "Broken_Pack",
    "pack_name": " ",
    "version": "1.0",
    "recommendations": {"odd": {"priority": "urgent", "text": ""}},
    "rules": [
        {"rule_id": "bad", "severity": "fatal", "category": "none", "title": "", "summary": " ",
         "conditions": [{"metric": "m", "aggregation": "sum", "operator": "ne", "threshold": 1,
                         "duration_percent": 101},
                        {"metric": "h", "aggregation": "trend", "operator": "gt",
                         "threshold": {"host_context": "disk_count"},
                         "window": {"duration_seconds": 10, "step_seconds": 20, "min_samples": 0}}],
         "recommendations": ["odd", "gone"]},
        {"rule_id": "bad", "severity": "warning", "category": "cpu", "title": "t", "summary": "s", "conditions": []},
    ],
}

CAPTURE_PACK = {
    "schema_version": "perfcap.pack/v1",
    "pack_id": "event-captures",
    "pack_name": "Event captures",
    "version": "2.0.0",
    "applicability": {"requires_any": ["events.click"]},
    "metric_aliases": {f"events.{t}": [f"\\\\*\\Events(*)\\{t}"] for t in ("click", "error", "purchase", "signup")},
    "recommendations": {"look": {"priority": "high", "text": "Look at <it> | now."}},
    "rules": [
        {"rule_id": "clicks", "severity": "critical", "category": "cpu", "title": "Clicks & more", "summary": "Clicks above 90.",
         "conditions": [{"metric": "events.click", "aggregation": "p95", "operator": "gt", "threshold": 90,
                         "duration_percent": 12.5}], "recommendations": ["look"]},
        {"rule_id": "errors", "severity": "warning", "category": "disk", "title": "Errors", "summary": "Errors below 10.",
         "conditions": [{"metric": "events.error", "aggregation": "min", "operator": "lt", "threshold": 10,
                         "duration_percent": 15}]},
        {"rule_id": "memory", "severity": "warning", "category": "memory", "title": "Memory", "summary": "For the host.",
         "conditions": [{"metric": "events.signup", "aggregation": "avg", "operator": "gt",
                         "threshold": {"host_context": "total_physical_memory_mb", "factor": 0.02}}]},
    ],
}

ALL_PACKS = [EVENT_PACK, LINE_PACK, CALL_PACK, NO_BLOCK_PACK]
