"""Fixed values of the pack format and of the run history.

These strings and numbers are part of the data format or of the defined results;
they are not tunables.
"""

# --- pack format ---------------------------------------------------------------
SEVERITIES = ["critical", "warning", "informational"]
CATEGORIES = [
    "cpu", "memory", "disk", "network", "process", "iis", "sql", "dotnet", "ad", "print",
    "hyperv", "sharepoint", "exchange", "citrix", "dynamics", "sfb", "system", "collection",
    "pack-validation",
]
AGGREGATIONS = ["avg", "min", "max", "p90", "p95", "p99", "trend"]
WINDOW_AGGREGATIONS = ["avg", "min", "max", "p90", "p95", "p99"]
OPERATORS = ["gt", "lt", "ge", "le", "eq"]
HOST_VARIABLES = ["total_physical_memory_mb", "logical_processor_count"]
PRIORITIES = ["high", "medium", "low"]
# "<vendor>.pack/v1" and "<vendor>.pack/v1.1"; the vendor prefix is not checked.
SCHEMA_VERSION_PATTERN = r"^[a-z][a-z0-9]*\.pack/v1(\.1)?$"
WINDOW_SCHEMA_PATTERN = r"^[a-z][a-z0-9]*\.pack/v1\.1$"
DEFAULT_VERSION = "0.0.0"
DEFAULT_DURATION_PERCENT = 1.0
DEFAULT_MIN_SAMPLES = 2
DEFAULT_PRIORITY = "medium"
DEFAULT_PACK = "windows-core"

# --- statistics ----------------------------------------------------------------
PERCENTILES = [0.5, 0.9, 0.95, 0.99]
DEFAULT_STEP_SECONDS = 60

# --- run history ---------------------------------------------------------------
DIRECTION_ORDER = ["worsening", "appearing", "stable", "intermittent", "de-escalating", "resolving"]
DIFF_ORDER = ["new", "severity_changed", "resolved", "unchanged"]
BASELINE_TYPES = ["machine", "role", "workload", "release"]
TREND_DEFAULT_RUNS = 10
TREND_MAX_RUNS = 100
MAX_PAIRS = 20
FINDING_INSIGHTS = 5
TREND_INSIGHTS = 3
PAIR_INSIGHTS = 3
PAGE_DEFAULT = 100
PAGE_MAX = 500

# --- alerts, schedules, retention ----------------------------------------------
POLICY_WINDOW = 5
POLICY_HITS = 3
POLICY_ID = "warning-3of5-critical"
SNOOZE_SKEW_SECONDS = 30
SNOOZE_MAX_DAYS = 30
PURGE_BATCH = 1000
FILES_PER_TICK = 10
FILE_STABLE_SECONDS = 30
CURSOR_BUFFER_SECONDS = 120

# Lower-case RFC 4648 base32 alphabet.
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
