"""Views that turn the driver tables into captures, run history, uploads and schedules.

The driver tables hold no counter captures.  Each view is a deterministic projection of a whole table
(no row is left out), so every operator can be checked on it against SQL.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without zone are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def samples_ev(spark, sf_dir) -> DataFrame:
    """events as counter samples: one dataset per workspace and day, twenty series each."""
    e = table(spark, sf_dir, "events")
    type_index = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    workspace = F.concat(F.lit("ws"), (F.col("user_id") % 3).cast("string"))
    instance = F.concat(F.lit("i"), (F.col("user_id") % 4).cast("string"))
    ordinal = (type_index * 4 + F.col("user_id") % 4 + 1).cast("int")
    return e.select(
        workspace.alias("workspace_id"),
        F.concat(F.lit("ds_"), workspace, F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("dataset_id"),
        F.format_string("ser_%03d", ordinal).alias("series_id"),
        ordinal.alias("series_ord"),
        F.concat(F.lit("events."), F.col("event_type")).alias("metric"),
        instance.alias("instance"),
        "ts",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
        F.col("event_id").alias("ord"))


def series_of(samples: DataFrame) -> DataFrame:
    return samples.select("dataset_id", "series_id", "series_ord", "metric", "instance").distinct()


def samples_li(spark, sf_dir) -> DataFrame:
    """lineitem unpivoted: four measures per line, one dataset per flag and status."""
    wide = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("dataset_id"),
        F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("instance"),
        F.col("l_shipdate").alias("ts"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = wide.unpivot(["dataset_id", "instance", "ts"],
                        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure", "value")
    return long.select(
        "dataset_id", F.concat_ws("/", "measure", "instance").alias("series_id"),
        F.concat(F.lit("lineitem."), F.substring("measure", 3, 20)).alias("metric"), "instance", "ts", "value")


def hosts_ev(samples: DataFrame) -> DataFrame:
    """Memory and CPU count per dataset; unknown on some days and in one workspace."""
    day = F.substring("dataset_id", -2, 2).cast("int")
    return samples.select("dataset_id", "workspace_id").distinct().select(
        "dataset_id",
        F.when(day % 5 != 0, (1000.0 * (1 + day % 4))).alias("total_physical_memory_mb"),
        F.when(F.col("workspace_id") != "ws1", 4 + day % 4).cast("int").alias("logical_processor_count"))


def capture_lines(spark, sf_dir) -> DataFrame:
    """events as quoted text lines with mixed timestamp formats, blanks, garbage and commas."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 8
    stamp = (
        F.when(kind == 0, F.date_format("ts", "MM/dd/yyyy HH:mm:ss.SSS"))
        .when(kind == 1, F.date_format("ts", "M/d/yyyy h:mm:ss.SSS a"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 4, F.date_format("ts", "M/d/yyyy H:mm:ss"))
        .when(kind == 5, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 6, F.lit("not a time"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    number = (
        F.when(F.col("event_id") % 7 == 0, "")
        .when(F.col("event_id") % 7 == 1, "n/a")
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("1,"), F.lpad(cents, 5, "0")))
        .when(F.col("event_id") % 7 == 3, "1d")
        .when(F.col("event_id") % 7 == 4, F.concat(F.lit("-"), cents))
        .otherwise(cents))
    return e.select("event_id", F.concat(F.lit('"'), stamp, F.lit('","'), number, F.lit('",x '), F.col("event_type"))
                    .alias("line"))


OBJECTS = [
    (r"Processor(_Total)\% Processor Time"), (r"Processor(0)\% Processor Time Peak"), (r"Memory\Available MBytes"),
    (r"PhysicalDisk(0 C:)\Avg. Disk sec/Read"), (r"Database ==> Instances(store (a))\Reads (Attached) Latency"),
    (r"Custom Object\Counter Name (ms)"), (r"System\Processor Queue Length"),
]


def counter_paths(spark, sf_dir) -> DataFrame:
    """A counter path per line item: server from the supplier, object from the line number."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    name = F.get(F.array(*[F.lit(o) for o in OBJECTS]), F.col("l_linenumber") % len(OBJECTS))
    server = F.concat(F.lit("SRV"), F.substring_index("s_name", "#", -1).cast("int").cast("string"))
    path = F.when(F.col("l_linenumber") == 6, F.concat(F.lit("\\"), name)).otherwise(
        F.concat(F.lit("\\\\"), server, F.lit("\\"), name))
    return li.join(sup, li.l_suppkey == sup.s_suppkey).select(path.alias("counter_path"))


def findings_history(spark, sf_dir) -> DataFrame:
    """One run per workspace and day; the last event of each (type, instance) decides a finding."""
    s = samples_ev(spark, sf_dir)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("value").alias("raw"))
    last = s.join(e, "ord").groupBy("workspace_id", "dataset_id", "series_ord", "metric", "instance").agg(
        F.max_by("raw", "ord").alias("v"), F.date_trunc("day", F.max("ts")).alias("day"))
    severity = F.when(F.col("v") > 85, "critical").when(F.col("v") > 60, "warning").when(
        F.col("v") > 45, "informational")
    kind = F.substring_index("metric", ".", -1)
    return last.where(severity.isNotNull()).select(
        "workspace_id", F.concat(F.lit("run_"), F.substring("dataset_id", 4, 50)).alias("run_id"),
        F.col("series_ord").cast("long").alias("finding_ord"),
        F.concat(F.lit("rule-"), kind, F.lit("-"), F.expr("CAST(series_ord % 2 AS STRING)")).alias("rule_id"),
        F.concat("metric", F.lit("."), F.col("instance")).alias("metric"),
        severity.alias("severity"),
        F.when(F.col("series_ord") <= 8, "cpu").when(F.col("series_ord") <= 14, "memory").otherwise("disk")
        .alias("category"),
        F.concat(F.lit("High "), kind).alias("title"),
        F.concat(F.lit("Last "), kind, F.lit(" above limit.")).alias("summary"),
        F.concat(F.lit("fd_"), F.substring("dataset_id", 4, 50), F.lit("_"), F.col("series_ord").cast("string"))
        .alias("finding_id"),
        "day")


def runs_history(spark, sf_dir) -> DataFrame:
    """Runs of the history: completed at the end of the day, every thirteenth day failed."""
    s = samples_ev(spark, sf_dir)
    days = s.select("workspace_id", "dataset_id", F.date_trunc("day", "ts").alias("day")).distinct()
    dom = F.dayofmonth("day")
    return days.select(
        "workspace_id", F.concat(F.lit("run_"), F.substring("dataset_id", 4, 50)).alias("run_id"),
        F.when(dom % 13 == 0, "failed").otherwise("completed").alias("status"),
        F.col("day").alias("created_at"),
        F.when(dom % 13 != 0, F.col("day") + F.expr("INTERVAL 1 DAY")).alias("completed_at"),
        (dom % 7 == 1).alias("is_baseline"),
        F.when(dom % 7 == 1, F.when(dom % 2 == 0, "machine").otherwise("release")).alias("baseline_type"),
        F.when(dom % 7 == 1, F.when(dom % 3 == 0, '{"env": "prod",  "n": 1}').otherwise('{ "env":"prod","n":1 }'))
        .alias("baseline_context"),
        F.when(dom % 7 != 1, F.concat(F.lit("run_"), F.col("workspace_id"), F.lit("_"),
                                      F.date_format(F.expr("day - make_dt_interval((dayofmonth(day) - 1) % 7)"),
                                                    "yyyyMMdd"))).alias("selected_baseline_id"))


def order_months(spark, sf_dir) -> DataFrame:
    """Months of orders as completed runs of three workspaces (customers by number)."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ws"), (F.col("o_custkey") % 3).cast("string")).alias("workspace_id"),
        F.date_trunc("month", "o_orderdate").alias("created_at")).distinct()
    run = F.concat_ws("_", "workspace_id", F.date_format("created_at", "yyyy-MM"))
    return o.select("workspace_id", run.alias("run_id"), F.lit("completed").alias("status"), "created_at",
                    F.col("created_at").alias("completed_at"))


def order_findings(spark, sf_dir) -> DataFrame:
    """A finding per order, of its customer, in its month."""
    o = table(spark, sf_dir, "orders")
    urgent = F.substring("o_orderpriority", 1, 1)
    workspace = F.concat(F.lit("ws"), (F.col("o_custkey") % 3).cast("string"))
    return o.select(
        workspace.alias("workspace_id"), F.concat_ws("_", workspace, F.date_format("o_orderdate", "yyyy-MM")).alias("run_id"),
        F.col("o_orderkey").alias("finding_ord"),
        F.lit("orders").alias("rule_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("metric"),
        F.when(urgent == "1", "critical").when(urgent == "2", "warning").otherwise("informational").alias("severity"))


def alert_commands(spark, sf_dir) -> DataFrame:
    """Commands against the alerts of the history, at noon of the days whose number fits."""
    f = findings_history(spark, sf_dir).select("workspace_id", "rule_id").distinct()
    days = runs_history(spark, sf_dir).select("workspace_id", F.col("created_at").alias("day"))
    salt = F.length("rule_id") + F.dayofmonth("day")
    action = (
        F.when(salt % 5 == 0, "acknowledge").when(salt % 7 == 0, "resolve").when(salt % 11 == 0, "snooze")
        .when(salt % 9 == 0, "unsnooze"))
    until = F.when(F.dayofmonth("day") % 2 == 0, F.col("day") + F.expr("INTERVAL 3 DAY")).otherwise(
        F.col("day") + F.expr("INTERVAL 45 DAY"))
    return f.join(days, "workspace_id").where(action.isNotNull()).select(
        "workspace_id", "rule_id", (F.col("day") + F.expr("INTERVAL 12 HOUR")).alias("at"), action.alias("action"),
        F.when(action == "snooze", until).alias("until"), F.lit(None).cast("string").alias("note"))


def uploads(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("upload_id"), F.col("source").alias("workspace_id"),
        F.sha2("text", 256).alias("sha256"),
        F.concat(F.lit("cap_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("file_name"),
        (F.lit(1_700_000_000) + F.col("doc_id") % 997).cast("timestamp").alias("created_at"))


def purge_runs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.expr("o_orderkey div 2").alias("upload_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed")
        .otherwise("running").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("completed_at"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 10 == 0).alias("is_baseline"))


def purge_compares(spark, sf_dir) -> DataFrame:
    """Consecutive orders of a customer as compared run pairs."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.lag("o_orderkey").over(w).alias("baseline_run_id"), F.col("o_orderkey").alias("candidate_run_id")) \
        .where(F.col("baseline_run_id").isNotNull()).select(
            F.concat_ws("-", "baseline_run_id", "candidate_run_id").alias("compare_id"),
            "baseline_run_id", "candidate_run_id")


def schedules(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    config = (
        F.when(k % 6 == 0, '{"type":"directory","path":"/captures","glob":"*.csv"}')
        .when(k % 6 == 1, '{"type":"ftp","path":"/captures","glob":"*.csv"}')
        .when(k % 6 == 2, '{"type":"directory","path":"captures/../x","glob":"*.csv"}')
        .when(k % 6 == 3, "[1,2]").when(k % 6 == 4, "{broken")
        .otherwise('{"type":"directory","path":"/captures"}'))
    packs = (
        F.when(k % 4 == 0, F.array(F.lit("windows-core"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit(" A ")))
        .when(k % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit(" "))))
    return s.select(
        F.concat(F.lit("sch"), k.cast("string")).alias("schedule_id"),
        F.concat(F.lit("ws"), (k % 3).cast("string")).alias("workspace_id"),
        F.when(k % 9 == 0, " ").when(k % 10 == 0, F.repeat("s_name", 8)).otherwise(F.col("s_name")).alias("name"),
        (k * 37 % 1600).cast("int").alias("interval_minutes"),
        config.alias("source_config_json"), packs.alias("pack_ids"), (k % 3 != 0).alias("enabled"),
        F.when(k % 4 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + k * 60)).alias("next_run_at"),
        F.lit(None).cast("timestamp").alias("last_run_at"))


def sinks(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("sink"), k.cast("string")).alias("sink_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("ws"), (k % 3).cast("string")).alias("workspace_id"),
        F.when(k % 2 == 0, "alert.created, alert.escalated").when(k % 5 == 0, "alert.resolved")
        .otherwise(" alert.acknowledged ,,alert.created").alias("events"),
        (k % 4 != 0).alias("enabled"), F.when(k % 2 == 0, F.concat(F.lit("key"), k.cast("string"))).alias("secret"))


def event_capture_lines(spark, sf_dir) -> DataFrame:
    """events as wide capture files, one per workspace and day: five counters, one line per event.

    Every fiftieth line has no readable time, every thirtieth is cut short.
    """
    e = table(spark, sf_dir, "events")
    workspace = (F.col("user_id") % 3).cast("string")
    path = F.concat(F.lit("/captures/ws"), workspace, F.lit("/"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv"))
    stamp = F.when(F.col("event_id") % 50 == 0, "bad time").otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm:ss.SSS"))
    text = F.col("value").cast("string")
    cells = [F.concat(F.lit(',"'), F.when(F.col("event_type") == t, text).otherwise(""), F.lit('"')) for t in EVENT_TYPES]
    whole = F.concat(F.lit('"'), stamp, F.lit('"'), *cells)
    line = F.when(F.col("event_id") % 30 == 0, F.concat(F.lit('"'), stamp, F.lit('"'), cells[0])).otherwise(whole)
    number = F.row_number().over(Window.partitionBy("path").orderBy("event_id")).cast("long")  # lines of one file
    rows = e.select(path.alias("path"), "event_id", line.alias("line")).select(
        "path", F.lit(0).cast("long").alias("block"), number.alias("ord"), "line")
    counters = [F.concat(F.lit(',"\\\\WS'), workspace, F.lit(f'\\Events(all)\\{t}"')) for t in EVENT_TYPES]
    heads = e.select(path.alias("path"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("ord"),
                     F.concat(F.lit('"(PDH-CSV 4.0)"'), *counters).alias("line")).distinct()
    return rows.unionByName(heads)


def event_capture_files(spark, sf_dir, folder: str) -> None:
    """The event captures as files: folder/ws=<workspace>/day=<yyyyMMdd>/part-….txt, one file each."""
    lines = event_capture_lines(spark, sf_dir).withColumns({
        "ws": F.regexp_extract("path", r"/ws(\d+)/", 1), "day": F.regexp_extract("path", r"/(\d+)[.]csv$", 1)})
    in_order = lines.repartition("ws", "day").sortWithinPartitions("ws", "day", "ord")  # an order that the writer keeps
    in_order.select(F.col("line").alias("value"), "ws", "day").write.partitionBy("ws", "day").text(folder)


def event_capture_catalog(lines: DataFrame) -> DataFrame:
    """Catalog of the event captures; the digest is that of the path."""
    return lines.select("path").distinct().select("path", F.sha2("path", 256).alias("sha256"), F.lit("csv").alias("source_type"))


def part_packs(spark, sf_dir):
    """(packs, rules, conditions, recommendations): every part as a pack, with faults by remainders of its key."""
    k, i, j = F.col("k"), F.col("i"), F.col("j")
    either = lambda test, bad, good: F.when(test, bad).otherwise(good)
    one = lambda test, c: F.when(test, F.array(c)).otherwise(F.array().cast("array<string>"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size", "p_brand", "p_type")
    text = k.cast("string")
    p = p.withColumn("pack_id", F.concat(either(k % 7 == 0, "Pack_", "pack-"), text))
    packs = p.select(
        "pack_id", either(k % 11 == 0, F.lit(" "), F.col("p_name")).alias("pack_name"),
        either(k % 5 == 0, F.lit("1.0"), F.concat(F.lit("1.0."), F.col("p_size").cast("string"))).alias("version"),
        F.when(k % 13 == 0, "other/v2").when(k % 2 == 0, "perfcap.pack/v1").otherwise("perfcap.pack/v1.1").alias("schema_version"),
        F.col("p_type").alias("description"), (k % 3 != 0).alias("has_applicability"), (k % 3 == 1).alias("always"),
        one((k % 3 == 2) & (k % 4 == 2), F.col("p_brand")).alias("requires_any"),
        one((k % 3 == 2) & (k % 4 == 1), F.col("p_brand")).alias("requires_all"), F.concat(F.lit("/packs/"), text).alias("path"))
    r = p.where(k % 4 > 0).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), k % 4)))
    r = r.withColumns({"rule_id": F.concat(F.lit("rule-"), either(k % 17 == 0, F.lit(1).cast("long"), i).cast("string")), "n_conditions": (k + i) % 3})
    rules = r.select(
        "pack_id", "rule_id", either((k + i) % 9 == 0, "fatal", "warning").alias("severity"),
        either((k + i) % 10 == 0, "none", "cpu").alias("category"), either((k + i) % 19 == 0, " ", "T").alias("title"),
        either((k + i) % 23 == 0, "", "S").alias("summary"), F.col("n_conditions").cast("int").alias("n_conditions"),
        F.concat(F.array(F.lit("look")), one((k + i) % 6 == 0, F.lit("missing"))).alias("recommendation_ids"))
    c = r.where("n_conditions > 0").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_conditions"))))
    windowed = (k + i) % 4 == 0
    conditions = c.select(
        "pack_id", "rule_id", F.concat(F.lit("m"), j.cast("string")).alias("metric"),
        F.when((k + i + j) % 8 == 0, "sum").when((k + i + j) % 8 == 4, "trend").otherwise("avg").alias("aggregation"),
        either((k + j) % 12 == 0, "ne", "gt").alias("operator"), either((k + i + j) % 14 == 0, F.lit(120.0), F.lit(10.0)).alias("duration_percent"),
        F.when((k + j) % 15 == 0, "disk").alias("hc_variable"), F.when(windowed, k % 50 + 10).alias("window_s"),
        F.when(windowed, (k + j) % 60).alias("step_s"), F.when(windowed, k % 3).alias("min_samples"))
    recommendations = p.select("pack_id", F.lit("look").alias("rec_id"), either(k % 21 == 0, "urgent", "high").alias("priority"),
                               either(k % 22 == 0, "", "t").alias("text"))
    return packs, rules, conditions, recommendations
