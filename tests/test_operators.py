"""Small inputs with known answers."""

import hashlib
import hmac
from datetime import datetime, timedelta
from itertools import combinations
import random

import pytest
from pyspark.sql import functions as F

from perfcap.functions import aliases, compare as K, names, text
from perfcap.operators import alerts as A, crossrun as X, packs as P, retention as T, rolling, rules as R, schedules as G, skew, stats as S
from perfcap.plans import event_rules, queries_sources
from perfcap.sources.packs import RuleBook

T0 = datetime(2026, 4, 23, 8)
SAMPLE = "dataset_id string, series_id string, metric string, instance string, ts timestamp, value double"


def series(spark, values, step=15, metric="m"):
    rows = [("d", "ser_001", metric, None, T0 + timedelta(seconds=step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SAMPLE)


def one(column, spark):
    return spark.range(1).select(column.alias("x")).first().x


def test_statistics(spark):
    cpu = [85.2, 88.7, 91.3, 90.5]
    r = S.series_stats(series(spark, [float(v) for v in range(10, 101, 10)])).first()
    assert (r["count"], r.min, r.max, r.avg, r.median, r.p90) == (10, 10, 100, 55, 55, pytest.approx(91))
    r = S.series_stats(series(spark, [10.0, None, 30.0])).first()
    assert (r["count"], r.missing_sample_count, r.avg) == (3, 1, 20)
    r = S.series_stats(series(spark, [None, None])).first()
    assert (r.missing_sample_count, r.avg, r.p99, r.trend_per_hour) == (2, 0, 0, 0)
    r = S.series_stats(series(spark, cpu)).first()
    n = len(cpu)
    xs = [i * 15 / 3600 for i in range(n)]
    slope = (n * sum(x * y for x, y in zip(xs, cpu)) - sum(xs) * sum(cpu)) / (n * sum(x * x for x in xs) - sum(xs) ** 2)
    assert r.trend_per_hour == pytest.approx(slope, rel=1e-9)


def test_nan_is_the_smallest_value(spark):
    r = S.series_stats(series(spark, [3.0, float("nan"), 1.0, 2.0, 5.0])).first()
    assert r.min != r.min and r.avg != r.avg and (r.max, r.median) == (5, 2)
    r = S.series_moments(series(spark, [3.0, float("nan"), -0.0, float("inf")])).first()
    assert r.min != r.min and r.max == float("inf") and r["count"] == 4 and "median" not in r.asDict()


def test_hot_quantiles_match_sorting(spark):
    random.seed(3)
    values = [random.choice([0.0, -1.5, 3.25, random.gauss(0, 50), random.random() * 1e-7, -random.random() * 1e9]) for _ in range(3000)]
    got = skew.bucket_quantiles(series(spark, values), ["series_id"], "value", [0.0, 0.5, 0.9, 0.99, 1.0]).first().quantiles
    ordered = sorted(values)
    for p, q in zip([0.0, 0.5, 0.9, 0.99, 1.0], got):
        at = p * (len(ordered) - 1)
        low = int(at)
        high = min(low + 1, len(ordered) - 1)
        assert q == pytest.approx(ordered[low] + (at - low) * (ordered[high] - ordered[low]), rel=1e-12)


def test_value_counts_are_shuffled_once(spark):
    found = skew.bucket_quantiles(series(spark, [3.0, 1.0, None, 1.0, 8.0]), ["dataset_id", "series_id"], "value", [0.0, 0.5, 1.0])
    assert found.collect()[0].quantiles == [1, 2, 8]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


SPEC = "spec_id string, metric string, instance string, duration_s long, step_s long, min_samples long, aggregation string"


def windows(spark, values, duration, step, least, aggregation, every=60):
    spec = spark.createDataFrame([("s", "m", None, duration, step, least, aggregation)], SPEC)
    return [r.value for r in rolling.rolling_windows(series(spark, values, every), spec).orderBy("k").collect()]


def test_rolling_windows(spark):
    assert windows(spark, [10.0, 20.0, 30.0, 40.0, 50.0], 180, 60, 1, "avg") == [20, 30, 40, 45, 50]
    spike = [99.0 if i in (29, 30) else 15.0 for i in range(61)]
    assert max(windows(spark, spike, 300, None, 2, "p95")) > 90
    assert windows(spark, [5.0], 60, 60, 2, "max") == []
    nan = float("nan")
    assert windows(spark, [0.0, nan, 20.0], 60, 60, 1, "max")[0] == 0 and windows(spark, [0.0, nan, 20.0], 180, 180, 1, "max") == [20]
    # A step longer than the window leaves samples between windows out.
    assert windows(spark, [1.0, 2.0, 3.0, 4.0, 5.0], 60, 120, 1, "max") == [1, 3, 5]


@pytest.mark.parametrize("duration,step", [(300, 60), (300, 77), (61, 60), (50, 200), (7200, 100), (90, 90)])
def test_windows_of_panes_equal_plain_windows(spark, duration, step):
    """Panes are cut at the starts and ends of windows only; every window has the samples it covers."""
    rnd = random.Random(duration + step)
    at = sorted(rnd.sample(range(4000), 300)) * 1
    points = [(t, None if rnd.random() < 0.1 else rnd.choice([1.5, 2.0, 7.25, rnd.random()])) for t in at]
    rows = [("d", "s", "m", "i", datetime(2024, 1, 1) + timedelta(seconds=t), v) for t, v in points]
    samples = spark.createDataFrame(rows, "dataset_id string, series_id string, metric string, instance string, ts timestamp, value double")
    specs = spark.createDataFrame([(a, "M", "*", duration, step, 2, a) for a in ("avg", "min", "max", "p90")], SPEC)
    got = {(r.spec_id, r.k): (r.n, r.value) for r in rolling.rolling_windows(samples, specs).collect()}
    valid = [(t, v) for t, v in points if v is not None]
    first, want = valid[0][0], {}
    for k in range((valid[-1][0] - first) // step + 1):
        own = sorted(v for t, v in valid if first + k * step <= t < first + k * step + duration)
        if len(own) < 2:
            continue
        place = 0.9 * (len(own) - 1)
        p90 = own[int(place)] + (place - int(place)) * (own[min(int(place) + 1, len(own) - 1)] - own[int(place)])
        for name, value in (("avg", sum(own) / len(own)), ("min", own[0]), ("max", own[-1]), ("p90", p90)):
            want[name, k] = (len(own), pytest.approx(value, rel=1e-12))
    assert got == want
    most = rolling.panes(samples, specs).where("spec_id = 'avg'").count()
    assert most <= 2 * ((valid[-1][0] - first) // step + 1)


@pytest.mark.parametrize("slice_", [1, 7, 65536])
def test_windows_of_slices_equal_plain_windows(spark, monkeypatch, slice_):
    """Whatever the length of a slice; repeated, infinite and missing values and a series of its own step included."""
    monkeypatch.setattr(rolling, "SLICE", slice_)
    rnd = random.Random(slice_)
    nan, inf = float("nan"), float("inf")
    start, points = datetime(2024, 1, 1), {}
    for name, odd in (("a", [nan, None]), ("b", [inf, 3.0]), ("c", [nan, nan, nan])):
        points[name] = [(t, rnd.choice([2.0, 2.0, rnd.random(), rnd.choice(odd)])) for t in sorted(rnd.choices(range(3000), k=400))]
    rows = [("d", s, "m", "i", start + timedelta(seconds=t), v) for s, own in points.items() for t, v in own]
    specs = spark.createDataFrame([(f"{a}{step}", "m", None, 500, step, 3, a) for a in ("avg", "min", "max", "p90", "p99") for step in (None, 70)], SPEC)
    samples = spark.createDataFrame(rows, "dataset_id string, series_id string, metric string, instance string, ts timestamp, value double")
    got = {(r.series_id, r.spec_id, r.k): (r.n, r.value) for r in rolling.rolling_windows(samples, specs).collect()}
    want = {}
    for s, own in points.items():
        valid = [(t, v) for t, v in own if v is not None]
        first, last = valid[0][0], valid[-1][0]
        for spec in (None, 70):
            ticks = spec * 10**7 if spec else int(max(1.0, (last - first) / (len(valid) - 1)) * 1e7)
            for k in range((last - first) * 10**7 // ticks + 1):
                at = first * 10**7 + k * ticks
                inside = sorted((v for t, v in valid if at <= t * 10**7 < at + 500 * 10**7), key=lambda v: (v == v, v))
                if len(inside) < 3:
                    continue
                numbers = [v for v in inside if v == v]
                found = {"avg": sum(inside) / len(inside), "min": inside[0], "max": numbers[-1] if numbers else nan}
                for p, share in (("p90", 0.9), ("p99", 0.99)):
                    place = share * (len(inside) - 1)
                    low, high = inside[int(place)], inside[min(int(place) + 1, len(inside) - 1)]
                    found[p] = low + (place - int(place)) * (high - low)
                want |= {(s, f"{a}{spec}", k): (len(inside), pytest.approx(v, rel=1e-9, nan_ok=True)) for a, v in found.items()}
    assert got == want


def test_windows_that_overlap_are_no_rows_to_shuffle(spark):
    """Windows are spread out last of all; 4,000 samples in windows of 3,000 steps went to 7.5 million rows for each spec."""
    specs = spark.createDataFrame([(a, "m", None, 3000, 1, 1, a) for a in ("avg", "p95")], SPEC)
    found = rolling.rolling_windows(series(spark, [float(i * 37 % 1000) for i in range(4000)], 1), specs)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = plan[:next(i for i, line in enumerate(plan) if "Generate explode(sequence" in line)]
    assert not any(x in line for line in above for x in ("Aggregate", "Join", "Sort", "RepartitionBy"))
    assert found.where("k >= 1000 and n <> 4000 - k or k < 1000 and n <> 3000").count() == 0 and found.count() == 8000


def test_compare_nan(spark):
    nan = F.lit(float("nan"))
    assert [one(K.compare(nan, F.lit(op), F.lit(1.0)), spark) for op in ("gt", "ge", "lt", "le", "eq")] == [False] * 5
    assert one(K.compare(F.lit(None).cast("double"), F.lit("lt"), F.lit(1.0)), spark) is False
    assert one(K.compare(F.lit(2.0), F.lit("eq"), F.lit(2.0)), spark) is True


def test_share_of_samples_decides(spark):
    """The aggregate is only reported: two of ten samples above the limit fire although the average is below."""
    pack = {"pack_id": "p", "pack_name": "P", "rules": [
        {"rule_id": "r", "severity": "critical", "category": "disk", "title": "t", "summary": "s",
         "conditions": [{"metric": "M", "aggregation": "avg", "operator": "gt", "threshold": 0.05, "duration_percent": 10}]}]}
    values = [0.04] * 8 + [0.06, 0.07]
    df = series(spark, values)
    book = RuleBook.of(spark, [pack])
    s = df.select("dataset_id", "series_id", F.lit(1).alias("series_ord"), "metric", "instance").distinct()
    d = df.groupBy("dataset_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    hosts = d.select("dataset_id", F.lit(None).cast("double").alias("total_physical_memory_mb"),
                     F.lit(None).cast("int").alias("logical_processor_count"))
    findings, _ = R.evaluate_rules(df, s, S.series_stats(df), d, hosts, book)
    f = findings.first()
    assert f.evidence[0].trigger_details[0].actual_value == pytest.approx(0.045) and f.rule_id == "r"


def test_ids(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    got = one(names.finding_id(F.lit("high-cpu-sustained"), F.lit("processor.percent_processor_time"),
                               at("2026-04-23 08:00:00"), at("2026-04-23 08:04:45")), spark)
    assert got == "fd_nizsh4fdsffjmruw"


@pytest.mark.parametrize("value,expected", [
    (80.0, "80"), (0.05, "0.05"), (1e16, "1E+16"), (1e-5, "1E-05"), (12345678.9, "12345678.9"), (-0.0, "0"),
    (1.5e-7, "1.5E-07"), (0.0001, "0.0001"), (-409.6, "-409.6"), (1e15, "1E+15"), (123456789012345.0, "123456789012345")])
def test_number_text(spark, value, expected):
    assert one(text.general(F.lit(value)), spark) == expected


def test_paths(spark):
    cases = {
        r"\\H\MSExchange Database ==> Instances(_Total)\I/O Database Reads (Attached) Average Latency": "_Total",
        r"\\HOST\SomeObject\Counter Name (ms)": None, r"\\H\Processor(_Total)\% Processor Time": "_Total"}
    for path, expected in cases.items():
        assert one(names.instance_of(F.lit(path)), spark) == expected
    assert one(names.unknown_metric(F.lit(r'"\\H\Some Object(a)\X/sec"')), spark) == "unknown.h_some_object_a__x_sec"
    assert one(names.machine_of(F.lit(r"\Memory\Available MBytes")), spark) is None


def test_alias_names(spark):
    from perfcap.operators.normalize import resolve_metrics
    expected = {
        r"\\H\Processor(_Total)\% Processor Time": "processor.percent_processor_time",
        r"\\H\process(a)\working set peak": "process.working_set",
        r"\\H\MSSQL$X:Buffer Manager\Free pages": "sql.buffer_free_pages",
        r"\\H\.NET CLR Memory(x)\% Time in GC": "dotnetclr.percent_time_in_gc",
        r"\\H\CRM Async Service(a)\Exchange Sync: Tasks Failed": "dynamicscrm.async_service.exchange_sync_tasks_failed",
        r"\\H\LS:SIP - Peers(x)\SIP - Sends Timed-Out/sec": "sfb.sip_peers.sends_timed_out_per_sec",
        r"\\H\LS:A/V Edge - UDP Counters(x)\A/V Edge - Packets Dropped/sec": "sfb.a_v_edge_udp_counters.a_v_edge_packets_dropped_per_sec",
        r"\\H\CRM Async Service(a)\Total Operations Failed Rate": "dynamicscrm.async_service.total_operations_failed",
        r"\\H\CRM Async Service(a)\New Jobs Failed": "unknown.h_crm_async_service_a__new_jobs_failed",
        r"\\H\LS:SIP - Peers(x)\SIP - Other": "unknown.h_ls_sip___peers_x__sip___other",
        r"\Memory\Available MBytes": "unknown.memory_available_mbytes"}
    got = {r.counter_path: r.metric for r in resolve_metrics(spark.createDataFrame([(p,) for p in expected], "counter_path string")).collect()}
    assert got == expected


RUN = "workspace_id string, run_id string, status string, created_at timestamp, completed_at timestamp"
FINDING = "workspace_id string, run_id string, finding_ord long, rule_id string, metric string, severity string, category string, title string, summary string, finding_id string"


def history(spark, *runs):
    """Runs in order; each is {key: severity}."""
    start = datetime(2026, 1, 1)
    r = [("w", f"r{i}", "completed", start + timedelta(days=i), start + timedelta(days=i)) for i in range(len(runs))]
    f = [("w", f"r{i}", j, k, "m", s, "cpu", k, k, f"f{i}{j}") for i, run in enumerate(runs) for j, (k, s) in enumerate(run.items())]
    return spark.createDataFrame(r, RUN), spark.createDataFrame(f, FINDING)


@pytest.mark.parametrize("points,expected", [
    (["warning"], "stable"), (["warning", "critical"], "worsening"), (["critical", "warning"], "de-escalating"),
    ([None, "warning"], "appearing"), (["warning", None], "resolving"), ([None, "warning", None], "intermittent"),
    (["warning", "critical", "warning"], "intermittent"), (["info", "informational"], "intermittent")])
def test_direction(spark, points, expected):
    r, f = history(spark, *[{"a": p, "z": "warning"} if p else {"z": "warning"} for p in points])
    rows = {t.correlation_key: t.direction for t in X.trends(r, f).collect()}
    assert rows["a:m"] == expected


def best_pairs(rows, n=20):
    """Every pair of keys, formed and sorted."""
    rows = [(X.fixed.DIRECTION_ORDER.index(x.direction), x.correlation_key, x.direction, {p.run_ord for p in x.points}) for x in rows]
    every = []
    for a, b in combinations(sorted(x for x in rows if len(x[3]) >= 2), 2):
        together = len(a[3] & b[3])
        if together >= 2:
            worse = a[2] == b[2] == "worsening"
            every.append((not worse, a[2] != b[2], -together, a[1], b[1]))
    return [(e[3], e[4], -e[2]) for e in sorted(every)[:n]]


def many_signatures(kind):
    if kind == "few runs":
        severities, keys, n = ["warning", "critical", "informational", None, None], [f"k{i:02d}" for i in range(60)], 4
    else:
        severities, keys, n = ["warning", "critical"] + [None] * (2 if kind == "dense" else 18), [f"k{i:03d}" for i in range(260)], 100
    runs = [{k: s for k in keys if (s := random.choice(severities))} for _ in range(n)]
    for i, run in enumerate(runs):
        if kind == "few runs":
            run.update({f"s{i:02d}": "warning" for i in range(30)})
        elif kind == "directions only":  # one key of each direction: no pair within a direction
            run.clear()
            run.update({k: s for k, s in {"stable": "warning", "falling": "critical" if i < 50 else "warning",
                                          "coming": "warning" if i > 40 else None, "going": "warning" if i < 70 else None,
                                          "now and then": "warning" if 30 < i < 60 else None}.items() if s})
    return runs


@pytest.mark.parametrize("kind", ["few runs", "dense", "sparse", "directions only"])
def test_pairs_match_brute_force(spark, kind):
    """Many keys share signatures, or nearly every key has its own: the first pairs equal those of forming every pair."""
    random.seed(5)
    r, f = history(spark, *many_signatures(kind))
    t = X.trends_of(X.presence(r, f, 100), with_points=True)
    t = spark.createDataFrame(t.collect(), t.schema)
    rows = t.collect()
    assert all(bin(x.low & (2**64 - 1)).count("1") + bin(x.high).count("1") == x.run_count for x in rows)
    for n in (20, 3):
        got = [(p.key_a, p.key_b, p.co_run_count) for p in X.correlations(t, n).orderBy("pair_ord").collect()]
        assert got == best_pairs(rows, n)
    assert X.correlations(t.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["few runs", "sparse"])
def test_pairs_of_parts_match_brute_force(spark, monkeypatch, kind):
    """Long lists are dealt in parts, a bound of few seeds lets most signatures through."""
    monkeypatch.setattr(X, "TILE", 7)
    monkeypatch.setattr(X, "SEEDS", 3)
    monkeypatch.setattr(X, "SEEDS_OF_ALL", 2)
    random.seed(6)
    t = X.trends_of(X.presence(*history(spark, *many_signatures(kind)), 100), with_points=True)
    t = spark.createDataFrame(t.collect(), t.schema)
    assert [(p.key_a, p.key_b, p.co_run_count) for p in X.correlations(t).orderBy("pair_ord").collect()] == best_pairs(t.collect(), 20)


def test_only_the_best_pairs_of_a_list_leave_it(spark):
    """A list of 1,500 signatures of equal overlaps has a million pairs; 20 go on, the first by name."""
    rows = [("w", "intermittent", 0, 2, 100, "intermittent", 2, f"k{i:04d}", -1 - (1 << i % 60), 3) for i in range(1500)]
    lists = spark.createDataFrame(rows, "workspace_id string, among string, list int, t long, total_runs long, direction string, pos int, first string, low long, high long")
    got = sorted((p.first_a, p.first_b, p.together) for p in X._listed_pairs(lists, 20).collect())
    same = [(f"k{i:04d}", f"k{j:04d}", 65) for i in range(2) for j in range(i + 60, 1500, 60)]
    assert got == same[:20]


def test_policy_needs_three_of_five(spark):
    w = {"a": "warning"}
    r, f = history(spark, w, {}, w, {}, w, {}, {}, w)
    assert [(e.run_id, e.total_hits) for e in A.escalations(r, f).collect()] == [("r4", 3)]
    r, f = history(spark, w, {}, {}, w)
    assert A.escalations(r, f).count() == 0


def test_compare(spark):
    r, f = history(spark, {"a": "warning", "b": "warning", "c": "critical"}, {"a": "warning", "B": "critical", "d": "warning"})
    pairs = spark.createDataFrame([("r0", "r1")], "baseline_run_id string, candidate_run_id string")
    got = [(d.status, d.correlation_key) for d in X.compare_runs(pairs, f).orderBy("diff_ord").collect()]
    assert got == [("new", "d:m"), ("severity_changed", "b:m"), ("resolved", "c:m"), ("unchanged", "a:m")]


def test_retention_off_and_shared_uploads(spark):
    now = datetime(2026, 6, 1)
    rows = [(1, 10, "completed", datetime(2026, 1, 1), False), (2, 10, "completed", datetime(2026, 5, 31), False),
            (3, 11, "failed", datetime(2026, 1, 2), False), (4, 12, "completed", datetime(2026, 1, 3), True)]
    runs = spark.createDataFrame(rows, "run_id long, upload_id long, status string, completed_at timestamp, is_baseline boolean")
    uploads = runs.select("upload_id").distinct()
    compares = spark.createDataFrame([("c1", 1, 2), ("c2", 2, 4)], "compare_id string, baseline_run_id long, candidate_run_id long")
    plan = T.purge_plan(runs, uploads, compares, now, 30)
    assert sorted(r.run_id for r in plan["runs"].collect()) == [1, 3]
    assert [r.compare_id for r in plan["compares"].collect()] == ["c1"]
    assert [r.upload_id for r in plan["uploads"].collect()] == [11]
    assert plan["audit"].first().jobs_deleted == 2
    off = T.purge_plan(runs, uploads, compares, now, 0)
    assert off["runs"].count() == 0 and off["audit"].count() == 0


def test_pack_validation(spark):
    clean = {**event_rules.EVENT_PACK, "rules": [r for r in event_rules.EVENT_PACK["rules"] if r["rule_id"] != "critical-error-value"]}
    book = RuleBook.of(spark, [clean, event_rules.BROKEN_PACK])
    found = P.validate_packs(book.packs, book.rules, book.conditions, book.recommendations)
    assert {r.pack_id for r in found.collect()} == {"Broken_Pack"}
    assert [r.pack_id for r in P.valid_packs(book.packs, found).collect()] == ["event-core"]


def test_pack_catalog(spark, tmp_path):
    """Packs of rules and of parts, each with the samples of events and of line items that its conditions name."""
    tables = {
        "part": ([(k, f"name {k}", 7, "Brand#1", "T") for k in (1, 2, 3)], "p_partkey long, p_name string, p_size int, p_brand string, p_type string"),
        "events": ([(i, i, t, 1.0, T0) for i, t in enumerate(["error", "error", "view", None])], "event_id long, user_id long, event_type string, value double, ts timestamp"),
        "lineitem": ([("A", "F", 1, T0, 1.0, 2.0, 0.1, 0.2)] * 2,
                     "l_returnflag string, l_linestatus string, l_linenumber int, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.pack_id: r for r in queries_sources.QUERIES["s10_pack_catalog"](spark, str(tmp_path)).collect()}
    seen = {"events.error": 2, "events.view": 1, **{f"lineitem.{m}": 2 for m in ("quantity", "extendedprice", "discount", "tax")}}
    packs = {p["pack_id"]: p.get("rules", []) for p in event_rules.ALL_PACKS}
    assert set(got) == {*packs, "pack-1", "pack-2", "pack-3"}
    for name, rules in packs.items():
        metrics = {c["metric"].lower() for r in rules for c in r["conditions"]}
        assert (got[name].rule_count, got[name].samples) == (len(rules), sum(seen.get(m, 0) for m in metrics))
    assert sum(r.samples > 0 for r in got.values()) > 1
    assert [(got[f"pack-{k}"].rule_count, got[f"pack-{k}"].samples, got[f"pack-{k}"].path) for k in (1, 2, 3)] == [(k, 0, f"/packs/{k}") for k in (1, 2, 3)]
    few, many = spark.createDataFrame([("p", "M"), ("p", "m"), ("p", None)], "pack_id string, metric string"), spark.createDataFrame([("m",), ("m",), (None,)], "metric string")
    assert [tuple(r) for r in P.named_samples(few, many).collect()] == [("p", 2)]


def test_schedule_messages(spark):
    good = '{"type":"directory","path":"/c","glob":"*.csv"}'
    rows = [("ok", "n", 5, good, ["a"]), ("name", " ", 5, good, ["a"]), ("interval", "n", 4, good, ["a"]),
            ("packs", "n", 5, good, ["a", "A "]), ("json", "n", 5, "x", ["a"]), ("type", "n", 5, '{"path":"/c"}', ["a"])]
    df = spark.createDataFrame(rows, "schedule_id string, name string, interval_minutes int, source_config_json string, pack_ids array<string>")
    got = {r.schedule_id: r.message for r in G.validate_schedules(df).collect()}
    assert set(got) == {"name", "interval", "packs", "json", "type"}
    assert got["type"].startswith("unsupported source type '(missing)'")


def test_signatures(spark):
    """The digest of the standard library, for short, long and non-ASCII secrets; none without a secret."""
    secrets = ["k", "é" * 20, "x" * 64, "y" * 65, "long secret " * 20, "", None]
    sinks = spark.createDataFrame([("w", f"s{i}", "n", k, "alert.created, ,alert.resolved", True) for i, k in enumerate(secrets)],
                                  "workspace_id string, sink_id string, name string, secret string, events string, enabled boolean")
    row = ("w", "r", 1, T0, "alert.created", "critical", "cpu", "Tïtle", "run")
    events = spark.createDataFrame([row], "workspace_id string, rule_id string, segment long, at timestamp, event string, alert_severity string, "
                                          "category string, title string, run_id string")
    got = {r.sink_id: r for r in A.notification_outbox(events, sinks).collect()}
    assert len(got) == len(secrets)
    for i, secret in enumerate(secrets):
        r = got[f"s{i}"]
        assert r.signature == ("sha256=" + hmac.new(secret.encode(), r.payload.encode(), hashlib.sha256).hexdigest() if secret else None)
