"""Rolling windows that start at the first valid sample of a series."""

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from perfcap import fixed
from perfcap.functions.compare import greatest, least
from perfcap.operators import skew
from perfcap.operators.stats import SERIES

_TICKS = 10_000_000  # 100 ns, exact for microsecond timestamps and for estimated steps
#: Panes beside those of a whole window that a slice of a series holds, about.
SLICE = 65536


def series_bounds(samples: DataFrame) -> DataFrame:
    """First and last valid timestamp and valid count per series."""
    return samples.where(F.col("value").isNotNull()).groupBy(*SERIES).agg(
        F.min("ts").alias("first_valid_ts"), F.max("ts").alias("last_valid_ts"), F.count("*").alias("valid_count"))


def default_step_seconds(bounds: DataFrame) -> DataFrame:
    """Average spacing of the valid samples, at least one second; a minute for a single sample."""
    span = (F.unix_micros("last_valid_ts") - F.unix_micros("first_valid_ts")) / F.lit(1e6)
    step = F.when(F.col("valid_count") < 2, F.lit(float(fixed.DEFAULT_STEP_SECONDS))).otherwise(
        F.greatest(F.lit(1.0), span / (F.col("valid_count") - 1)))
    return bounds.withColumn("default_step_s", step)


def panes(samples: DataFrame, specs: DataFrame) -> DataFrame:
    """Samples of each series and spec, combined by the windows that cover them.

    A step is cut where windows start and where they end, so all samples between two cuts lie in the same windows, from
    ``k0`` to ``k1``; whatever the number of samples, a step has two panes.  ``ranked`` is null but for percentile specs,
    whose panes keep their values with counts.  ``_length`` is how many steps of a series are worked on at a time.
    """
    s = samples.where(F.col("value").isNotNull())
    spec = F.broadcast(specs.select(
        F.col("spec_id"), F.lower("metric").alias("_m"), F.lower("instance").alias("_i"),
        F.col("duration_s").cast("long").alias("duration_s"), F.col("step_s").cast("long").alias("step_s"),
        "min_samples", "aggregation"))
    match = (F.lower("metric") == F.col("_m")) & (
        F.col("_i").isNull() | (F.col("_i") == "*") | (F.lower("instance") == F.col("_i")))
    used = s.select(*SERIES, "ts", "value", "metric", "instance").join(
        spec.select("_m").distinct(), F.lower("metric") == F.col("_m"), "left_semi")
    bounds = default_step_seconds(series_bounds(used)).select(
        *SERIES, F.unix_micros("first_valid_ts").alias("_first"), F.unix_micros("last_valid_ts").alias("_last"), "valid_count", "default_step_s")
    asked = used.join(spec.select("_m", "_i").distinct(), match, "left_semi")
    placed = skew.salted_join(asked, bounds, SERIES, F.col("ts")).join(spec, match)

    step = F.when(F.col("step_s") > 0, F.col("step_s") * F.lit(_TICKS)).otherwise(
        F.floor(F.col("default_step_s") * F.lit(float(_TICKS))).cast("long"))
    offset = (F.unix_micros("ts") - F.col("_first")) * F.lit(10)
    ranked = F.when(~F.col("aggregation").isin("avg", "min", "max"), F.col("value"))
    placed = placed.select(*SERIES, "spec_id", "aggregation", "min_samples", "duration_s", "_first", "value", ranked.alias("ranked"),
                           step.alias("_step"), offset.alias("_off"), (F.col("duration_s") * F.lit(_TICKS)).alias("_dur"), "_last", "valid_count")
    many = F.when(F.col("aggregation").isin("avg", "min", "max"), F.lit(SLICE)).otherwise(
        F.expr(f"{SLICE} * ((_last - _first) * 10 div _step + 1) div valid_count"))
    placed = placed.withColumn("_length", F.greatest(many, F.expr("_dur div _step + 1"), F.lit(1).cast("long")))
    # Sample in step k1, in or past the part that the window ending in it covers.
    past = (F.expr("_off % _step") >= F.expr("_dur % _step")).cast("long")
    placed = placed.withColumn("k1", F.expr("_off div _step")).withColumn(
        "k0", F.greatest(F.lit(0).cast("long"), F.col("k1") - F.expr("_dur div _step") + past))
    # With a step longer than the window a sample may lie between two windows.
    return placed.where("k0 <= k1").groupBy(*_OF_WINDOW, "k0", "k1", "ranked").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), least(F.col("value")).alias("low"), greatest(F.col("value")).alias("high"))


_OF_WINDOW = [*SERIES, "spec_id", "aggregation", "min_samples", "duration_s", "_first", "_step", "_length"]


def _ranged(combine, rows, lo, hi, none):
    """``combine`` over the rows from ``lo`` to before ``hi``, for many ranges; rows are combined in pairs, level by level."""
    out, lo, hi = np.full(len(lo), none), lo.copy(), hi.copy()
    while (lo < hi).any():
        odd = (lo < hi) & (lo % 2 == 1)
        out[odd] = combine(out[odd], rows[lo[odd]])
        lo += odd
        odd = (lo < hi) & (hi % 2 == 1)
        hi -= odd
        out[odd] = combine(out[odd], rows[hi[odd]])
        lo, hi, even = lo // 2, hi // 2, len(rows) // 2 * 2
        rows = combine(rows[:even:2], rows[1:even:2])
    return out


def _of_rank(number, weight, most: int, lo, hi, place):
    """The number that has ``place`` among the rows from ``lo`` to before ``hi`` in order of number, each counted ``weight`` times.

    A wavelet matrix: one bit of all numbers after the other, the highest first; rows with a 0 go before those with a 1.
    """
    out = np.zeros(len(lo), "int64")
    for bit in reversed(range(most.bit_length())):
        one = (number >> bit) & 1 == 1
        before, weighs = (np.append(0, np.cumsum(c)) for c in (~one, np.where(one, 0, weight)))
        under = weighs[hi] - weighs[lo]
        up = place >= under
        place = np.where(up, place - under, place)
        lo, hi = (np.where(up, before[-1] + x - before[x], before[x]) for x in (lo, hi))
        out |= up.astype("int64") << bit
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        number, weight = number[order], weight[order]
    return out


def _quantile(share: float, values, weight, lo, hi, size):
    """Interpolated quantile of the values from ``lo`` to before ``hi``; NaN is the smallest."""
    distinct, number = np.unique(values, return_inverse=True)
    if len(distinct) and np.isnan(distinct[-1]):
        distinct, number = np.roll(distinct, 1), (number + 1) % len(distinct)
    position = share * (size - 1)
    below = np.floor(position).astype("int64")
    low, high = (distinct[_of_rank(number, weight, len(distinct) - 1, lo, hi, p)] for p in (below, np.minimum(below + 1, size - 1)))
    return low + (position - below) * (high - low)


def _slice_windows(aggregation, least_n, begin, end, k0, k1, ranked, n, total, low, high):
    """(k, to, n, value) of the windows from ``begin`` to before ``end``: runs of windows that hold the same panes.

    Panes in order of time start and end in that order, too, so those of a window follow each other.
    """
    k0, k1 = np.maximum(k0, begin), np.minimum(k1, end - 1)
    order = np.lexsort((k1, k0))
    k0, k1, ranked, n, total, low, high = (c[order] for c in (k0, k1, ranked, n, total, low, high))
    cuts = np.unique(np.concatenate([k0, k1 + 1]))
    k = cuts[:-1]
    lo, hi = np.searchsorted(k1, k), np.searchsorted(k0, k, side="right")
    upto = np.append(0, np.cumsum(n))
    size = upto[hi] - upto[lo]
    on = np.flatnonzero((hi > lo) & (size >= least_n)) if least_n is not None else np.zeros(0, "int64")
    lo, hi, size = lo[on], hi[on], size[on]
    with np.errstate(all="ignore"):
        if aggregation == "avg":
            value = _ranged(np.add, total, lo, hi, 0.0) / size
        elif aggregation == "min":
            value = _ranged(np.minimum, low, lo, hi, np.inf)  # NaN if there is one
        elif aggregation == "max":
            value = _ranged(np.fmax, high, lo, hi, np.nan)  # NaN if there is nothing else
        elif aggregation in ("p90", "p95", "p99"):
            value = _quantile({"p90": 0.9, "p95": 0.95, "p99": 0.99}[aggregation], ranked, n, lo, hi, size)
        else:
            value = None
    return k[on], cuts[1:][on] - 1, size, value


def rolling_windows(samples: DataFrame, specs: DataFrame, percentiles: bool = True, materialize=None) -> DataFrame:
    """Value of every rolling window with enough samples.

    ``specs``: ``spec_id, metric, instance, duration_s, step_s, min_samples, aggregation`` - a handful of
    rows, broadcast.  ``samples`` carry ``metric`` and ``instance``.  A pane goes to the slice of its series that has
    its windows, or to two; a task works out all windows of a slice from its panes, so the work grows with samples,
    not with samples times overlap, and a task holds the panes of about two windows or ``SLICE`` more.
    Nothing is read twice, with percentiles or without; ``percentiles`` and ``materialize`` are as callers give them.
    """
    keys = [*_OF_WINDOW, "slice"]
    parts = panes(samples, specs).withColumn("slice", F.explode(F.sequence(F.expr("k0 div _length"), F.expr("k1 div _length"))))
    parts = parts.select(*keys, "k0", "k1", "ranked", "n", "total", "low", "high")
    kept = [*SERIES, "spec_id", "duration_s", "_first", "_step"]
    found = StructType([parts.schema[c] for c in kept]).add("k", "long").add("to", "long").add("n", "long").add("value", "double")

    def run(batches):
        import pyarrow as pa

        for key, columns in skew.sorted_groups(batches, len(keys)):
            of = dict(zip(keys, key))
            aggregation, least_n, length, at = (of[c].as_py() for c in ("aggregation", "min_samples", "_length", "slice"))
            k, to, n, value = _slice_windows(aggregation, least_n, at * length, (at + 1) * length, *columns)
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.repeat(of[c], len(k)) for c in kept), pa.array(k), pa.array(to), pa.array(n),
                     pa.nulls(len(k), pa.float64()) if value is None else pa.array(value)], [*kept, "k", "to", "n", "value"])

    windows = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, found)
    windows = windows.withColumn("k", F.explode(F.sequence("k", "to")))
    return windows.select(
        *SERIES, "spec_id", "k", F.expr("timestamp_micros(_first + k * _step div 10)").alias("window_start"),
        F.expr("timestamp_micros(_first + k * _step div 10 + duration_s * 1000000)").alias("window_end"), "n", "value")
