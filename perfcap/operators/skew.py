"""Ways around one key that holds a large share of all rows.

* ``salted_join`` spreads the rows of a hot join key over several tasks.
* ``running`` computes running aggregates of a long ordered group slice by slice, so that no task
  sorts the whole group.
* ``grouped_quantiles`` computes exact quantiles from value counts and buckets, whatever the size of a group.
"""

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list, salt: Column, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Equi-join where one key may hold a large share of ``big``.

    ``small`` (one row per key) is repeated ``salts`` times; ``salt`` must be a deterministic
    expression over ``big`` that differs between rows of a key.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def running(df: DataFrame, keys: list, order: list, slice_col: Column, specs: dict) -> DataFrame:
    """Running aggregates over all *preceding* rows of a key, computed slice by slice.

    ``specs`` maps an output name to ``(kind, column)`` with kind ``sum``, ``max`` or ``last`` (last
    non-null).  ``slice_col`` must not decrease along ``order`` (a truncated timestamp).  Rows are
    windowed within (key, slice); what earlier slices contribute comes from one row per slice.
    """
    rows = df.withColumn("_slice", slice_col)
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    def windowed(kind, column, window):
        if kind == "sum":
            return F.coalesce(F.sum(column).over(window), F.lit(0))
        if kind == "max":
            return F.max(column).over(window)
        return F.last(column, ignorenulls=True).over(window)

    def total(kind, column):
        if kind == "sum":
            return F.sum(column)
        if kind == "max":
            return F.max(column)
        present = column.isNotNull()
        return F.max_by(F.when(present, column), F.when(present, F.struct(*order)))

    totals = rows.groupBy(*keys, "_slice").agg(*[total(k, c).alias(f"_t_{n}") for n, (k, c) in specs.items()])
    carried = totals.select(
        *keys, "_slice", *[windowed(k, F.col(f"_t_{n}"), outer).alias(f"_c_{n}") for n, (k, _) in specs.items()])
    local = rows.select("*", *[windowed(k, c, inner).alias(f"_l_{n}") for n, (k, c) in specs.items()])

    def merged(name, kind):
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            return here + before
        return F.greatest(here, before) if kind == "max" else F.coalesce(here, before)

    joined = local.join(carried, [*keys, "_slice"])
    return joined.select(*df.columns, *[merged(n, k).alias(n) for n, (k, _) in specs.items()])


def _bucket(value: Column) -> Column:
    """Monotone, logarithmic bucket of a double: relative width about 1/4096; NaN below everything."""
    size = F.least(F.log1p(F.abs(value) * 1e6) * 4096, F.lit(1e15))
    return F.when(F.isnan(value), F.lit(-(1 << 62))).otherwise((F.signum(value) * F.floor(size)).cast("long"))


def bucket_quantiles(df: DataFrame, keys: list, value: str, probs: list, materialize=None) -> DataFrame:
    """Exact interpolated quantiles: equal values are counted first (map-side), then :func:`counted_quantiles`."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counted_quantiles(counts, keys, value, probs, materialize)


def counted_quantiles(counts: DataFrame, keys: list, value: str, probs: list, materialize=None) -> DataFrame:
    """Exact interpolated quantiles of distinct values with counts ``_n``, without gathering a group in one task.

    Bucket totals locate the two ranks each quantile needs, and only the buckets that hold a rank are sorted.
    """
    counts = counts.withColumn("_bucket", _bucket(F.col(value)))
    # The join below drops these; said here, both readings of the counts are one plan, whose shuffle is used twice.
    for c in (*keys, "_bucket"):
        counts = counts.where(F.col(c).isNotNull())
    if materialize is not None:
        counts = materialize(counts)
    buckets = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn"))
    upto = Window.partitionBy(*keys).orderBy("_bucket")
    whole = Window.partitionBy(*keys)
    buckets = buckets.select(
        *keys, "_bucket", "_bn",
        (F.sum("_bn").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(whole).alias("_total"))
    wanted = buckets.select(
        *keys, "_bucket", "_before", "_total", "_bn",
        F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_q", "_p"))
    position = F.col("_p") * (F.col("_total") - 1)
    wanted = wanted.withColumn("_lo", F.floor(position)).withColumn(
        "_hi", F.least(F.floor(position) + 1, F.col("_total") - 1)).withColumn("_frac", position - F.floor(position))
    inside = lambda rank: (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bn"))
    wanted = wanted.where(inside(F.col("_lo")) | inside(F.col("_hi")))

    needed = wanted.groupBy(*keys, "_bucket", "_before").agg(
        F.collect_list(F.struct("_q", "_lo", "_hi", "_frac")).alias("_qs"))  # at most one per quantile
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(needed, [*keys, "_bucket"]).select(
        *keys, value, "_n", "_qs", (F.col("_before") + F.sum("_n").over(within) - F.col("_n")).alias("_rank0"))
    hits = ranked.select(*keys, value, "_n", "_rank0", F.inline("_qs"))
    holds = lambda rank: (rank >= F.col("_rank0")) & (rank < F.col("_rank0") + F.col("_n"))
    per_q = hits.groupBy(*keys, "_q", "_frac").agg(
        F.max(F.when(holds(F.col("_lo")), F.col(value))).alias("_vlo"),
        F.max(F.when(holds(F.col("_hi")), F.col(value))).alias("_vhi"))
    value_at = F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))
    return per_q.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_q", value_at.alias("_v")))), lambda s: s["_v"])
        .alias("quantiles"))


def grouped_quantiles(df: DataFrame, keys: list, value: str, probs: list, aggs: list, materialize=None) -> DataFrame:
    """``aggs`` plus ``quantiles`` (array in the order of ``probs``, null without values) per group.

    The aggregates combine before the shuffle; the quantiles come from one count of equal values, which also combines
    before its shuffle. ``materialize`` (such as ``session.cut_lineage``) writes that count once for its two uses.
    """
    base = df.groupBy(*keys).agg(*aggs)
    return base.join(bucket_quantiles(df, keys, value, probs, materialize), keys, "left")


def union_all(frames: list) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sorted_groups(batches, keys: int):
    """(key, columns) of rows with the same first ``keys`` columns, as Arrow scalars; the input is sorted by them."""
    import pyarrow.compute as pc

    held, at = [], None
    for batch in batches:
        n = batch.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for c in batch.columns[:keys] if n > 1 else []:
            a, b = c.slice(1), c.slice(0, n - 1)
            other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            new[1:] |= other.to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(new), n).tolist()
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[keys:]]
        for i, j in zip(cuts[:-1], cuts[1:]):
            key = [c[i] for c in batch.columns[:keys]]
            if held and key != at:
                yield at, [np.concatenate(c) for c in zip(*held)]
                held = []
            at = key
            held.append([c[i:j].copy() for c in columns])
    if held:
        yield at, [np.concatenate(c) for c in zip(*held)]
