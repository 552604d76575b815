"""Operator 13: SimHash near duplicates by a self-join of the binary trie of all fingerprints.

1. A text's fingerprint has bit i set if over half of its shingles' hashes have it. Rows with one fingerprint are one
   class; from here on only distinct fingerprints move.
2. The trie of the fingerprints is traversed against itself, `STEP` bits a round: a pair of nodes (prefixes of one
   length) goes on as the pairs of their children, whose differing bits are added up; pairs over the budget are dropped
   with everything below them. A node has few partners within the budget, whatever the number of fingerprints: at
   depth d and budget 2 at most 1 + d + d (d - 1) / 2. Rounds are joins of counted nodes, not of fingerprints.
3. A pair of nodes with at most 2 * `CAP` fingerprints is finished in one task: both sorted lists are descended bit by
   bit in the same manner, all node pairs of a level at once, until so few are left in both that they are compared.
   Large frontiers are halved, so memory stays bounded in dense clusters too. Of the links only a forest goes on.
4. Components of the links, over Spark.

Words are runs of anything but ASCII white space, A-Z lower-cased; shingles are words joined by a blank, repeats
included; fewer words than `n` are one shingle of all. Null, empty and white-space texts have fingerprint zero, which
links like any other. Repeated rows and ids each keep a row. A null id gets the smallest id of its component, or null.
An empty table gives no rows. Extra columns are not read.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfcap.llm.components import components
from perfcap.llm.tables import Scratch

SEED = 42
STEP = 4
#: Fingerprints of a node that a task takes whole, node pairs it holds at a time, and pairs of fingerprints compared plainly.
CAP = 1 << 15
FRONTIER = 1 << 19
FEW = 32
_UNPACKED = 1 << 16


def shingle_hashes(raw: bytes, n: int = 3) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text, repeats included."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return np.zeros(0, "uint64")
    text = b" ".join(words)
    size = np.fromiter(map(len, words), "int64", len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:max(1, len(words) - n + 1)]
    end = end[min(n, len(words)) - 1:]
    return np.fromiter((xxh64_intdigest(text[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())), "uint64", len(start))


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Per array of hashes, the bits that are set in over half of them; zero for none."""
    sizes = np.array([len(h) for h in hashes], "int64")
    counts = np.zeros((len(hashes), 64), "int64")
    flat, owner = np.concatenate([*hashes, np.zeros(0, "uint64")]), np.repeat(np.arange(len(hashes)), sizes)
    for at in range(0, len(flat), _UNPACKED):
        part, of = flat[at:at + _UNPACKED], owner[at:at + _UNPACKED]
        bits = np.unpackbits(part.astype(">u8").view("uint8").reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        counts[of[first]] += np.add.reduceat(bits, first, axis=0, dtype="int64")
    on = (2 * counts > sizes[:, None]).astype("uint8")
    return np.packbits(on, axis=1).view(">u8").reshape(-1).astype("uint64")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp: the fingerprint as a signed long."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out, held, size = [], [], 0
            for value in batch.column(1):
                raw = value.as_buffer()
                held.append(shingle_hashes(raw.to_pybytes(), n) if raw is not None else np.zeros(0, "uint64"))
                size += len(held[-1])
                if size > _UNPACKED:
                    out.append(majority(held))
                    held, size = [], 0
            out.append(majority(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view("int64"))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


class _Zeros:
    """How many of a sorted list's first i values have a zero at a bit, by bit."""

    def __init__(self, values: np.ndarray):
        self.values, self.known = values, {}

    def __getitem__(self, bit: int) -> np.ndarray:
        if bit not in self.known:
            zero = (self.values >> np.uint64(63 - bit)) & np.uint64(1) == 0
            self.known[bit] = np.concatenate([[0], np.cumsum(zero)])
        return self.known[bit]


def _pairs_within(x, y, l1, h1, l2, h2):
    """Index pairs of all values of the first ranges with all of the second."""
    a, b = h1 - l1, h2 - l2
    many = a * b
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    wide = np.repeat(b, many)
    return np.repeat(l1, many) + k // wide, np.repeat(l2, many) + k % wide


def descend(x: np.ndarray, y: np.ndarray | None, depth: int, differ: int, budget: int):
    """Chunks (i, j) of the pairs of values of x and y that differ in at most `budget` bits.

    x, y: sorted distinct values that agree in their first `depth` bits, but for `differ` of them between x and y. Without
    y, pairs within x, i < j.
    """
    own = y is None
    y = x if own else y
    zx, zy = _Zeros(x), None
    zy = zx if own else _Zeros(y)
    todo = [(depth, *(np.array([v], "int64") for v in (0, len(x), 0, len(y), differ)))]
    while todo:
        bit, l1, h1, l2, h2, diff = todo.pop()
        small = ((h1 - l1) * (h2 - l2) <= FEW) if bit < 64 else np.ones(len(l1), bool)
        if small.any():
            i, j = _pairs_within(x, y, l1[small], h1[small], l2[small], h2[small])
            on = np.bitwise_count(x[i] ^ y[j]) <= budget
            if own:
                on &= i < j
            if on.any():
                yield i[on], j[on]
            l1, h1, l2, h2, diff = (v[~small] for v in (l1, h1, l2, h2, diff))
        if not len(l1):
            continue
        m1 = l1 + zx[bit][h1] - zx[bit][l1]
        m2 = l2 + zy[bit][h2] - zy[bit][l2]
        other = ~((l1 == l2) & (h1 == h2)) if own else np.ones(len(l1), bool)  # a node against itself: its children once
        below = [(l1, m1, l2, m2, diff), (m1, h1, m2, h2, diff), (l1, m1, m2, h2, diff + 1),
                 tuple(v[other] for v in (m1, h1, l2, m2, diff + 1))]
        l1, h1, l2, h2, diff = (np.concatenate(c) for c in zip(*below))
        on = (diff <= budget) & (l1 < h1) & (l2 < h2)
        rest = [v[on] for v in (l1, h1, l2, h2, diff)]
        if len(rest[0]) > FRONTIER:
            half = len(rest[0]) // 2
            todo.append((bit + 1, *(v[:half] for v in rest)))
            rest = [v[half:] for v in rest]
        if len(rest[0]):
            todo.append((bit + 1, *rest))


def forest(size: int, chunks) -> np.ndarray:
    """The smallest index that links reach, for each of `size` values."""
    to = np.arange(size)
    for i, j in chunks:
        while len(i):
            a, b = to[i], to[j]
            on = a != b
            i, j, a, b = i[on], j[on], a[on], b[on]
            low = np.minimum(a, b)
            np.minimum.at(to, np.maximum(a, b), low)
            while (to[to] != to).any():
                to = to[to]
    return to


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(classes: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """(depth, a, b, differ) of the node pairs small enough for a task, whose fingerprints may link; a <= b."""
    total = classes.count()
    spark = classes.sparkSession
    front = spark.createDataFrame([(0, 0, 0, total, total)] if total else [], "a long, b long, differ long, na long, nb long")
    done, depth = [], 0
    while True:
        ready = F.lit(depth == 64) | (F.col("na") + F.col("nb") <= 2 * CAP)
        done.append(front.where(ready).select(F.lit(depth).alias("depth"), "a", "b", "differ"))
        rest = front.where(~ready)
        if depth == 64 or rest.isEmpty():
            break
        deeper = depth + STEP
        nodes = scratch.write(classes.groupBy(_prefix(deeper).alias("node")).agg(F.count("*").alias("n")).select(
            (F.shiftrightunsigned("node", STEP) if depth else F.lit(0).cast("long")).alias("up"), "node", "n"))
        first = rest.select("a", "b", "differ").join(nodes.select(F.col("up").alias("a"), F.col("node").alias("a2"), F.col("n").alias("na")), "a")
        second = nodes.select(F.col("up").alias("b"), F.col("node").alias("b2"), F.col("n").alias("nb"))
        differ = F.col("differ") + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << STEP) - 1).cast("long")))
        near = (first["b"] == second["b"]) & (differ <= budget) & ((first["a"] != first["b"]) | (F.col("a2") <= F.col("b2")))
        front = scratch.write(first.join(second, near).select(
            F.col("a2").alias("a"), F.col("b2").alias("b"), differ.cast("long").alias("differ"), "na", "nb"))
        depth = deeper
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links(classes: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """(a, b): a forest over the fingerprints of each node pair, with the components of their links."""
    pairs = scratch.write(node_pairs(classes, budget, scratch))
    depths = [r[0] for r in pairs.select("depth").distinct().collect()]
    wanted = pairs.select("depth", F.col("a").alias("node")).unionByName(pairs.select("depth", F.col("b").alias("node"))).distinct()
    members = None
    for depth in depths:
        at = (classes.select(_prefix(depth).alias("node"), "fp").groupBy("node").agg(F.collect_list("fp").alias("fps"))
              if depth < 64 else classes.select(F.col("fp").alias("node"), F.array("fp").alias("fps")))
        of = at.join(wanted.where(F.col("depth") == depth).select("node"), "node", "left_semi").select(F.lit(depth).alias("depth"), "node", "fps")
        members = of if members is None else members.unionByName(of)
    if members is None:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    members = scratch.write(members)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                depth, differ, own = (batch.column(c)[k].as_py() for c in (0, 1, 2))
                x, y = (np.sort(np.array(batch.column(c)[k].values, "int64").view("uint64")) for c in (3, 4))
                both = x if own else np.concatenate([x, y])
                if own:
                    to = forest(len(x), descend(x, None, depth, differ, budget))
                else:
                    to = forest(len(both), ((i, j + len(x)) for i, j in descend(x, y, depth, differ, budget)))
                on = np.flatnonzero(to != np.arange(len(to)))
                ends = both.view("int64")
                yield pa.RecordBatch.from_arrays([pa.array(ends[to[on]]), pa.array(ends[on])], ["a", "b"])

    joined = (pairs.join(members.select("depth", F.col("node").alias("a"), F.col("fps").alias("x")), ["depth", "a"])
              .join(members.select("depth", F.col("node").alias("b"), F.col("fps").alias("y")), ["depth", "b"]))
    return joined.select("depth", "differ", F.expr("a = b").alias("own"), "x", F.when(F.expr("a = b"), F.array().cast("array<long>")).otherwise(F.col("y")).alias("y")
                         ).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, n: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id: the smallest id that links reach, the own included."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, n))
    classes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    parts = components(scratch.write(links(classes, budget, scratch)), scratch)
    reach = classes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = reach.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.write(reach.join(least, "component").select("fp", "component_id"))
    out = scratch.write(rows)
    scratch.drop(keep=2)
    return out.join(of_class, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
