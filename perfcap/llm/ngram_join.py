"""Operator 6: exact Jaccard join of word-shingle sets by T-occurrence search (DivideSkip), as components of links.

1. Texts with equal sets are one class. Blocks of texts deal their shingles to buckets, which count them over all blocks
   and answer with the counts of those found twice or more; shingles are ordered by count, then hash, the rare ones first.
2. Two sets that link share a shingle among their first n - ceil(j n) + 1 (the prefix). Shingles nobody else has come
   first and need no list, so a text whose shared shingles are under that number of its set has none. Prefixes are dealt
   by shingle; shingles with two classes or more become inverted lists.
3. Lists over `LONG` classes would pair with themselves; there every class is first compared with one pivot, the class
   with most list entries (the text that all others were copied from has no rare shingles of its own). What links is one
   component and is not paired again.
4. Each class asks its lists for members of components that rank above its own. The short lists are merged by a heap
   and count the shared shingles; the long ones are only probed, by binary search, for what the short ones left
   possible (DivideSkip). The count that a pair must reach follows from both sizes, so most pairs go without a look at
   their sets.
5. Pairs that are left are verified on their whole sets. Components of all links follow.

Words are runs of anything but ASCII white space, A-Z lower-cased. Null or empty text: empty set, no links. Fewer words
than n: the whole sequence is the one shingle. Rows that repeat a text are one class; a null id gets the smallest id of
its component, or null. An empty table gives no rows. Extra columns are not read. Shingles and classes are told apart by
64-bit hashes; in lists two shingles may share a key, which costs a look at the sets.
"""

import hashlib
import heapq
from bisect import bisect_left
from math import log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfcap.llm.components import components
from perfcap.llm.tables import Scratch

#: Texts of a block, and owners of a key in a block beyond which they stay with the block.
BLOCK = 4096
HEAVY = 32
LONG = 64
#: Bits of the filter by which the texts of pairs are found again, and DivideSkip's usual weight of a probe.
BITS = 1 << 23
MU = 0.01

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class _WordHash(dict):
    def __missing__(self, word):
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, n: int):
        self.n, self.known = n, _WordHash()

    def __call__(self, text: str | None):
        if len(self.known) > 1_000_000:
            self.known.clear()
        words = (text or "").encode("utf-8", "surrogateescape").lower().split()
        h = np.fromiter(map(self.known.__getitem__, words), "uint64", len(words))
        width = min(self.n, len(h))
        out = np.full(len(h) - width + 1 if width else 0, width, "uint64")
        for i in range(width):
            out = (out ^ h[i:i + len(out)]) * _MIX[i % 4]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def needed(a: int, b: int, num: int, den: int) -> int:
    """Smallest overlap at which sets of a and b shingles reach num/den."""
    return -(-num * (a + b) // (num + den))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _dealt(docs: DataFrame, n: int, buckets: int, kind: str) -> DataFrame:
    """Blocks of texts: to each bucket of shingles the block's distinct keys with counts and owners, and a row for itself.

    A key is (bucket, 32 bits). Owners are places of distinct sets in the block. Keys of more than `HEAVY` owners leave
    those in the block's own row (bucket under 0), so that a bucket gets a bounded share of each block.
    """
    schema = ("bucket int, block bigint, keys binary, counts binary, owners binary, "
              f"ids array<{kind}>, places binary, nodes binary, sizes binary, heavy binary, heavy_counts binary, heavy_owners binary")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shingler, block = Shingler(n), TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in schema.split(", ")]

        def settle(ids, sets):
            known: dict[int, int] = {}
            places = np.array([known.setdefault(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True), len(known))
                               for h in sets], "<u2")
            own = [sets[i] for i in np.unique(places, return_index=True)[1].tolist()]
            flat, owner = np.concatenate(own), np.repeat(np.arange(len(own), dtype="<u2"), [len(h) for h in own])
            key = (flat % np.uint64(buckets) << np.uint64(32)) | (flat >> np.uint64(32))
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            key = key[first]
            wide = count > HEAVY
            light = np.repeat(~wide, count)
            heavy = [key[wide].tobytes(), count[wide].astype("<u2").tobytes(), owner[~light].tobytes()]
            cuts = np.searchsorted(key, np.arange(buckets + 1, dtype="uint64") << np.uint64(32))
            places_of = np.concatenate([[0], np.cumsum(np.where(wide, 0, count))])
            owner = owner[light]
            rows = [(b, block, (key[x:y] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), count[x:y].astype("<u2").tobytes(),
                     owner[places_of[x]:places_of[y]].tobytes(), *[None] * 7) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if x < y]
            rows.append((-1 - block % buckets, block, None, None, None, ids, places.tobytes(), np.array(list(known), "<i8").tobytes(),
                         np.array([len(h) for h in own], "<i8").tobytes(), *heavy))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(batch.schema.field(0).type), *[pa.binary()] * 6]
            ids, sets, size = [], [], 0
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                sets.append(shingler(batch.column(1)[i].as_py()))
                size += len(sets[-1])
                if len(ids) == BLOCK or size > 512 * BLOCK or i == batch.num_rows - 1:
                    yield settle(ids, sets)
                    ids, sets, size, block = [], [], 0, block + 1

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def _counted(dealt: DataFrame, buckets: int) -> DataFrame:
    """Each block's keys that are found twice or more over all blocks, with that count; blocks' own rows as they are."""
    names = dealt.columns[1:]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields[1:])

    def run(batches):
        import pyarrow as pa

        held, at = [], None

        def settle():
            keys, counts = (np.concatenate([np.frombuffer(r[i], t) for r in held]) for i, t in ((1, "<u4"), (2, "<u2")))
            known, back = np.unique(keys, return_inverse=True)
            total = np.bincount(back, weights=counts).astype("int64")[back]
            out, start = [], 0
            for block, own, count, owners in held:
                size = len(own) // 4
                part = total[start:start + size]
                start += size
                on = part > 1
                if not on.any():
                    continue
                count = np.frombuffer(count, "<u2")
                kept = np.frombuffer(owners, "<u2")[np.repeat(on, np.where(count > HEAVY, 0, count))]
                key = (np.uint64(at) << np.uint64(32)) | np.frombuffer(own, "<u4")[on]
                out.append((block, key.tobytes(), count[on].tobytes(), kept.tobytes(), part[on].clip(0, 2**32 - 1).astype("<u4").tobytes()))
            if out:
                block, key, count, kept, part = zip(*out)
                columns = {"block": block, "keys": key, "counts": count, "owners": kept, "places": part}
                return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(len(out), t) for c, t in zip(names, types)], names)

        for batch in batches:
            types = [f.type for f in batch.schema][1:]
            bucket = batch.column(0).to_numpy()
            if (bucket < 0).any():
                yield batch.filter(pa.array(bucket < 0)).select(names)
            for i in np.flatnonzero(bucket >= 0).tolist():
                if held and bucket[i] != at:
                    if (found := settle()) is not None:
                        yield found
                    held = []
                at = int(bucket[i])
                held.append(tuple(batch.column(c)[i].as_py() for c in (1, 2, 3, 4)))
        if held and (found := settle()) is not None:
            yield found

    parts = max(1, buckets // 8)
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, node, n, prefix) of every row; prefix: the keys of its rarest shingles, as bytes, without those no other has.

    docs is read once, in an order that must be the same should a part be read again: a table, not a shuffle's result.
    """
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def settle(held, own):
            ids, places, nodes, sizes, heavy, many, owners = own
            places, nodes, sizes = np.frombuffer(places, "<u2"), np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<i8")
            heavy, many, owners = np.frombuffer(heavy, "<u8"), np.frombuffer(many, "<u2").astype("int64"), np.frombuffer(owners, "<u2")
            ends = np.cumsum(many)
            keys, owner, total = [np.zeros(0, "<u8")], [np.zeros(0, "<u2")], [np.zeros(0, "<u4")]
            for key, count, light, freq in held:
                key, count, light, freq = (np.frombuffer(v, t) for v, t in ((key, "<u8"), (count, "<u2"), (light, "<u2"), (freq, "<u4")))
                few = count <= HEAVY
                keys.append(np.repeat(key[few], count[few]))
                total.append(np.repeat(freq[few], count[few]))
                owner.append(light)
                for k, f in zip(key[~few], freq[~few]):
                    i = int(np.searchsorted(heavy, k))
                    owner.append(owners[ends[i] - many[i]:ends[i]])
                    keys.append(np.full(many[i], k))
                    total.append(np.full(many[i], f))
            keys, owner, total = (np.concatenate(v) for v in (keys, owner, total))
            order = np.lexsort((keys, total, owner))
            keys, owner = keys[order], owner[order].astype("int64")
            shared = np.bincount(owner, minlength=len(sizes))
            start = np.cumsum(shared) - shared
            alone = sizes - shared
            take = np.maximum(0, np.minimum(shared, sizes - -(-num * sizes // den) + 1 - alone))
            prefix = [keys[a:a + k].astype("<u8").tobytes() for a, k in zip(start.tolist(), take.tolist())]
            at = places.astype("int64")
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(nodes[at]), pa.array(sizes[at]), pa.array([prefix[i] for i in at.tolist()], pa.binary())],
                                              ["doc_id", "node", "n", "prefix"])

        at, held, own = None, [], None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in zip(*(c for c in batch.columns)):
                block = row[0].as_py()
                if at is not None and block != at:
                    yield settle(held, own)
                    held, own = [], None
                at = block
                if row[4].is_valid:
                    own = [v.as_py() for v in row[4:]]
                else:
                    held.append(tuple(row[i].as_py() for i in (1, 2, 3, 5)))
        if at is not None:
            yield settle(held, own)

    counted = _counted(_dealt(docs, n, buckets, kind), buckets)
    return counted.repartition(max(1, buckets // 8), "block").sortWithinPartitions("block").mapInArrow(run, f"doc_id {kind}, node bigint, n bigint, prefix binary")


def _groups(batches):
    """Runs of rows with the same first column, as lists of rows; the input is sorted by it."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != at:
                yield held
                held = []
            at = row[0]
            held.append(row)
    if held:
        yield held


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(list, node, n, size): members of every list of two classes or more that share a prefix shingle."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            each = [np.frombuffer(p.as_buffer(), "uint64") for p in batch.column(2)]
            token = np.concatenate([*each, np.zeros(0, "uint64")])
            owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
            bucket = (token % np.uint64(buckets)).astype("int64")
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, token[o].tobytes(), nodes[owner[o]].tobytes(), sizes[owner[o]].astype("<i8").tobytes())
                    for b in range(buckets) if len(o := order[cuts[b]:cuts[b + 1]])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                                                 ["bucket", "token", "node", "n"])

    def lists(batches):
        import pyarrow as pa

        for held in _groups(batches):
            token, node, n = (np.concatenate([np.frombuffer(h[i], "int64") for h in held]) for i in (1, 2, 3))
            order = np.lexsort((node, token))
            token, node, n = token[order], node[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
            on = size > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (token, node, n, size)], ["list", "node", "n", "size"])

    dealt = classes.select("node", "n", "prefix").mapInArrow(deal, "bucket int, token binary, node binary, n binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lists, "list bigint, node bigint, n bigint, size bigint")


def pivots(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of every class of a long list with the list's pivot."""
    mass = members.groupBy("node").agg(F.sum("size").alias("mass"))
    long = members.where(F.col("size") > LONG).join(mass, "node").select("list", "node", "mass")
    pivot = long.groupBy("list").agg(F.max(F.struct("mass", "node")).alias("pivot"))
    return (long.join(pivot, "list").select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).where("a <> b").distinct())


def requests(members: DataFrame, ranks: DataFrame) -> DataFrame:
    """(asker, own, nodes, sizes): for each class and list, the members whose component ranks above its own.

    ranks: (node, component, members) of classes that are not alone. Fewer members rank lower, then the component's id.
    """
    def run(batches):
        import pyarrow as pa

        out: list[tuple] = []
        for held in _groups(batches):
            _, node, n, component, members = (np.array(c) for c in zip(*held))
            order = np.lexsort((node, component, members))
            node, n, component, members = node[order], n[order], component[order], members[order]
            new = np.flatnonzero(np.concatenate([(component[1:] != component[:-1]), [True]])) + 1
            for start, end in zip(np.append(0, new[:-1]), new[:-1]):
                rest = end + np.argsort(node[end:], kind="stable")
                nodes, sizes = node[rest].tobytes(), n[rest].astype("<u4").tobytes()
                out += [(x, own, nodes, sizes) for x, own in zip(node[start:end].tolist(), n[start:end].tolist())]
            if len(out) > 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    import pyarrow

    names, kinds = ["asker", "own", "nodes", "sizes"], (pyarrow.int64(), pyarrow.int64(), pyarrow.binary(), pyarrow.binary())
    known = members.join(ranks, "node", "left").select(
        "list", "node", "n", F.coalesce("component", "node").alias("component"), F.coalesce("members", F.lit(1)).alias("members"))
    return known.repartition("list").sortWithinPartitions("list").mapInArrow(run, "asker bigint, own bigint, nodes binary, sizes binary")


def divide_skip(lists: list, own: int, num: int, den: int) -> list[int]:
    """Nodes that share enough of the lists with a class of `own` shingles.

    lists: pairs (nodes in order, their sizes). A pair with c shared prefix shingles overlaps in at most c + r, where r is
    the larger number of shingles beyond a prefix; it is kept if that, and the smaller set, reaches `needed`.
    """
    def least(size: int) -> int:
        if needed(own, size, num, den) > min(own, size):
            return 1 << 60
        beyond = max(own - prefix_size(own, num, den), size - prefix_size(size, num, den))
        return max(1, needed(own, size, num, den) - beyond)

    lists = sorted(lists, key=lambda x: len(x[0]))
    floor = min(least(s) for s in {s for _, sizes in lists for s in sizes})
    if floor > len(lists):
        return []
    long = min(int(floor / (MU * log2(max(2, len(lists[-1][0]))) + 1)), floor - 1, len(lists) - 1)
    short, rest = lists[:len(lists) - long], [x[0] for x in lists[len(lists) - long:]]
    found, at, count, size = [], None, 0, 0

    def keep() -> None:
        want = least(size)
        have, left = count, len(rest)
        for nodes in rest:
            if have + left < want or have >= want:
                break
            i = bisect_left(nodes, at)
            have += i < len(nodes) and nodes[i] == at
            left -= 1
        if have >= want:
            found.append(at)

    for node, s in heapq.merge(*(zip(nodes, sizes) for nodes, sizes in short)):
        if node != at:
            if at is not None and count + len(rest) >= floor:
                keep()
            at, count, size = node, 0, s
        count += 1
    if at is not None:
        keep()
    return found


def ask(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that divide_skip finds for every asker of requests."""
    def run(batches):
        import pyarrow as pa

        a, b = [], []
        for held in _groups(batches):
            lists = [(np.frombuffer(h[2], "int64").tolist(), np.frombuffer(h[3], "<u4").tolist()) for h in held]
            found = divide_skip(lists, held[0][1], num, den)
            a += [held[0][0]] * len(found)
            b += found
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("asker").sortWithinPartitions("asker").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach num/den. Their texts are found again by a filter of BITS bits on ids."""
    import pyarrow

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1
    maps = (wanted.join(classes.select("node", "doc_id"), "node").groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect())
    words = np.zeros((BITS // 32768 + 1, 4096), "uint8")
    for r in maps:
        words[r["bucket"] - 1] = np.frombuffer(r["bits"], "uint8")
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(n)
        for batch in batches:
            at = batch.column(0).to_numpy()
            at = at - 1  # as Spark numbers them: bucket 1 holds 1 to 32768
            on = (shipped.value[at // 32768, at % 32768 // 8] >> (at % 8).astype("uint8")) & 1 if len(at) else at
            sets = [shingler(batch.column(1)[i].as_py()) for i in np.flatnonzero(on).tolist()]
            node = [int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True) for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "shingles"])

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            on = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                on.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(on, pa.bool_()))

    sets = docs.select(bit.alias("bit"), "text").mapInArrow(run, "node bigint, shingles binary")
    sets = sets.join(wanted, "node", "left_semi")
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint").distinct())


def similar_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id: the smallest id that links reach, the own included."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(shingle_sets(docs, n, num, den))
    classes = scratch.write(rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    members = scratch.write(inverted_lists(classes))
    first = scratch.write(pivots(members))
    links = scratch.write(verified(first, docs, classes, n, num, den))
    alike = components(links, scratch)
    ranks = alike.join(alike.groupBy("component").agg(F.count("*").alias("members")), "component")
    pairs = scratch.write(ask(requests(members, ranks), num, den))
    links = links.unionByName(verified(pairs, docs, classes, n, num, den))
    parts = components(links, scratch)
    reach = classes.select("node", "doc_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reach.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = scratch.write(reach.join(least, "component").select("node", "component_id"))
    out = scratch.write(rows.select("doc_id", "node", F.col("n").alias("n_shingles")))
    scratch.drop(keep=2)
    return out.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
