"""Operator 11: ranked lexical search over bit-sliced Bloom signatures.

`build_index` writes the documents in rows of up to `DOCS` texts of one signature width. A document's signature holds its
terms, and again each term found at least 2, 4, 8, ... times under a further hash; the width follows the number of
entries. Signatures lie bit-sliced: one bitmap over the row's documents for each bit. Each row also has its sorted term
hashes with document counts, so the index does not depend on any query.

`search` takes the items in blocks of bounded size:
1. Exact document counts of the terms from the rows' term lists, hence the weights.
2. A term's bitmaps, joined by AND, hold at least the documents that have it; the levels bound its count from above.
   Weighted sums of these bitmaps give no less than each document's score for each item.
3. The documents with the `SEEDS` * k highest bounds of each item are scored exactly; the k-th best of these scores is a
   threshold.
4. Every document whose bound reaches the threshold is scored exactly from its text; tasks keep their k best of each
   item, and the best of these are the answer. No document is left out that could belong to it.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. Null, empty or termless texts
are not counted and never found. Rows that share an id are documents of their own. Items that share an id are one item
with all their terms; an item without terms has no rows. A null id sorts first. Empty tables give no rows. Extra columns
are not read. Terms are told apart by 64-bit hashes in the counts of step 1 only.
"""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfcap.llm.tables import Scratch

#: Documents and bytes of text in a row of the index, bits for an entry of a signature (to the next power of two), hashes.
DOCS = 1024
BYTES = 1 << 20
BITS = 16
HASHES = 4
#: The index is written in row groups of this size, so that a task reads few of its rows, which are large, at a time.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
#: Hashes of terms that a task keeps.
KNOWN = 200_000
#: Pairs of item and term in a block of items.
TERMS = 20_000
#: Times k documents that are scored for an item's threshold.
SEEDS = 4

_KEEP = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
_LEVEL, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return raw.translate(_KEEP).split()


class _Hash(dict):
    def __missing__(self, term):
        self[term] = h = int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little")
        return h


def positions(hashes: np.ndarray, level, width: int) -> np.ndarray:
    """Bits of the signature for each hash at its level: HASHES columns."""
    h = hashes + np.atleast_1d(np.asarray(level, "uint64")) * _LEVEL
    h = (h ^ (h >> np.uint64(31))) * _STEP
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype="uint64") * step[:, None]) & np.uint64(width - 1)).astype("int64")


def entries(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, level) of every entry: level j for terms found 2^j times or more."""
    levels = np.frexp(counts.astype("float64"))[1]  # 1 -> 1, 2 and 3 -> 2, 4 to 7 -> 3
    term = np.repeat(np.arange(len(counts)), levels)
    return term, np.arange(len(term)) - np.repeat(np.cumsum(levels) - levels, levels)


def index_row(width: int, held: list) -> tuple:
    """(docs, words, top, n, bits, terms, dfs) of documents (id, raw, n, hashes, counts) of one width."""
    on, top = np.zeros((width, len(held)), bool), 1
    for i, (_, _, _, hashes, counts) in enumerate(held):
        term, level = entries(counts)
        on[positions(hashes[term], level, width).ravel(), i] = True
        top = max(top, int(level.max()) + 1)
    terms, dfs = np.unique(np.concatenate([h[3] for h in held]), return_counts=True)
    n = np.array([h[2] for h in held], "int64")
    return (len(held), int(n.sum()), top, n.tobytes(), np.packbits(on, axis=1).tobytes(), terms.tobytes(), dfs.astype("uint32").tobytes())


def build_index(docs: DataFrame) -> DataFrame:
    """The index rows of all documents with a term; `row` numbers them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, width int, docs int, words bigint, top int, n binary, bits binary, terms binary, dfs binary, ids array<{kind}>, texts array<binary>"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, row = _Hash(), TaskContext.get().partitionId() << 32
        held, size = defaultdict(list), Counter()
        id_type = None

        def flush(width):
            nonlocal row
            rows = held.pop(width)
            size.pop(width)
            made = index_row(width, rows)
            out = [row, width, *made, [r[0] for r in rows], [r[1] for r in rows]]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(id_type), pa.list_(pa.binary())]
            row += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)], [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                buffer = value.as_buffer()
                raw = buffer.to_pybytes() if buffer is not None else b""
                counts = Counter(terms_of(raw))
                if not counts:
                    continue
                if len(known) > KNOWN:
                    known.clear()
                hashes = np.fromiter(map(known.__getitem__, counts), "uint64", len(counts))
                tf = np.fromiter(counts.values(), "int64", len(counts))
                many = int(np.frexp(tf.astype("float64"))[1].sum())
                width = max(64, 1 << (BITS * many - 1).bit_length())
                held[width].append((doc_id.as_py(), raw, int(tf.sum()), hashes, tf))
                size[width] += len(raw)
                if len(held[width]) == DOCS or size[width] > BYTES:
                    yield flush(width)
            while sum(size.values()) > 8 * BYTES:  # many widths at a time
                yield flush(size.most_common(1)[0][0])
        for width in list(held):
            yield flush(width)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


class Query:
    """Items of one block: ids, their terms as numbers, and, when counted, weights."""

    def __init__(self, rows: list[tuple]):
        of = defaultdict(set)
        for item, term in rows:
            of[item].add(term)
        self.ids = sorted(of, key=lambda i: (i is not None, i or 0))
        self.terms = sorted({t for ts in of.values() for t in ts})
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = [np.array(sorted(number[t] for t in of[i]), "int64") for i in self.ids]
        known = _Hash()
        self.hashes = np.fromiter((known[t] for t in self.terms), "uint64", len(self.terms))
        self.weights, self.docs, self.words = None, 0, 1

    def weigh(self, dfs: dict[int, int], docs: int, words: int) -> None:
        self.docs, self.words = docs, words
        self.weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * dfs.get(i, 0) + 1))) for i in range(len(self.terms))], "int64")

    def length_part(self, n: int) -> int:
        return 50 + (50 * n * self.docs) // self.words

    def bounds(self, width: int, top: int, n: np.ndarray, bits: bytes) -> np.ndarray:
        """An upper bound of each item's score for each document of an index row."""
        count = len(n)
        slices = np.frombuffer(bits, "uint8").reshape(width, -1)
        m = np.array([self.length_part(x) for x in n.tolist()], "int64")
        out, before = np.zeros((len(self.items), count), "int64"), np.zeros(count, "int64")
        found = None
        for level in range(top):
            at = positions(self.hashes, level, width)
            here = slices[at[:, 0]]
            for k in range(1, HASHES):
                here = here & slices[at[:, k]]
            found = here if found is None else found & here
            if not found.any():
                break
            most = (2 << level) - 1  # found at no higher level: at most so many times
            part = (1_000_000_000 * most) // (1000 * most + 20 * m)
            gain = part - before
            for i, own in enumerate(self.items):
                if (slim := found[own]).any():
                    out[i] += (self.weights[own] @ np.unpackbits(slim, axis=1, count=count)) * gain
            before = part
        return out

    def scores(self, raw: bytes, items: list[int]) -> list[int]:
        """Exact scores of a text."""
        terms = terms_of(raw)
        tf, m = Counter(terms), self.length_part(len(terms))
        out = []
        for i in items:
            score = 0
            for t in self.items[i].tolist():
                k = tf.get(self.terms[t], 0)
                if k:
                    score += int(self.weights[t]) * ((1_000_000_000 * k) // (1000 * k + 20 * m))
            out.append(score)
        return out


def _batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names)


def _term_counts(index: DataFrame, shipped) -> dict[int, int]:
    """Documents that hold each term of the block."""
    def run(batches):
        query = shipped.value
        total = np.zeros(len(query.terms), "int64")
        for batch in batches:
            for terms, dfs in zip(batch.column(0), batch.column(1)):
                terms, dfs = np.frombuffer(terms.as_buffer(), "uint64"), np.frombuffer(dfs.as_buffer(), "uint32")
                at = np.minimum(np.searchsorted(terms, query.hashes), len(terms) - 1)
                total += np.where(terms[at] == query.hashes, dfs[at], 0).astype("int64")
        yield _batch([(i, int(total[i])) for i in np.flatnonzero(total)], ["term", "df"])

    rows = index.select("terms", "dfs").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r["term"]: r["df"] for r in rows}


def _row_bounds(query: Query, batch, i: int):
    width, top = (batch.column(c)[i].as_py() for c in (1, 2))
    return query.bounds(width, top, np.frombuffer(batch.column(3)[i].as_buffer(), "int64"), batch.column(4)[i].as_buffer())


def _highest_bounds(index: DataFrame, shipped, k: int) -> DataFrame:
    """(item, row, pos) of the k documents with the highest bounds of each item."""
    def run(batches):
        query = shipped.value
        best = [np.zeros((0, 3), "int64") for _ in query.items]
        for batch in batches:
            for i in range(batch.num_rows):
                bound, row = _row_bounds(query, batch, i), batch.column(0)[i].as_py()
                for item, own in enumerate(best):
                    floor = own[-1, 0] if len(own) == k else 0
                    on = np.flatnonzero(bound[item] > floor)
                    if len(on):
                        more = np.stack([bound[item][on], np.full(len(on), row), on], axis=1)
                        both = np.concatenate([own, more])
                        best[item] = both[np.argsort(-both[:, 0], kind="stable")[:k]]
        yield _batch([(item, *r) for item, own in enumerate(best) for r in own.tolist()], ["item", "bound", "row", "pos"])

    rows = index.select("row", "width", "top", "n", "bits").mapInArrow(run, "item bigint, bound bigint, row bigint, pos bigint")
    first = Window.partitionBy("item").orderBy(F.desc("bound"), "row", "pos")
    return rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("item", "row", "pos")


def _thresholds(index: DataFrame, shipped, k: int) -> np.ndarray:
    """For each item a score that k documents reach, or 1."""
    query = shipped.value
    wanted = defaultdict(lambda: defaultdict(list))
    for r in _highest_bounds(index, shipped, SEEDS * k).collect():
        wanted[r["row"]][r["pos"]].append(r["item"])
    asked = index.sparkSession.sparkContext.broadcast({row: dict(at) for row, at in wanted.items()})

    def run(batches):
        for batch in batches:
            out = []
            for row, texts in zip(batch.column(0), batch.column(1)):
                for pos, items in asked.value.get(row.as_py(), {}).items():
                    out += [(i, s) for i, s in zip(items, shipped.value.scores(texts[pos].as_py(), items)) if s]
            yield _batch(out, ["item", "score"])

    least = np.ones(len(query.items), "int64")
    scored = index.select("row", "texts").mapInArrow(run, "item bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    for r in scored.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).collect():
        least[r["item"]] = r["score"]
    return least


def _answers(index: DataFrame, shipped, least, k: int, id_kind: str) -> DataFrame:
    """(item, doc_id, score): in each task, the k best documents of each item among those whose bound reaches `least`."""
    def run(batches):
        import pyarrow as pa

        query, best, id_type = shipped.value, defaultdict(list), pa.int64()
        for batch in batches:
            id_type = batch.schema.field(5).type.value_type
            for i in range(batch.num_rows):
                bound = _row_bounds(query, batch, i)
                item, pos = np.nonzero(bound >= least.value[:, None])
                if not len(pos):
                    continue
                ids, texts = batch.column(5)[i], batch.column(6)[i]
                order = np.argsort(pos, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(pos[order]) > 0, [True]]))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    at, items = int(pos[order[a]]), item[order[a:b]].tolist()
                    doc_id = ids[at].as_py()
                    for j, score in zip(items, query.scores(texts[at].as_py(), items)):
                        if score >= least.value[j]:
                            best[j].append((-score, doc_id is not None, doc_id))
                for j, own in best.items():
                    if len(own) > 4 * k:
                        best[j] = sorted(own)[:k]
        rows = [(j, d, -s) for j, own in best.items() for s, _, d in sorted(own)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), id_type, pa.int64()))], ["item", "doc_id", "score"])

    return index.select("row", "width", "top", "n", "bits", "ids", "texts").mapInArrow(run, f"item bigint, doc_id {id_kind}, score bigint")


def search(index: DataFrame, items: DataFrame, scratch: Scratch, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by ascending doc_id."""
    spark = index.sparkSession
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            own = [(i, t) for i, v in enumerate(batch.column(1)) if v.is_valid for t in set(terms_of(v.as_buffer().to_pybytes()))]
            at = pa.array([i for i, _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([t for _, t in own], pa.binary())], ["item_id", "term"])

    pairs = scratch.write(items.select("item_id", F.col("text").cast("string")).mapInArrow(split, f"item_id {item_kind}, term binary").distinct())
    counts = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    blocks = -(-pairs.count() // TERMS) if counts["docs"] else 0
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {id_kind}, score bigint")
    for block in range(blocks):
        of = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        query = Query([(r["item_id"], bytes(r["term"])) for r in pairs.where(of).collect()])
        if not query.ids:
            continue
        query.weigh(_term_counts(index, spark.sparkContext.broadcast(query)), counts["docs"], counts["words"])
        shipped = spark.sparkContext.broadcast(query)
        least = spark.sparkContext.broadcast(_thresholds(index, shipped, k))
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = _answers(index, shipped, least, k, id_kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(query.ids)), f"item bigint, item_id {item_kind}")
        out = out.unionByName(scratch.write(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """search over an index of docs that is built for it and goes with it."""
    scratch = Scratch(docs.sparkSession)
    out = search(scratch.write(build_index(docs), **GROUPS), items, scratch, k)
    scratch.drop(keep=len(scratch.paths) - 2)  # all but the index and the items' terms
    return out
