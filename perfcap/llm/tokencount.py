"""Operator 10: token counts from distinct pre-tokens.

1. Each task splits its texts into pre-tokens and, per block of documents, turns them into postings: for a pre-token,
   the documents of the block that hold it and how often. Postings are packed per block and bucket of pre-tokens, so
   that a very common pre-token is a few bytes of each block and no row of its own.
2. Postings meet by bucket. There each distinct pre-token is given to the tokenizer once, and only the number of its
   pieces is kept; pieces times frequency is summed per document of each block. No ids of a text are ever made.
3. The partial sums of a block meet, and its documents come out. A block holds at most `BLOCK_DOCS` documents.

Null text counts as empty: 0 bytes, 0 tokens. Rows are counted one by one, so repeated rows give repeated results and
null ids stay null. Extra columns are not read. An empty table gives no rows.
"""

import zlib

import numpy as np
from pyspark.sql import DataFrame

from perfcap.llm.pretokens import load, word_level

#: A block ends at so many documents or characters. Distinct pre-tokens and sums that a task holds at most.
BLOCK_DOCS = 4_000
BLOCK_CHARS = 5_000_000
HELD = 1_000_000


class _Numbers(dict):
    """Numbers keys in the order they first come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _pack(texts: list, splitter, buckets: int):
    """(bucket, words, sizes, doc, n) of one block: a bucket's pre-tokens, how many documents each has, which, how often."""
    numbers, codes = _Numbers(), []
    for text in texts:
        words = splitter(text or "")
        codes.append(np.fromiter(map(numbers.__getitem__, words), "int64", len(words)))
    key = np.concatenate(codes) * len(texts) + np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    del codes
    key, n = np.unique(key, return_counts=True)
    token, doc = key // len(texts), (key % len(texts)).astype("<u2")
    raw = [w.encode("utf-8", "replace") for w in numbers]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), "int64", len(raw))
    order = np.argsort(bucket, kind="stable")
    first, last = (np.searchsorted(token, np.arange(len(raw)), side) for side in ("left", "right"))
    n = n.astype("<u4")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(raw) else []:
        size = last[part] - first[part]
        at = np.arange(size.sum()) + np.repeat(first[part] - (np.cumsum(size) - size), size)
        yield int(bucket[part[0]]), b"\n".join([raw[i] for i in part]), size.astype("<u4").tobytes(), doc[at].tobytes(), n[at].tobytes()


def postings(docs: DataFrame, path: str, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Packed postings of every block, and a head row (words null) with the block's ids and byte lengths."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        splitter, block, texts, ids, chars = word_level(path), TaskContext.get().partitionId() << 32, [], [], 0
        names = ["block", "bucket", "words", "sizes", "doc", "n", id_col, "n_bytes"]

        def close():
            known = pa.concat_arrays(ids)
            n_bytes = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([block % buckets], pa.int32()), *[pa.nulls(1, pa.binary())] * 4,
                 pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), known), pa.array([n_bytes], pa.list_(pa.int64()))], names)
            if rows := list(_pack(texts, splitter, buckets)):
                bucket, *packed = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(rows)), pa.array(bucket, pa.int32()), *[pa.array(p, pa.binary()) for p in packed],
                     pa.nulls(len(rows), pa.list_(known.type)), pa.nulls(len(rows), pa.list_(pa.int64()))], names)

        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_py())
                chars += len(texts[-1] or "")
                full = len(texts) >= BLOCK_DOCS or chars >= BLOCK_CHARS
                if full or i == batch.num_rows - 1:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    start = i + 1
                if full:
                    yield from close()
                    block, texts, ids, chars = block + 1, [], [], 0
        if texts:
            yield from close()

    schema = f"block bigint, bucket int, words binary, sizes binary, doc binary, n binary, `{id_col}` array<{kind}>, n_bytes array<bigint>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of each whole text under the tokenizer file `path`."""
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        import pyarrow as pa

        library, known, sums = load(path), {}, {}
        names = ["block", "sums", id_col, "n_bytes"]

        def close():
            for block, total in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([total.astype("<i8").tobytes()], pa.binary()),
                     pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.list_(pa.int64()))], names)

        for batch in batches:
            id_type = batch.column(6).type.value_type
            for row in range(batch.num_rows):
                block, _, words, sizes, doc, n = (batch.column(c)[row].as_py() for c in range(6))
                if words is None:
                    head = batch.slice(row, 1)
                    yield pa.RecordBatch.from_arrays([head.column(0), pa.nulls(1, pa.binary()), head.column(6), head.column(7)], names)
                    continue
                words = words.decode().split("\n")
                new = [w for w in words if w not in known]
                known.update(zip(new, map(len, library.encode_batch(new, add_special_tokens=False))))
                each = np.fromiter(map(known.__getitem__, words), "int64", len(words))
                of_doc = np.bincount(np.frombuffer(doc, "<u2"), np.repeat(each, np.frombuffer(sizes, "<u4")) * np.frombuffer(n, "<u4"), BLOCK_DOCS)
                sums[block] = sums.get(block, 0) + of_doc
                if len(sums) * BLOCK_DOCS > HELD:
                    yield from close()
                    sums = {}
                if len(known) > HELD:
                    known = {}
        yield from close()

    def total(table):
        import pyarrow as pa

        head = table.filter(table.column(id_col).is_valid()).combine_chunks()
        ids, n_bytes = head.column(id_col).chunk(0).flatten(), head.column("n_bytes").chunk(0).flatten()
        counts = np.zeros(BLOCK_DOCS, "int64")
        for sums in table.column("sums"):
            if sums.is_valid:
                counts += np.frombuffer(sums.as_buffer(), "<i8")
        return pa.table([ids, n_bytes, pa.array(counts[:len(ids)])], [id_col, "n_bytes", "n_tokens"])

    partial = (postings(docs, path, id_col, text_col, 8 * parts).repartition(parts, "bucket")
               .mapInArrow(pieces, f"block bigint, sums binary, `{id_col}` array<{kind}>, n_bytes array<bigint>"))
    return partial.groupBy("block").applyInArrow(total, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint")
