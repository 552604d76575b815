"""Operator 8: byte-pair encoding and decoding by a contiguous rank array.

A word is held as its parts and, in step with them, the ranks of adjacent parts. The smallest rank is merged: one
boundary goes, the two neighbouring ranks are looked up anew. Words of equal length go through this together as the
rows of two arrays, which lose a column each time; words over `SHORT` bytes go one by one, and words over `LONG` bytes
keep their ranks in a heap over linked parts, so that a very long unbroken text costs n log n and not n squared. Each
task merges a distinct word once while it is in its memo, which is emptied when it holds `MEMO` words.

Null text counts as empty: no ids, empty decoded text. Repeated rows give repeated results, null ids stay null, and
extra columns are not read. An empty table gives no rows. Special strings inside a text are one id each, and come
back as they were.
"""

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from perfcap.llm.pretokens import byte_alphabet, byte_level

SHORT = 28
LONG = 256
MEMO = 1_000_000
#: Characters of text whose words are held at a time.
BLOCK = 2_000_000
NONE = 1 << 30


class RankArray:
    """One vocabulary: merge ranks by pair of ids, the bytes of each id."""

    def __init__(self, path: str, long: int = LONG):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        back = byte_alphabet()
        self.long = long
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = [0] * 256
        for char, byte in back.items():
            self.byte_id[byte] = vocab[char]
        self.rank, self.made = {}, {}  # by pair of ids
        for i, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (vocab[left], vocab[right])
            if pair not in self.rank:
                self.rank[pair] = i
                self.made[pair] = vocab[left + right]
        pairs = sorted(self.rank)
        self.keys = np.array([left << 32 | right for left, right in pairs], "int64")
        self.key_rank = np.array([self.rank[p] for p in pairs], "int32")
        self.key_made = np.array([self.made[p] for p in pairs], "int32")
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in piece)
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        parts = [self.byte_id[b] for b in word.encode("utf-8", "surrogateescape")]
        if len(parts) > self.long:
            return self.encode_long(parts)
        rank = self.rank.get
        ranks = [rank(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[parts[i], parts[i + 1]]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NONE)
        return parts

    def pair_ranks(self, left, right):
        """Ranks and merged ids of arrays of pairs."""
        key = left.astype("int64") << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.key_rank[at], NONE), self.key_made[at]

    def encode_rows(self, parts):
        """Yields (row numbers, their ids) for an array with one word of equal length per row."""
        rows = np.arange(len(parts))
        ranks, made = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                yield rows, parts
                return
            i = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), i]
            ended = least == NONE
            if ended.any():
                yield rows[ended], parts[ended]
                go = ~ended
                rows, parts, ranks, made, i = rows[go], parts[go], ranks[go], made[go], i[go]
            n, width = parts.shape
            each = np.arange(n)
            parts[each, i] = made[each, i]
            keep = np.ones((n, width), bool)
            keep[each, i + 1] = False
            parts = parts[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[each, i] = False
            ranks, made = ranks[keep].reshape(n, width - 2), made[keep].reshape(n, width - 2)
            for at in (i - 1, i):
                on = np.flatnonzero((at >= 0) & (at < width - 2))
                col = at[on]
                ranks[on, col], made[on, col] = self.pair_ranks(parts[on, col], parts[on, col + 1])

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        out, by_length = {}, {}
        for word in words:
            raw = word.encode("utf-8", "surrogateescape")
            if len(raw) > SHORT or word in self.special:
                out[word] = self.encode_word(word)
            else:
                by_length.setdefault(len(raw), ([], []))
                by_length[len(raw)][0].append(word)
                by_length[len(raw)][1].append(raw)
        to_id = np.array(self.byte_id, "int32")
        for length, (group, raws) in by_length.items():
            parts = to_id[np.frombuffer(b"".join(raws), "uint8")].reshape(len(group), length)
            for rows, ids in self.encode_rows(parts):
                out.update(zip([group[r] for r in rows.tolist()], ids.tolist()))
        return out

    def encode_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = (parts[i], parts[after[i]])
                if (r := self.rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, i, *pair))

        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.made[left, right], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p >= 0]


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, memo: int = MEMO):
        self.words, self.split, self.limit = RankArray(path), byte_level(path), memo
        self.memo: dict[str, list[int]] = {}

    def encode_all(self, texts):
        """The ids of each text, in order; texts are taken in blocks of about `BLOCK` characters."""
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size > BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]):
        memo, split = self.memo, [self.split(t) for t in texts]
        if len(memo) > self.limit:
            memo.clear()
        memo.update(self.words.encode_words(list(set(chain.from_iterable(split)).difference(memo))))
        for words in split:
            yield list(chain.from_iterable(map(memo.__getitem__, words)))

    def decode(self, ids) -> str:
        return b"".join(map(self.words.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _id_type(docs: DataFrame, column: str) -> str:
    return docs.schema[column].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the ids of each whole text."""
    def run(batches):
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            ids = pa.array(list(codec.encode_all(v.as_py() for v in batch.column(1))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {_id_type(docs, id_col)}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the text of each array of ids; null ids: empty."""
    def run(batches):
        import pyarrow as pa

        codec = Codec(path)
        for batch in batches:
            texts = pa.array([codec.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {_id_type(encoded, id_col)}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes its ids in one pass.

    The ids of a text stay in its task; only their digest leaves it.
    """
    def run(batches):
        import pyarrow as pa

        codec = Codec(path)
        digits = [str(i) for i in range(len(codec.words.bytes_of))].__getitem__
        for batch in batches:
            n, coded, decoded = [], [], []
            for ids in codec.encode_all(v.as_py() for v in batch.column(1)):
                n.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{id_col}` {_id_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
