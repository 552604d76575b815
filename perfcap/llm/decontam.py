"""Operator 5: benchmark passages in documents, by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts and items are words: lower case, without punctuation at their ends. A passage is a stretch of a document whose
word edit distance to the whole item is at most `RATE` of the item's words; a stretch may begin and end anywhere.

1. Windows. At every word of a document and for every item length n, the window of n words is looked at, unless it
   holds fewer than n - 1 - 2k pairs of neighbouring words that some item has too: k edits spoil at most 2k of an item's
   n - 1 pairs, so no passage is lost, and ordinary text has next to no windows left.
2. CGK embedding: a random walk reads a window of n words into 3n places, at each step staying on a word or going on by
   a random bit of (step, word). Windows at a small edit distance come out at a small Hamming distance.
3. Bit sampling: each of `REPEATS` walks has `SAMPLED` random places; windows and items that agree in all of them are
   candidates. The repeats reach the target recall, see `expected_recall` and the tests.
4. Candidates are verified by the edit distance of the item to the best stretch around the window.

Items are a query set: they are taken in blocks of `ITEMS`, each block against all documents, and only a block is
broadcast. Null or empty texts hold no passage; an item without words is in no document; rows that repeat a document
give repeated results, null ids stay. An empty table gives no rows. Extra columns are not read.
"""

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.2
REPEATS, SAMPLED = 40, 6
ITEMS = 20_000
#: Characters of text, and windows, that a task holds at a time.
BLOCK = 16_000_000
STARTS = 20_000

_WORDS = re.compile(r"\S+").findall
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡"


def words_of(text: str | None) -> list[str]:
    return [w for x in _WORDS((text or "").lower()) if (w := x.strip(_EDGES))]


def edits_allowed(n: int) -> int:
    return int(RATE * n)


def expected_recall(agree: float) -> float:
    """Chance that a passage whose embedding agrees with the item's in this share of places becomes a candidate."""
    return 1 - (1 - agree**SAMPLED) ** REPEATS


def _bits(seed: int, step: int, words):
    """A random bit of each word at a step of a walk."""
    x = words.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1000003 + step * 7919 + 1) & 0xFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40) & np.uint64(1)).astype("int64")


def walk(flat, start, steps: int, seed: int):
    """What a walk from each start reads at each step, and how far it has come: two arrays (steps, starts)."""
    at = np.zeros(len(start), "int64")
    words, come = np.empty((steps, len(start)), "int32"), np.empty((steps, len(start)), "int32")
    for step in range(steps):
        words[step] = flat[np.minimum(start + at, len(flat) - 1)]
        come[step] = at
        at = at + _bits(seed, step, words[step])
    return words, come


def sampled_keys(words, come, n: int, seed: int, own=slice(None)):
    """Keys of one repeat for windows of n words: the sampled places of their embedding, 0 where a walk has left."""
    places = np.random.default_rng([seed, n]).choice(max(1, 3 * n), min(SAMPLED, 3 * n), replace=False)
    key = np.full(len(words[0][own]), n, "uint64")
    for place in places:
        key = (key ^ np.where(come[place][own] < n, words[place][own], 0).astype("uint64")) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key


def edit_distance(item, text) -> tuple[int, int, int]:
    """Distance of the item to its best stretch of text, and where that begins and ends."""
    m = len(text)
    cost, begin = np.zeros(m + 1, "int64"), np.arange(m + 1)
    ramp = np.arange(m + 1)
    for word in item:
        change = cost[:-1] + (text != word)
        drop = cost + 1
        best, origin = drop.copy(), begin.copy()
        take = change <= best[1:]
        best[1:][take], origin[1:][take] = change[take], begin[:-1][take]
        low = np.minimum.accumulate(best - ramp)  # insertions: each place may follow a cheaper one to its left
        src = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        cost, begin = low + ramp, origin[src]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


class Items:
    """A block of items, ready for search."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.index: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in rows:
            if words := words_of(text):
                self.ids.append(item)
                self.words.append(np.array([self.index.setdefault(w, len(self.index) + 1) for w in words], "int64"))
        self.width = len(self.index) + 1
        pairs = [w[:-1] * self.width + w[1:] for w in self.words]
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, "int64")]))
        self.tables: dict[int, list] = {}  # by length: for each repeat sorted keys and the item of each
        for n in {len(w) for w in self.words}:
            own = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            flat, start = np.concatenate([self.words[i] for i in own]), np.arange(len(own)) * n
            self.tables[n] = []
            for seed in range(REPEATS):
                key = sampled_keys(*walk(flat, start, 3 * n, seed), n, seed)
                order = np.argsort(key, kind="stable")
                self.tables[n].append((key[order], own[order]))
        #: Pairs that a window of each length must share with an item, and how many different ones.
        self.least = {n: max(0, n - 1 - 2 * edits_allowed(n)) for n in self.tables}
        self.pairs_of = [np.unique(w[:-1] * self.width + w[1:], return_counts=True) for w in self.words]
        self.different = {n: min(len(p) for p, w in zip((x[0] for x in self.pairs_of), self.words) if len(w) == n) - 2 * edits_allowed(n) for n in self.tables}

    def alike(self, i: int, pairs) -> bool:
        """Whether pairs hold enough of the item's, each as often as the item has it."""
        mine, n = self.pairs_of[i]
        have = np.searchsorted(s := np.sort(pairs), mine, "right") - np.searchsorted(s, mine)
        return int(np.minimum(have, n).sum()) >= self.least[len(self.words[i])]

    def varied(self, n: int, start, shared):
        """The windows that hold as many different shared pairs as every item of their length keeps after its edits."""
        keep = []
        for k in range(0, len(start), STARTS):
            rows = np.sort(shared[start[k:k + STARTS, None] + np.arange(max(1, n - 1))], axis=1)
            different = (rows[:, 0] >= 0).astype("int64") + ((rows[:, 1:] != rows[:, :-1]) & (rows[:, 1:] >= 0)).sum(axis=1)
            keep.append(start[k:k + STARTS][different >= self.different[n]])
        return np.concatenate([*keep, np.zeros(0, "int64")])

    def codes(self, words: list[str]):
        """The number of each word, 0 where no item has it: four bytes a word."""
        return np.fromiter((self.index.get(w, 0) for w in words), "int32", len(words))

    def search(self, texts: list[list[str]]):
        """(text, item, distance, first word, end) of every passage; one row per text and item, the best."""
        return self.search_codes([self.codes(t) for t in texts])

    def search_codes(self, texts: list):
        """As `search`, of texts given as codes."""
        size = np.array([len(t) for t in texts], "int64")
        if not size.sum() or not self.words:
            return []
        flat = np.concatenate(texts).astype("int64")
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(texts), dtype="int32"), size)
        pair = flat[:-1] * self.width + flat[1:]
        near = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0) & (owner[:-1] == owner[1:]))
        hit = np.zeros(len(flat) + 1, bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair[near]), len(self.pairs) - 1)
            hit[near[self.pairs[at] == pair[near]] + 1] = True
            del at
        del near
        longest = max(self.tables)
        upto = np.append(np.cumsum(hit, dtype="int32"), np.full(longest, hit.sum(), "int32"))  # shared pairs that begin before a word
        shared = np.append(np.where(hit[1:-1], pair, -1), np.full(longest, -1))
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        dense = {}
        for n, least in self.least.items():
            # a passage may be cut short by the text's end: a window is as long as the text allows
            on = np.flatnonzero(upto[n - 1:n - 1 + len(flat)] - upto[:len(flat)] >= least)
            on = on[(ends[owner[on]] - on >= n - edits_allowed(n)) & ((flat[on] > 0) | (least == 0))]
            dense[n] = self.varied(n, on, shared)
        starts = np.unique(np.concatenate(list(dense.values())))
        seen = np.zeros(0, "int64")
        padded = np.append(flat, np.zeros(longest, "int64"))
        for k in range(0, len(starts), STARTS):
            chunk = starts[k:k + STARTS]
            of_length = {n: np.flatnonzero(np.isin(chunk, own, assume_unique=True)) for n, own in dense.items()}
            for seed in range(REPEATS):
                words, come = walk(padded, chunk, 3 * longest, seed)
                for n, tables in self.tables.items():
                    own = of_length[n]
                    keys, items = tables[seed]
                    key = sampled_keys(words, come, n, seed, own)
                    low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    on = np.flatnonzero(high > low)
                    if len(on):
                        many = high[on] - low[on]
                        at = np.arange(many.sum()) + np.repeat(low[on] - (np.cumsum(many) - many), many)
                        seen = np.append(seen, items[at] * len(flat) + np.repeat(chunk[own[on]], many))
                seen = np.unique(seen)
        done: dict[tuple[int, int], int] = {}
        for i, s in zip(*(x.tolist() for x in divmod(seen, len(flat)))):
            item, k, text = self.words[i], edits_allowed(len(self.words[i])), int(owner[s])
            if done.get((i, text), -1) >= s:
                continue  # inside a passage that is known
            if not self.alike(i, pair[s:s + len(item) + k]):
                continue
            first = int(ends[text] - size[text])
            a, b = max(first, s - k), min(int(ends[text]), s + len(item) + 2 * k)
            distance, begin, end = edit_distance(item, flat[a:b])
            if distance <= k:
                done[i, text] = a + end - 1
                row = (distance, a + begin - first, a + end - first)
                found[text, i] = min(found.get((text, i), row), row)
        return [(t, self.ids[i], *row) for (t, i), row in sorted(found.items())]


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word): the best passage of each item in each row that holds it.

    items: item_id, text.
    """
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    numbered = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-items.count() // ITEMS)))).alias("block"))
    out = None
    for block in range(max(1, -(-items.count() // ITEMS))):
        rows = [(r["item_id"], r["text"]) for r in numbered.where(F.col("block") == block).orderBy("item_id").collect()]
        shipped = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def run(batches, shipped=shipped):
            import pyarrow as pa

            def settle(texts, places, ids):
                rows = shipped.value.search_codes(texts)
                own = ids.take(pa.array([places[r[0]] for r in rows], pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [own, pa.array([r[1] for r in rows], item_type), *[pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)]],
                    ["doc_id", "item_id", "distance", "first_word", "end_word"])

            for batch in batches:
                texts, places, size = [], [], 0
                for i, value in enumerate(batch.column(1)):
                    text = value.as_py() or ""
                    texts.append(shipped.value.codes(words_of(text)))
                    places.append(i)
                    size += len(text)
                    if size > BLOCK:
                        yield settle(texts, places, batch.column(0))
                        texts, places, size = [], [], 0
                if texts:
                    yield settle(texts, places, batch.column(0))

        import pyarrow
        item_type = {"bigint": pyarrow.int64(), "int": pyarrow.int32()}.get(item_kind, pyarrow.string())
        found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, distance bigint, first_word bigint, end_word bigint")
        out = found if out is None else out.unionByName(found)
    return out
