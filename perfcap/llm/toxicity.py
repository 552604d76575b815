"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its dictionary entry (unlisted words share one), the entry's log-odds in the labelled
sample (while a document trains, those of the other folds), and the mean embedding of its hashed character trigrams. Two gated recurrent layers
read a window of `WINDOW` words from both ends, attention pools their states, and a document scores as its highest
window; windows overlap and cover every word. Training sees whole documents too: the gradient flows through the window
that scores highest.

The classifier is fitted on the driver on a bounded sample: up to `TRAIN_TOXIC` and `TRAIN_CLEAN` labelled rows, in
order of a hash of their id, of at most `TRAIN_CHARS` characters each; weights restore the share of the two classes. Its
size is bounded by `DICTIONARY` and `TRIGRAMS`. Everything else runs over all rows, in tasks.

Null and empty texts score as a window without words. Repeated rows score alike, null ids stay null, labels of one id
that disagree count as toxic, extra columns are not read. Without labels of both kinds every score is 0. An empty table
gives no rows.
"""

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 6, 6, 8
DICTIONARY, TRIGRAMS = 20_000, 4096
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 2500, 4000
STEPS, FROZEN, BATCH, RATE, DECAY, FOLDS = 160, 110, 128, 0.015, 0.02, 5
#: Characters of text, and windows, that a task holds at a time.
BLOCK, ROWS = 3_000_000, 4096

_WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _trigrams(words: list[str]):
    """Bucket of every character trigram of `^word$`, and where each word's trigrams begin."""
    joined = "".join(f"^{w}$" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le"), "uint32").astype("uint64")
    size = np.array([len(w) + 2 for w in words], "int64")
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return (mixed % np.uint64(TRIGRAMS)).astype("int64")[inside[:-2]], np.concatenate([[0], np.cumsum(size - 2)[:-1]]), size - 2


def _windows(lengths):
    """Start, end of each window over texts laid end to end, and the text it belongs to."""
    lengths = np.asarray(lengths, "int64")
    count = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), count)
    first = np.cumsum(lengths) - lengths
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = first[owner] + STRIDE * k
    return start, np.minimum(start + WINDOW, first[owner] + lengths[owner]), owner


@dataclass
class Model:
    index: dict = field(default_factory=dict)  # word -> row of the dictionary; row 0: all others
    p: dict = field(default_factory=dict)  # parameters by name

    @classmethod
    def fresh(cls, index: dict, odds, seed: int = 7) -> "Model":
        rnd = np.random.default_rng(seed)
        width = WORD_DIM + 1 + CHAR_DIM
        make = lambda *shape, by=0.3: (rnd.standard_normal(shape) * by).astype("float32")
        p = {"word": make(len(odds), WORD_DIM, by=0.05), "odds": odds, "char": make(TRIGRAMS, CHAR_DIM, by=0.05),
             "att": make(2 * HIDDEN, ATTENTION), "att_v": make(ATTENTION), "out": make(2 * HIDDEN), "bias": np.full(1, -2, "float32")}
        for d in "fb":
            p |= {f"x{d}": make(width, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, "float32"), f"h{d}": make(HIDDEN, 3 * HIDDEN)}
        return cls(index, p)

    def describe(self, words: list[str]):
        """Dictionary rows and trigrams of distinct words: rows, trigrams end to end, where a word's begin, how many."""
        return np.fromiter((self.index.get(w, 0) for w in words), "int64", len(words)), *_trigrams(words)

    def inputs(self, described):
        """Vectors of described words."""
        rows, grams, begin, size = described
        char = np.add.reduceat(self.p["char"][grams], begin, axis=0) / size[:, None].astype("float32")
        return np.hstack([self.p["word"][rows], self.p["odds"][rows], char])

    def states(self, d: str, projected, at, mask, keep: list | None = None):
        """States of one direction, (rows, WINDOW, HIDDEN)."""
        h, out = np.zeros((len(at), HIDDEN), "float32"), np.empty((len(at), WINDOW, HIDDEN), "float32")
        for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
            g, u = projected[at[:, t]], h @ self.p[f"h{d}"]
            zr = _sigmoid(g[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
            on = mask[:, t, None]
            new = np.where(on, n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * HIDDEN:], on))
            h = out[:, t] = new
        return out

    def forward(self, projected: dict, at, mask, keep: dict | None = None):
        """A logit per window."""
        runs = {d: [] if keep is not None else None for d in "fb"}
        both = np.concatenate([self.states(d, projected[d], at, mask, runs[d]) for d in "fb"], axis=2)
        seen = np.tanh(both @ self.p["att"])
        weight = np.where(mask, np.exp(np.clip(seen @ self.p["att_v"], -30, 30)), 0)
        weight = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * both).sum(axis=1)
        if keep is not None:
            keep |= {"runs": runs, "both": both, "seen": seen, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def project(self, x) -> dict:
        return {d: x @ self.p[f"x{d}"] + self.p[f"b{d}"] for d in "fb"}

    def gradients(self, x, info, at, mask, keep: dict, slope) -> dict:
        """Gradients of all parameters for the slope of the loss in each window's logit."""
        p, both, weight, seen = self.p, keep["both"], keep["weight"], keep["seen"]
        g = {"out": keep["pooled"].T @ slope, "bias": np.array([slope.sum()], "float32")}
        to_pool = slope[:, None] * p["out"]
        to_both = weight[:, :, None] * to_pool[:, None, :]
        to_weight = (both * to_pool[:, None, :]).sum(axis=2)
        to_score = weight * (to_weight - (weight * to_weight).sum(axis=1, keepdims=True))
        g["att_v"] = np.einsum("bt,btk->k", to_score, seen)
        to_seen = to_score[:, :, None] * p["att_v"] * (1 - seen * seen)
        g["att"] = np.einsum("bth,btk->hk", both, to_seen)
        to_both = to_both + to_seen @ p["att"].T
        to_x = np.zeros_like(x)
        for d, part in (("f", to_both[:, :, :HIDDEN]), ("b", to_both[:, :, HIDDEN:])):
            to_proj = np.zeros((len(x), 3 * HIDDEN), "float32")
            g[f"h{d}"], back = np.zeros_like(p[f"h{d}"]), np.zeros((len(at), HIDDEN), "float32")
            for t, h, z, r, n, un, on in reversed(keep["runs"][d]):
                to_new = back + part[:, t]
                live = np.where(on, to_new, 0)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                to_u = np.hstack([dz, dr, dn * r])
                np.add.at(to_proj, at[:, t], np.hstack([dz, dr, dn]))
                g[f"h{d}"] += h.T @ to_u
                back = np.where(on, live * z, to_new) + to_u @ p[f"h{d}"].T
            g[f"x{d}"], g[f"b{d}"] = x.T @ to_proj, to_proj.sum(axis=0)
            to_x += to_proj @ p[f"x{d}"].T
        rows, grams, _, size = info
        for name, a, b in (("word", 0, WORD_DIM), ("odds", WORD_DIM, WORD_DIM + 1)):
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], rows, to_x[:, a:b])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], grams, np.repeat(to_x[:, WORD_DIM + 1:] / size[:, None].astype("float32"), size, axis=0))
        return g

    def place(self, described, flat, lengths):
        """Projections of the described words, and the words and mask of every window, with the text it belongs to."""
        x = self.inputs(described)
        start, end, owner = _windows(lengths)
        place = start[:, None] + np.arange(WINDOW)
        mask = place < end[:, None]
        at = flat[np.minimum(place, len(flat) - 1)] if len(flat) else np.zeros_like(place)
        return x, self.project(x), at, mask, owner

    def windows(self, projected, at, mask):
        return np.concatenate([self.forward(projected, at[i:i + ROWS], mask[i:i + ROWS]) for i in range(0, len(at), ROWS)])

    def score_texts(self, texts: list[list[str]]):
        """The highest window logit of each text."""
        number = _Numbers()
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), "int64", sum(map(len, texts)))
        _, projected, at, mask, owner = self.place(self.describe(list(number) or ["-"]), flat, [len(t) for t in texts])
        return np.maximum.reduceat(self.windows(projected, at, mask), np.searchsorted(owner, np.arange(len(texts))))


class _Numbers(dict):
    """Numbers keys in the order they first come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def train(texts: list[list[str]], toxic, weight, steps: int = STEPS, seed: int = 7) -> Model:
    """A fitted model of tokenised texts."""
    toxic, weight = np.asarray(toxic, "float32"), np.asarray(weight, "float32")
    rnd = np.random.default_rng(seed)
    fold = rnd.permutation(len(texts)) % FOLDS
    holds = [[Counter() for _ in range(FOLDS)] for _ in range(2)]  # documents with a word, by label and fold
    for words, bad, k in zip(texts, toxic, fold):
        holds[int(bad)][k].update(set(words))
    total = [sum(c, Counter()) for c in holds]
    shared = [w for w, n in (total[0] + total[1]).items() if n > 1]

    def odds(left_out: int | None = None):
        """Standardised log-odds of the shared words; a document's own fold is left out while it trains."""
        ids = np.ones(len(texts), bool) if left_out is None else fold != left_out
        a = np.clip(toxic[ids].mean(), 0.01, 0.99)
        no, yes = (np.array([total[y][w] - (holds[y][left_out][w] if left_out is not None else 0) for w in shared], "float64") + 0.5 for y in (0, 1))
        return (np.log(yes / no) - np.log(a / (1 - a))) / np.sqrt(1 / yes + 1 / no)

    z = odds()
    order = sorted(range(len(shared)), key=lambda i: (-abs(z[i]), shared[i]))[:DICTIONARY - 1]
    given = lambda z: np.concatenate([[0], np.clip(np.sign(z[order]) * np.maximum(np.abs(z[order]) - 2, 0), -3, 3)]).astype("float32")[:, None]
    by_fold = [given(odds(k)) for k in range(FOLDS)]
    index = {shared[i]: k + 1 for k, i in enumerate(order)}
    model = Model.fresh(index, given(z), seed)
    moments, deals, number = {}, [[] for _ in range(FOLDS)], _Numbers()
    coded = [np.fromiter(map(number.__getitem__, words), "int64", len(words)) for words in texts]
    rows, grams, begin, size = model.describe(list(number) or ["-"])
    for step in range(1, steps + 1):
        k = step % FOLDS
        members = np.flatnonzero(fold == k)
        if not len(members):
            continue
        if len(deals[k]) < min(BATCH, len(members)):
            deals[k] = rnd.permutation(members).tolist()
        pick, deals[k] = deals[k][:BATCH], deals[k][BATCH:]
        model.p["odds"] = by_fold[k]
        used, flat = np.unique(np.concatenate([coded[k] for k in pick]), return_inverse=True)
        used = used if len(used) else np.zeros(1, "int64")
        ends = np.cumsum(size[used])
        info = (rows[used], grams[np.arange(ends[-1]) + np.repeat(begin[used] - (ends - size[used]), size[used])], ends - size[used], size[used])
        x, projected, at, mask, owner = model.place(info, flat, [len(coded[k]) for k in pick])
        logits = model.windows(projected, at, mask)
        top = np.lexsort((-logits, owner))[np.searchsorted(owner, np.arange(len(pick)))]
        keep: dict = {}
        logit = model.forward(projected, at[top], mask[top], keep)
        slope = ((_sigmoid(logit) - toxic[pick]) * weight[pick] / weight[pick].sum()).astype("float32")
        for name, g in model.gradients(x, info, at[top], mask[top], keep, slope).items():
            if name == "odds" or step <= FROZEN and name in ("word", "char"):
                continue
            m, v = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            model.p[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype("float32")
            if name in ("word", "char"):
                model.p[name] *= 1 - DECAY
    model.p["odds"] = given(z)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled rows that are not held out; labels: doc_id, toxic. None without both kinds."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order, "doc_id").limit(TRAIN_TOXIC).unionByName(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(TRAIN_CLEAN))
    rows = (docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS)
            .join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
            .dropDuplicates(["doc_id"]).orderBy("doc_id").limit(TRAIN_TOXIC + TRAIN_CLEAN).collect())
    toxic = [r["toxic"] for r in rows]
    if len(set(toxic)) < 2:
        return None
    weight = [share[y] / toxic.count(y) for y in toxic]
    return train([words_of(r["text"]) for r in rows], toxic, weight)


def score(docs: DataFrame, model: Model | None, carried: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (doc_id by default) and `score`, for every row; a carried `score` is not allowed."""
    carried = carried or ["doc_id"]
    if model is None:
        return docs.select(*carried, F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*carried, F.col("text").alias("__text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores, block, size = [], [], 0
            for value in batch.column(batch.num_columns - 1):
                text = value.as_py()
                block.append(words_of(text))
                size += len(text or "")
                if size > BLOCK:
                    scores.append(shipped.value.score_texts(block))
                    block, size = [], 0
            if block:
                scores.append(shipped.value.score_texts(block))
            logits = np.concatenate(scores).astype("float64") if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_sigmoid(logits))], [*carried, "score"])

    schema = own.drop("__text").schema.add("score", "double")
    return own.mapInArrow(run, schema)
