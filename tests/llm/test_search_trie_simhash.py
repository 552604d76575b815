"""Operators 11 to 13 against SQL and brute force, and their odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from perfcap.llm import prefix_trie, ranked_search, registry, simhash
from perfcap.llm.sql import SQL
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
LONG = "abcdefgh" * 4000 + " " + "x y " * 5000
TEXTS = ["alpha beta gamma delta", "Alpha BETA gamma delta", None, "", " \t\n ", "one", "one two", "one two three", LONG,
         "été ÉTÉ été, naïve", "alpha " * 9 + "beta", "alpha beta gamma delta epsilon"]


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_prefix_trie"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    mine = rows_of(df.columns, df.collect())
    assert mine and mine == rows_of(columns, result.fetchall())


# ranked search

def plain_ranking(docs, items, k):
    """Scores by the formula, in dictionaries."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    split = lambda t: find.findall((t or "").translate(lower))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    of = defaultdict(set)
    for i, t in items:
        of[i] |= set(split(t))
    out = []
    for item, terms in of.items():
        scored = []
        for d, c in counted:
            m = 50 + 50 * c.total() * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is not None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_ranking_odd_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "x", 2), (None, "alpha gamma", "y", 3), (None, "alpha gamma", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, item long")
    items = [(1, "alpha, beta; ALPHA"), (1, "été"), (2, None), (3, "--"), (None, "one x"), (4, "no such"), (5, LONG)]
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    for k in (3, 50):
        got = sorted((tuple(r) for r in ranked_search.rank_documents(docs, asked, k).collect()), key=repr)
        assert got == plain_ranking([r[:2] for r in rows], items, k)
    assert ranked_search.rank_documents(docs.where("false"), asked).collect() == []
    assert ranked_search.rank_documents(docs, asked.where("false")).collect() == []


def test_ranking_in_blocks_of_items(spark, monkeypatch):
    chance = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(chance.choices(words, weights=range(60, 0, -1), k=chance.randint(1, 80)))) for i in range(300)]
    items = [(i, " ".join(chance.choices(words, k=12))) for i in range(20)]
    monkeypatch.setattr(ranked_search, "TERMS", 60)
    got = ranked_search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
                                       spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_ranking(docs, items, 10)


def test_bounds_hold_and_exclude():
    chance = random.Random(2)
    words = [f"w{i}".encode() for i in range(3000)]
    texts = [b" ".join(chance.choices(words, k=60)) for _ in range(400)]
    held, known = [], ranked_search._Hash()
    for i, t in enumerate(texts):
        c = Counter(ranked_search.terms_of(t))
        held.append((i, t, c.total(), np.array([known[x] for x in c], "uint64"), np.array(list(c.values()))))
    _, _, top, n, bits, _, _ = ranked_search.index_row(512, held)
    query = ranked_search.Query([(j, w) for j in range(10) for w in chance.sample(words, 12)])
    query.weigh({i: 8 for i in range(len(query.terms))}, 400, 24000)
    bound = query.bounds(512, top, np.frombuffer(n, "int64"), bits)
    exact = np.array([query.scores(t, list(range(10))) for t in texts]).T
    assert (bound >= exact).all()
    assert (bound == exact).mean() > 0.6  # the levels leave little but false positives


# prefix trie

def plain_trie(rows):
    """The trie with tuples as keys."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        made[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += kids[p] == 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items()), key=repr)


def random_conversations(seed, n):
    chance = random.Random(seed)
    rows = []
    for c in [*range(n), *range(500, 500 + n), -3, 7_000_000_011]:
        for t in range(chance.randint(1, 9)):
            rows.append((c, chance.choice([t, t, t, None]), chance.choice(["user", "user", "assistant", None]), chance.choice(["a", "é b", "", None])))
    return rows + rows[:7]  # repeated rows


@pytest.mark.parametrize("slices", [(4096, 4096), (2, 3)])
def test_trie_equals_plain(spark, monkeypatch, slices):
    monkeypatch.setattr(prefix_trie, "SLICE", slices[0])
    rows = random_conversations(slices[1], 40) + [(None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, xa string")
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)
    assert got == plain_trie(rows)


def test_trie_hot_sequence_and_empty(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(6)] + [(900, t, "user", "same") for t in range(9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(df).collect()
    by = {(r["conv_id"], r["depth"]): r for r in got}
    assert by[0, 0]["n_convs"] == 301 and by[0, 6]["n_convs"] == 300 and by[900, 9000 - zlib.crc32(b"900") % 6 + zlib.crc32(b"900") % 6]["n_children"] == 0
    assert by[0, 6]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    assert prefix_trie.prefix_trie(df.where("false")).collect() == []


# SimHash

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, budget):
    at = list(range(len(fps)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    values = np.array(fps, "uint64")
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= budget).tolist():
            a, b = root(i), root(i + 1 + j)
            at[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("cap", [1 << 15, 4])
def test_simhash_equals_plain(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "CAP", cap)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(20_000 + i, r["text"] + " end" * i) for i, r in enumerate(docs[:40])]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fp long")).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    least = defaultdict(lambda: 1 << 60)
    parts = plain_components(fps, 2)
    for i, p in zip(ids, parts):
        least[p] = min(least[p], i)
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", least[p]) for i, f, p in zip(ids, fps, parts))


@pytest.mark.parametrize("limits", [(1 << 19, 32), (64, 1)])
def test_descend_finds_every_link(monkeypatch, limits):
    monkeypatch.setattr(simhash, "FRONTIER", limits[0])
    monkeypatch.setattr(simhash, "FEW", limits[1])
    chance = random.Random(1)
    centres = [chance.getrandbits(64) for _ in range(20)]
    values = {c ^ sum({1 << chance.randrange(64) for _ in range(chance.randint(0, 4))}) for c in centres for _ in range(40)} | {0, 1, 3, 7, 2**64 - 1}
    x = np.sort(np.array(sorted(values), "uint64"))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 2}
    got = [p for i, j in simhash.descend(x, None, 0, 0, 2) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want
    cut = int(np.searchsorted(x, np.uint64(1 << 63)))
    low, high = x[:cut], x[cut:]
    cross = [p for i, j in simhash.descend(low, high, 1, 1, 2) for p in zip(i.tolist(), (j + cut).tolist())]
    assert set(cross) == {(i, j) for i, j in want if i < cut <= j}


def test_simhash_odd_ids(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "only null here"), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert (None, 4) in got and (4, 4) in got and (None, None) in got and (2, 2) in got and (3, 2) in got
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_index_in_small_row_groups(spark, monkeypatch):
    """A task reads a row group at a time, so the index that a search reads has small ones, whatever its files hold."""
    docs = spark.range(0, 16, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(20_000)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), " ").alias("text"))
    items = docs.where("doc_id in (3, 7)").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 129).alias("text"))
    groups, drop = [], ranked_search.Scratch.drop

    def look(scratch, keep=0):
        for path in scratch.paths:
            for file in Path(path.removeprefix("file:")).glob("*.parquet"):
                of = pq.ParquetFile(file).metadata
                groups.extend(of.row_group(i).total_byte_size for i in range(of.num_row_groups))
        drop(scratch, keep)

    monkeypatch.setattr(ranked_search.Scratch, "drop", look)
    found = ranked_search.rank_documents(docs, items, k=1).collect()
    assert sorted((r["item_id"], r["doc_id"]) for r in found) == [(3, 3), (7, 7)]
    assert sum(groups) > 24 << 20 and max(groups) < 12 << 20
