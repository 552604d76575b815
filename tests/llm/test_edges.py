"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from perfcap.llm import bpe, chat, decontam, lines, ngram_join, passages, perplexity, tokencount, toxicity, urls
from perfcap.llm.common import tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PROSE = " ".join(f"word{i % 37} other{i % 11} thing{i}" for i in range(60))
LONG = "abcdefgh" * 4000 + " " + "x y " * 5000
ROWS = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, PROSE), (4, LONG), (5, " \t\n "), (6, "one"), (7, PROSE + "\n" + PROSE)]
SCHEMA = ("doc_id long, text string, lang string, source string, node long, block string, component string, score double, "
          "line int, n int, host string, ids string, bucket int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "s", *[None] * 9) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (6, None), (None, 1), (3, 0)], "doc_id long, toxic int")


OPERATORS = {
    "perplexity": lambda d, spark: perplexity.judge(d),
    "passages": lambda d, spark: passages.repeated_passages(d),
    "decontam": lambda d, spark: decontam.passages(d, spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "a")], "item_id long, text string")),
    "ngram": lambda d, spark: ngram_join.similar_components(d),
    "bpe": lambda d, spark: bpe.round_trip(d, BYTE),
    "lines": lambda d, spark: lines.dedup_lines(d),
    "tokens": lambda d, spark: tokencount.count_tokens(d, WORD),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.where("false"), spark).collect() == []


def test_perplexity(docs, spark):
    got = [r for r in OPERATORS["perplexity"](docs, spark).collect()]
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_words"] == by[3]["n_words"] == by[5]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert len({tuple(r)[1:] for r in got if r["doc_id"] == 1}) == 1
    assert by[4]["n_words"] == 10001 and by[4]["base_failed"]


def test_passages(docs, spark):
    got = OPERATORS["passages"](docs, spark).collect()
    assert {r["doc_id"] for r in got} == {None, 1, 4, 7} - ({4} if all(r["doc_id"] != 4 for r in got) else set())
    assert all(r["kept_doc_id"] is None for r in got if r["doc_id"] == 1)  # a null id sorts first


def test_decontam(docs, spark):
    got = sorted({(r["doc_id"] or 0, r["item_id"], r["distance"]) for r in OPERATORS["decontam"](docs, spark).collect()})
    assert [g for g in got if g[1] == 1] == [(0, 1, 0), (1, 1, 0), (7, 1, 0)]


def test_ngram(docs, spark):
    got = OPERATORS["ngram"](docs, spark).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[5] == (0, 5) and by[6] == (1, 6) and by[1][1] == by[None][1] == 1


def test_bpe_and_counts(docs, spark):
    from tokenizers import Tokenizer

    coded = OPERATORS["bpe"](docs, spark).collect()
    counted = OPERATORS["tokens"](docs, spark).collect()
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    text = {i: t or "" for i, t in ROWS}
    assert len(coded) == len(counted) == len(ROWS)
    for r in coded:
        ids = byte.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    for r in counted:
        assert (r["n_bytes"], r["n_tokens"]) == (len(text[r["doc_id"]].encode()), len(word.encode(text[r["doc_id"]], add_special_tokens=False).ids))


def test_lines(docs, spark):
    got = OPERATORS["lines"](docs, spark)
    assert set(docs.columns) <= set(got.columns)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[2]["text"] is None and by[2]["n_lines"] == 0 and by[3]["text"] == "" and by[3]["n_lines"] == 1
    assert by[None]["n_deleted"] == 0 and by[1]["n_deleted"] == 1 and by[1]["text"] == "" and by[7]["n_deleted"] == 2


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs.where("false"), model).collect() == [] and toxicity.fit(docs, labels.where("false")) is None
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 5)}) == 1


def test_urls(spark):
    urls_in = ["http://A.Org/x", None, "no url", "https://h.com", "http://x.example.org/es/1?q", "ftp://com/fr/", "http://a.com/de/x#y", "://", "http://example.org/en/12",
               "http://h.net/" + "a/" * 5000, "http://A.Org/x"]
    pages = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate(urls_in)], "page_id long, url string, template string")
    labels = spark.createDataFrame([(3, True), (3, False), (None, True)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    assert len(got) == len(urls_in)
    assert (got[None]["host"], got[None]["path"], got[None]["rule"], got[None]["verdict"]) == ("a.org", "/x", "org/", "allow")
    assert [(got[i]["host"], got[i]["path"]) for i in (1, 2, 3, 7)] == [("", ""), ("", ""), ("h.com", ""), ("", "")]
    assert [got[i]["rule"] for i in (4, 5, 6, 8)] == ["example.org/es/", "com/fr/", "com/de/", "example.org/en/1"]
    assert got[9]["template"].endswith("/**")
    assert urls.judge(pages.where("false"), labels).collect() == []
    assert {r["verdict"] for r in urls.judge(pages.where("url like '%h.net%'"), labels.where("false")).collect()} == {"allow"}


def test_url_rules(spark):
    """Each rule's word, where no label says otherwise and where all labels do."""
    words = {"http://a.org/x": "allow", "http://example.org/es/1": "block", "http://example.org/en/12": "block", "http://a.example.org/en/1": "block",
             "http://example.org/en/2": "allow", "http://a.com/fr/": "allow", "http://com/de/x": "block"}
    pages = spark.createDataFrame(list(enumerate(words)), "page_id long, url string")
    for bad in ([None], [False], [True]):
        labels = spark.createDataFrame([(i, b) for i in range(len(words)) for b in bad], "page_id long, bad boolean")
        assert {i: r["verdict"] for i, r in ((r["page_id"], r) for r in urls.judge(pages, labels).collect())} == dict(enumerate(words.values()))


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|>\n[x] &lt; &amp;"), (1, 1, "assistant", None), (None, None, None, "x"), (1, 1, "assistant", None), (2, 0, "a\nb", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9)).withColumn("kind", F.lit("z"))
    out = chat.read_back(chat.render(chat.fold(chat.as_events(table)))).collect()
    turns = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out}
    assert turns == {1: [("user", rows[0][3]), ("assistant", ""), ("assistant", "")], None: [("", "x")], 2: [("a\nb", "")]}
    assert chat.digests(chat.read_back(chat.render(chat.fold(chat.as_events(table.where("false")))))).collect() == []
