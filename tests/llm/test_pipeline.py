"""The pipeline against its own stages' rules, from stage to stage."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perfcap.llm import decontam, toxicity
from perfcap.llm.tables import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_stages(spark):
    docs, scratch = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark)
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        kept.append((name, docs))
        docs = scratch.write(stage(spark, docs, SF))
        if name != "bpe":
            assert docs.columns == columns
    rows = [{r["doc_id"]: r for r in d.collect()} for _, d in [*kept, ("end", docs)]]
    model = toxicity.fit(kept[0][1], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(kept[0][1], model).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s < 0.5}
    seen: set = set()
    full = {i: rows[1][i]["text"] for i in rows[1]}
    assert all(len(r["text"]) >= corpus_pipeline.LEFT * len(full[i]) for i, r in rows[2].items())
    for i in sorted(rows[1]):  # no long line is there twice, and none is lost but with its document
        for line in rows[1][i]["text"].split("\n"):
            if len(line) >= 20:
                left = rows[2][i]["text"].split("\n") if i in rows[2] else []
                assert i not in rows[2] or (line in left) == (line not in seen) or line in left and rows[1][i]["text"].count(line) > 1
                seen.add(line)
    shingles = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, r in rows[2].items() for w in [r["text"].lower().split()]}
    ids = sorted(shingles)
    linked = {b for k, a in enumerate(ids) for b in ids[k + 1:] if shingles[a] and shingles[b] and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    assert set(rows[2]) - set(rows[3]) == linked
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {i for i, r in rows[3].items() for w in [" " + " ".join(decontam.words_of(r["text"])) + " "] if any(f" {' '.join(x)} " in w for x in items)}
    assert exact <= set(rows[3]) - set(rows[4])
    assert all(decontam.Items([(0, " ".join(x)) for x in items]).search([decontam.words_of(rows[3][i]["text"])]) for i in set(rows[3]) - set(rows[4]))
    assert {i: r["decoded_sha256"] for i, r in rows[5].items()} == {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in rows[4].items()}


PROSE = " ".join(f"word{i % 37} other{i % 11} thing{i}" for i in range(60))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, PROSE), (1, PROSE), (None, PROSE), (1, "another text " * 9), (3, None), (3, ""), (4, ""), (4, ""), (None, None),
       (5, PROSE + " and its end"), (7, "\n".join(f"own line number {i} of this text" for i in range(20))),
       (8, "\n".join(f"own line number {i} of this text" for i in range(17)) + "\nedited a\nedited b\nedited c")]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in ODD], COLUMNS)
    got = sorted(((r["doc_id"], r["text"]) for r in stage("n-gram join")(spark, docs, SF).collect()), key=repr)
    assert got == sorted([r for r in ODD[3:] if r[0] not in (5, 8)] + [(1, PROSE)], key=repr)
    cut = stage("line dedup")(spark, docs, SF)
    left = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=repr)
    assert [r for r in left if r[0] in (7, 8)] == [ODD[10]]  # three edited lines are not a document
    assert cut.columns == docs.columns and sum(t == PROSE for _, t in left) == 1
    assert sum(t is None for _, t in left) == 2 and sum(t == "" for _, t in left) == 3
    item = decontam.words_of(spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"])
    leak = " ".join(item)
    more = docs.unionByName(spark.createDataFrame([(i, leak, None, "s", len(leak)) for i in (None, 7)], COLUMNS))
    clean = sorted(((r["doc_id"], r["text"]) for r in stage("decontamination")(spark, more, SF).collect()), key=repr)
    assert clean == sorted(ODD, key=repr)  # a null id goes by its text, another text of the same id stays


def test_empty_and_all_stages(spark):
    docs, scratch = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in ODD], COLUMNS), Scratch(spark)
    empty = docs.where("false")
    for name, function in corpus_pipeline.STAGES:
        assert scratch.write(function(spark, empty, SF)).count() == 0
        docs = scratch.write(function(spark, docs, SF))
    assert docs.count() >= 7


def test_texts_stay_where_few_documents_leak(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 0, leak).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
        clean = stage("decontamination")(spark, docs, SF)
        plan = clean._jdf.queryExecution().executedPlan().toString()
        assert clean.count() == 2997
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
