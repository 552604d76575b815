"""The document pipeline: each stage works on all that the one before it kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfcap.llm import bpe, decontam, lines, ngram_join, toxicity
from perfcap.llm.common import WORD, table, tokenizer_path
from perfcap.llm.tables import Scratch

TOXIC = 0.5
#: Share of its characters under which a document that lost repeated lines goes too: what is left of a copy.
LEFT = 0.3


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a number for each pair of id (null too) and text: stages drop rows by it, not by id alone."""
    return docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def as_ids(rows: DataFrame) -> DataFrame:
    """`_row` in place of the ids, for operators that answer with ids."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the classifier is fitted on the labelled ones that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    plain = [c for c in docs.columns if c != "score"]
    return toxicity.score(docs, model, plain).where(F.col("score") < TOXIC).select(plain)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines deleted; documents that keep no word, or under LEFT of their characters, go."""
    cut = lines.dedup_lines(docs.withColumn("_before", F.length("text")))
    rest = (F.col("n_deleted") > 0) & (~F.col("text").rlike(WORD) | (F.length("text") < LEFT * F.col("_before")))
    return cut.where(F.coalesce(~rest, F.lit(True))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles reach 0.8, the one with the smallest id of each component.

    A null id comes after all others. Rows that repeat id and text are one document; texts without words all stay.
    """
    rows, scratch = keyed(docs), Scratch(spark)
    linked = scratch.write(ngram_join.similar_components(as_ids(rows), n=5, num=80, den=100).withColumnsRenamed(
        {"doc_id": "_row", "component_id": "component"}).where("n_shingles > 0").groupBy("_row", "component").agg(F.count("*").alias("copies")))
    ids = rows.select("_row", "doc_id").distinct()
    first = linked.join(ids, "_row").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    gone = linked.join(first, "component").where("_row <> first._row").select("_row")
    kept = rows.join(gone, "_row", "left_anti")
    often = linked.where("copies > 1").select("_row")
    if often.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(often, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.join(often, "_row", "left_anti").unionByName(once).select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    The keys of those with one are written first: Spark knows their size when it plans the join, and texts stay where
    they are while the keys are few.
    """
    rows, scratch = keyed(docs), Scratch(spark)
    found = scratch.write(decontam.passages(as_ids(rows), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct())
    return rows.join(found, "_row", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every kept document, as digests."""
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("line dedup", lines_once), ("n-gram join", one_of_each_group),
          ("decontamination", without_benchmarks), ("bpe", encoded)]
#: SQL can express neither the network nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; what a stage keeps is written for the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
            scratch.drop(keep=1)
    return docs
