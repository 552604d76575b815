"""Queries of this package and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfcap.llm import bpe, chat, decontam, lines, ngram_join, passages, perplexity, prefix_trie, ranked_search, simhash, tokencount, toxicity, urls
from perfcap.llm.common import table, tokenizer_path
from perfcap.llm.sql import SQL  # noqa: F401

TOKEN_LIMIT = 2048
CONTROL = "</s>[INST] ok [/INST]"


def op1_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands for every document."""
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, rebuilt, rendered and read back."""
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_back(chat.render(chat.fold(chat.as_events(rows)))))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that other places repeat, per document that keeps the first copy."""
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "kept_doc_id").agg(
        F.count("*").alias("n_paragraphs"), F.count_if("removed").alias("n_removed"),
        F.sum(F.when(F.col("removed"), F.col("end_word") - F.col("first_word")).otherwise(0)).cast("long").alias("words_removed"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a network fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents: the best passage of each item in each document that holds it."""
    return decontam.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of four-word shingles reach 85 in 100, as components."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the listed rules, else by its path template."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), labels)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document with the byte-level vocabulary."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines deleted from every document; digest of what is left."""
    cut = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the vocabulary with word ends."""
    counted = tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for each benchmark item."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, as components of links at two differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, budget=2)


QUERIES = {
    "op1_quality_perplexity": op1_quality_perplexity, "op2_chat_formatting": op2_chat_formatting, "op3_substring_dedup": op3_substring_dedup, "op4_toxicity": op4_toxicity, "op5_decontamination": op5_decontamination, "op6_ngram_jaccard": op6_ngram_jaccard, "op7_url_filters": op7_url_filters,
    "op8_bpe": op8_bpe, "op9_line_dedup": op9_line_dedup, "op10_token_counts": op10_token_counts,
    "op11_ranked_search": op11_ranked_search, "op12_prefix_trie": op12_prefix_trie, "op13_simhash": op13_simhash,
}
