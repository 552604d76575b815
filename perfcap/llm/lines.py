"""Operator 9: repeated runs of lines, found in a suffix array over line ids. DataFrame functions only.

The texts are sequences of line ids (two 64-bit hashes of a line). Prefix doubling sorts the suffixes by their first
1, 2, 4, ... lines: a suffix has the rank (line id, offset) of the class of suffixes that share this prefix, and a step
refines every class by the ranks of the suffixes 2^k lines further on. Within a class the offset grows by the number of
suffixes with a smaller continuation, so ranks stay ordered without a global sort. A class of two or more suffixes after
k steps is an interval of the suffix array whose common prefix has 2^k lines at least; only its suffixes go on, as a
suffix that stands alone shares nothing longer with any other. Continuations are counted before they are shuffled, so
that a class with a third of all lines is a few rows per task.

Deleted are later copies: of every interval, all windows of 2^k lines but the first in order of document and line.
Later windows of one length that share lines are one run; its lines go if the run has `min_chars` characters or more. The
windows of a maximal repeat overlap where it is longer than one of them, so every maximal repeat that is long enough goes
as a whole, save its first copy. Runs do not cross documents.

A null text stays null and has no lines; an empty text has one empty line. Documents are told apart by id and text:
rows that repeat both are one document and are cut alike; of different texts under one id (null too) each is its own. A
document may lose all its lines: its text is then empty. Extra columns are kept. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfcap.llm.tables import Scratch

MIN_CHARS = 20
CLASS = ["h1", "h2", "offset"]
PLACE = ["doc_id", "copy", "line"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, line, chars, h1, h2) of every line of every text."""
    rows = docs.select("doc_id", "copy", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return rows.select(*PLACE, F.length("body").alias("chars"), F.xxhash64(F.lit(1), "body").alias("h1"), F.xxhash64(F.lit(2), "body").alias("h2"))


def _classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Members and first place of each class of two or more rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("members"), F.min(F.struct(*PLACE)).alias("first")).where("members > 1")


def repeated_windows(docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For k = 0, 1, ...: suffixes in intervals of 2^k lines, with rank, first place and characters of the window.

    upto: characters of all repeated lines of the document up to the window's last line.
    """
    lines = _lines(docs)
    keys = ["h1", "h2"]
    so_far = F.sum("chars").over(Window.partitionBy("doc_id", "copy").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    level = scratch.write(lines.join(_classes(lines, keys), keys).withColumn("offset", F.lit(0).cast("long"))
                          .select(*PLACE, *CLASS, "first", F.col("chars").cast("long").alias("chars"), so_far.alias("upto")))
    levels, length = [level], 1
    while True:
        of_doc = Window.partitionBy("doc_id", "copy").orderBy("line").rangeBetween(length, length)
        after = F.first(F.struct(*CLASS, "chars", "upto")).over(of_doc)
        pairs = level.withColumn("next", after).where("next is not null").select(
            *PLACE, *CLASS, F.struct("next.h1", "next.h2", "next.offset").alias("next"),
            (F.col("chars") + F.col("next.chars") + 1).alias("chars"), F.col("next.upto").alias("upto"))
        counted = _classes(pairs, [*CLASS, "next"])
        smaller = F.sum("members").over(Window.partitionBy(*CLASS).orderBy("next").rowsBetween(Window.unboundedPreceding, -1))
        named = counted.withColumn("more", F.coalesce(smaller, F.lit(0)))
        level = scratch.write(pairs.join(named, [*CLASS, "next"]).select(
            *PLACE, "h1", "h2", (F.col("offset") + F.col("more")).alias("offset"), "first", "chars", "upto"))
        if level.isEmpty():
            return levels
        levels.append(level)
        length *= 2


def _islands(spans: DataFrame, by: list[str], gap: int) -> DataFrame:
    """spans (a, b) with the number of their island: spans that share a line (gap 0), or touch too (gap 1)."""
    order = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("a") > reach + gap)).cast("int"))
    return marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def deletions(levels: list[DataFrame], min_chars: int) -> DataFrame:
    """(doc_id, copy, ranges array<struct<a, b>>): the lines that go, as ranges without overlap."""
    runs, of = None, ["doc_id", "copy"]
    for k, level in enumerate(levels):
        later = level.where(F.struct(*PLACE) > F.col("first")).select(
            *of, F.col("line").alias("a"), (F.col("line") + 2**k - 1).alias("b"), "upto", (F.col("upto") - F.col("chars") + 2**k - 1).alias("before"))
        if k:
            later = _islands(later, of, 0).groupBy(*of, "island").agg(
                F.min("a").alias("a"), F.max("b").alias("b"), F.max("upto").alias("upto"), F.min("before").alias("before"))
        long = later.where(F.col("upto") - F.col("before") + F.col("b") - F.col("a") >= min_chars).select(*of, "a", "b")
        runs = long if runs is None else runs.unionByName(long)
    ranges = _islands(runs, of, 1).groupBy(*of, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return ranges.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def _kept(text: Column, ranges: Column) -> Column:
    """The lines between the ranges, which are in order."""
    def between(x):
        start = F.concat(F.array(F.lit(0)), F.transform(x["ranges"], lambda r: r["b"] + 1))
        end = F.concat(F.transform(x["ranges"], lambda r: r["a"]), F.array(F.size(x["lines"])))
        return F.flatten(F.zip_with(start, end, lambda s, e: F.slice(x["lines"], s + 1, F.greatest(e - s, F.lit(0)))))

    once = F.array(F.struct(F.split(text, "\n").alias("lines"), ranges.alias("ranges")))
    return F.array_join(F.get(F.transform(once, between), F.lit(0)), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of docs with `text` cut, and n_lines and n_deleted (long).

    Column names of docs that clash with these two are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    content = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", content.alias("copy"))
    spans = scratch.write(deletions(repeated_windows(keyed, scratch), min_chars))
    scratch.drop(keep=1)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"), F.col("ranges").alias("__ranges"))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (content == F.col("__copy")), "left")
    gone = F.aggregate("__ranges", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1)
    return (joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
            .withColumn("n_deleted", F.coalesce(gone, F.lit(0)).cast("long"))
            .withColumn("text", F.when(F.col("__ranges").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("__ranges"))))
            .drop("__id", "__copy", "__ranges"))
