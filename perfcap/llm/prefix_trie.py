"""Operator 12: the trie of all conversations' prefixes, from whole sequences with weights.

1. Turns are numbered within their conversation and rebuilt: the first turns come from the conversation that opens the
   hundred (`SHARED` of them at most, by a checksum of the id), the others are the conversation's own.
2. A prefix is known by its depth and 120 bits: the digests of its turns, bound to their places, joined by exclusive or.
   Identical rebuilt conversations collapse into one sequence with a weight; their ids are its end list.
3. Sequences that are proper prefixes of others go by an anti-join; the rest are the leaves.
4. Every distinct sequence gives one row per prefix, with its weight: their sums are the nodes. A node's own share of
   saved text is counted on the sequence of its smallest member alone, so that sums along that sequence, from its end
   to each depth, add up to the totals of whole subtrees: rows stay as many as the turns of distinct sequences.

Only digests and lengths of texts are shuffled. Running values over a conversation are taken by slices of `SLICE` turns
with a carry, the end lists are hashed piece by piece in order: neither a long conversation nor a large group of copies
is held by one task.

Turns are ordered by turn (null first), role and MD5 of the text; null role or text is empty; repeated rows are turns of
their own. Rows without conv_id are not read. An empty table gives no rows. Extra columns are not read.
"""

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfcap.llm.tables import Scratch

SHARED = 5
SLICE = 4096
#: Ids of an end list that are hashed at a time.
PIECE = 4096
NODE = ["depth", "xa", "xb"]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _half(digest, at: int):
    """60 bits of a hexadecimal digest as a long."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, r, fa, fb, chars): turns numbered from 1, the two halves of their digest, code points of their text.

    Ranges of (conv_id, order) are numbered by themselves; a conversation that spans several carries its count on.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["turn", "role", "digest"]
    rows = scratch.write(own.repartitionByRange(_partitions(own), "conv_id", *order).withColumn("part", F.spark_partition_id()))
    both = F.md5(F.concat_ws(":", F.length("role"), "role", "digest"))
    local = rows.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long"))
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("conv_id", "part", F.sum("n").over(earlier).alias("before")).where("before is not null")
    return (local.join(carry, ["conv_id", "part"], "left")
            .select("conv_id", (F.col("r") + F.coalesce("before", F.lit(0))).alias("r"), _half(both, 1).alias("fa"), _half(both, 16).alias("fb"), "chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, fa, fb, chars) of the rebuilt conversations, and (conv_id) of all of them."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = n.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).alias("h"))
    convs = convs.join(n.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    own = turns.join(convs, "conv_id").where("r > h").select("conv_id", (F.col("r") - F.col("h") + F.col("taken")).alias("pos"), "fa", "fb", "chars")
    opening = turns.where(F.col("r") <= SHARED).withColumnRenamed("conv_id", "base")
    shared = opening.join(convs, "base").where("r <= h").select("conv_id", F.col("r").alias("pos"), "fa", "fb", "chars")
    return own.unionByName(shared), convs.select("conv_id")


def running(df: DataFrame, key: str, at: str, sums: dict) -> DataFrame:
    """df with running aggregates along `at` (0, 1, ... within key): sums has name -> (function, column)."""
    cut = df.withColumn("_slice", F.floor(F.col(at) / SLICE))
    here = Window.partitionBy(key, "_slice").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(key, "_slice").agg(*[f(c).alias(f"_{name}") for name, (f, c) in sums.items()])
    carry = whole.select(key, "_slice", *[f(F.col(f"_{name}")).over(earlier).alias(f"_{name}") for name, (f, _) in sums.items()]).where("_slice > 0")
    out = cut.withColumns({name: f(c).over(here) for name, (f, c) in sums.items()}).join(carry, [key, "_slice"], "left")
    total = {name: F.when(F.col(f"_{name}").isNull(), F.col(name)).otherwise(
        F.col(name).bitwiseXOR(F.col(f"_{name}")) if f is F.bit_xor else F.col(name) + F.col(f"_{name}")) for name, (f, _) in sums.items()}
    return out.withColumns(total).drop("_slice", *[f"_{name}" for name in sums])


def end_digests(whole: DataFrame) -> DataFrame:
    """(depth, xa, xb, ends_sha256): digest of the ids of each sequence, ascending, joined by commas; hashed in a stream."""
    def pieces(batches):
        import pyarrow as pa

        at, ids, out = None, [], []
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != at or len(ids) == PIECE):
                    out.append((*at, ids[0], ",".join(map(str, ids))))
                    ids = []
                at = key
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], [*NODE, "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*at, ids[0], ",".join(map(str, ids))), [pa.int64()] * 4 + [pa.string()])], [*NODE, "first", "ids"])

    def digest(batches):
        import pyarrow as pa

        at, sha, out = None, None, []
        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends_sha256"])
                out = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*at, sha.hexdigest()), [pa.int64()] * 3 + [pa.string()])], [*NODE, "ends_sha256"])

    kinds = "depth bigint, xa bigint, xb bigint"
    rows = whole.select(*NODE, "conv_id")
    parts = rows.repartitionByRange(_partitions(rows), *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(pieces, f"{kinds}, first bigint, ids string")
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    scratch = Scratch(conversations.sparkSession)
    turns, convs = rebuilt(scratch.write(numbered_turns(conversations, scratch)))
    bound = scratch.write(turns.select(
        "conv_id", "pos", F.xxhash64("pos", "fa", "fb").alias("ha"), F.xxhash64("fb", "pos", "fa").alias("hb"), "chars"))
    ends = bound.groupBy("conv_id").agg(F.max("pos").alias("depth"), F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    zero = F.lit(0).cast("long")
    whole = scratch.write(convs.join(ends, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NODE]))
    sequences = scratch.write(whole.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")))

    own = bound.join(sequences.select("conv_id"), "conv_id", "left_semi").withColumn("at", F.col("pos") - 1)
    steps = scratch.write(running(own, "conv_id", "at", {"xa": (F.bit_xor, F.col("ha")), "xb": (F.bit_xor, F.col("hb"))}).select(
        "conv_id", F.col("pos").alias("depth"), "xa", "xb", F.col("xa").bitwiseXOR(F.col("ha")).alias("pa"),
        F.col("xb").bitwiseXOR(F.col("hb")).alias("pb"), "chars"))
    parents = steps.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("xa"), F.col("pb").alias("xb")).distinct()
    leaves = sequences.join(parents, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    weights = sequences.join(leaves, "conv_id", "left").select("conv_id", "weight", F.coalesce("leaf", zero).alias("leaf"), F.col("depth").alias("length"))
    none = F.lit(None).cast("long")
    root = sequences.select("conv_id", *[zero.alias(c) for c in NODE], none.alias("pa"), none.alias("pb"), zero.alias("chars"))
    prefixes = scratch.write(steps.unionByName(root).join(weights, "conv_id"))

    nodes = scratch.write(prefixes.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("n_leaves"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("chars").alias("chars")))
    share = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("share"))
    onward = prefixes.join(share, ["conv_id", "depth"], "left").withColumn("from_end", F.col("length") - F.col("depth"))
    saved = running(onward, "conv_id", "from_end", {"below": (F.sum, F.coalesce("share", zero))}).groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"))

    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("xa"), F.col("pb").alias("xb"),
                                         F.col("conv_id").alias("child"), F.col("depth").alias("child_depth"))
    children = up.groupBy(*NODE).agg(F.count("*").alias("n_children"))
    parent = up.join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE).select(
        F.col("child").alias("conv_id"), F.col("child_depth").alias("depth"), "parent_conv_id")
    empty = hashlib.sha256(b"").hexdigest()
    out = scratch.write(nodes.join(saved, NODE).join(children, NODE, "left").join(end_digests(whole), NODE, "left")
                        .join(parent, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))
    scratch.drop(keep=1)
    return out
