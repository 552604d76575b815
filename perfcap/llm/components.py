"""Connected components of an edge list by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfcap.llm.tables import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached.

    Each round rewires neighbours to the smallest neighbour, first those above a node, then those below it; it is an
    aggregation, whose partial results are formed before the shuffle, and an equi-join. Edges of a node to itself keep
    it as a component of its own. No edges: no rows.
    """
    own = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = scratch.write(own)
    nodes = own.select(F.col("a").alias("node")).unionByName(own.select(F.col("b").alias("node"))).distinct()
    links, last = own.where("a < b"), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))))
        links = scratch.write(small.where("a <> b").distinct().select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    to = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return nodes.join(to, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
