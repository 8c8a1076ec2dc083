"""Connected components of a distributed edge list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascreen.llm.shared import written


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges(a, b)``; both columns are integers.

    Alternates large-star and small-star steps: edges are only ever re-pointed to smaller nodes, no neighbourhood is gathered, and the
    number of rounds grows with the logarithm of the longest path. Each round is written to the shared folder. Loops and repeated edges
    are harmless; no edges give no rows. The loop ends when a round leaves the edge set as it was (count and a sum of hashes).
    """
    def stamp(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = stamp(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = (linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = written(small, label)
        after = stamp(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
