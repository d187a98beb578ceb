"""Connected components of a large graph by star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.staging import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than u is tied to the least of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its lesser neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).where("u != v")


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it is connected with) of every node that has an edge to another.

    ``edges`` holds the integer columns u and v; null ends, loops and repetitions are of no account. Large-star and
    small-star steps alternate until the edges stay as they are, which takes about the logarithm of the longest path, a
    few rounds. Only a count and a checksum reach the driver. A node with very many edges is reduced by partial
    aggregates and met again by joins on keys that are unique on one side.
    """
    now = staged(edges.where("u != v").select("u", "v").distinct(), "edges")
    digest = _digest(now)
    while digest[0]:
        now = staged(_small_star(_large_star(now).distinct()).distinct(), "edges")
        after = _digest(now)
        if after == digest:
            break
        digest = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
