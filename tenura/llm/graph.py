"""Connected components of a distributed edge list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.session import store


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of the edge list can reach.

    ``edges`` has two columns ``a`` and ``b``; returns node, root. Each round
    hooks all larger neighbours of a node to its smallest neighbour, then all
    smaller ones, until every node hangs on its root: a number of rounds
    logarithmic in the longest path. Rounds are written tables; only a count
    and a checksum reach the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = store(pairs.distinct())
    state = _state(pairs)
    while True:
        both = _mirrored(pairs)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours go to the smallest
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # then smaller ones; a is the larger end now
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        hooked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small_least.select("a", F.col("m").alias("b"))
        )
        pairs = store(hooked.where("a <> b").distinct())
        now = _state(pairs)
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
