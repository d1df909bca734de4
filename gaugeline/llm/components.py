"""Connected components of a graph given as links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node reached.

    Each round points every node's larger neighbours, then its smaller ones, to
    the least node among them; both are a minimum per node, combined before the
    shuffle, and a join back, so a node with very many links is no bottleneck
    beyond what skewed joins split. Rounds grow with the logarithm of the
    longest chain. Each round's links are written to the shared folder, not
    collected. Null ends and loops are dropped.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(links)
        if before == state:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
