"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one grouped minimum (partial aggregation) and one shuffle join, written to the shared folder, so no node's
neighbours are ever gathered in one task and nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.scratch import written


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root, the smallest node that it reaches, for every linked node that is not itself a root.

    ``links`` need not be unique or ordered; links of a node with itself and links with null are ignored.
    """
    a, b = links[a], links[b]
    links = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = written(links.distinct(), "links")
    state = _state(links)
    while state[0]:
        links = written(_small_star(written(_large_star(links).distinct(), "star")).distinct(), "links")
        if (new := _state(links)) == state:
            break
        state = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
