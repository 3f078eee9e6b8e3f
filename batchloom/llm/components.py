"""Connected components of a distributed list of links, by large-star and small-star steps.

The least neighbours of a step are written before they are joined, so that adaptive execution
can split the rows of a node that a third of all links name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Needs b < a in each link."""
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, root`` for each node that isn't the least of its component.

    ``edges`` has two columns a and b of one ordered type; their order in a link, repeated
    links and links of a node to itself don't matter. Each step is written to the shared
    folder, so that no lineage grows. It ends when a round changes no link.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = settle(links, "links")
    digest = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == digest or not now["n"]:
            return links.select("a", F.col("b").alias("root"))
        digest = now
        links = settle(_small_star(settle(_large_star(links), "links")), "links")
