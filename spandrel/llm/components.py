"""Connected components of a table of links, by alternating stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.lineage import materialize


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, are linked to the smallest of all."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select("v", "m").union(least.select("u", "m"))
    return small.toDF("u", "v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) of every node in ``links`` (u, v); each round is a written table.

    A round costs two shuffles of the links and shortens paths by about half, so long chains take logarithmically many.
    """
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, links = state, materialize(_stars(links))
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
