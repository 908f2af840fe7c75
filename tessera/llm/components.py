"""Connected components of a link table by alternating large and small stars.

Each round rewires links toward the smallest neighbour (after Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Minima are aggregated before they are shuffled and brought back by an equi-join. Their key is named anew
there, so that the join deals both sides itself; adaptive execution can then split hot keys, and a node with very many
links fills no single task. Every round is written to the shared
folder; the one before it is deleted. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def _dealt_anew(least: DataFrame) -> DataFrame:
    """The same rows, of which the planner does not know that they are dealt by u already."""
    return least.withColumn("u", F.col("u").bitwiseXOR(F.lit(0).cast("long")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round over links (u, v) with v < u."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(_dealt_anew(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(_dealt_anew(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): each linked node that isn't the smallest of its component, and that smallest node.

    ``links`` has long columns u and v in any direction; loops and repeats are allowed. An empty table gives none. Rounds
    go on until nothing changes: each moves links to smaller nodes, so they end, after about the logarithm of the longest
    path.
    """
    links = scratch.write(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    number, before = scratch.count, _state(links)
    while before[0]:
        large = scratch.write(_star(links, True))
        between = scratch.count
        links = scratch.write(_star(large, False))
        scratch.drop(number), scratch.drop(between)
        number, after = scratch.count, _state(links)
        if after == before:
            return links
        before = after
    return links
