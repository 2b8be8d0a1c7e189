"""Connected components of an edge table, by alternating stars around smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed
from ledgerloom.operators.lineage import released


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node of its neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For edges (u, v) with long ends: each node but the smallest of its component as u, that smallest node as v."""
    edges = checkpointed(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    if not state[0]:
        return edges
    for _ in range(most_rounds):
        edges = checkpointed(_small_star(_large_star(edges).distinct()).distinct())
        before, state = state, _state(edges)
        released(edges.sparkSession)  # a round leaves a file of each task of some eight shuffles, whatever the size of the table
        if state == before:
            return edges
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def row_links(rows: DataFrame, leaves: DataFrame, links: DataFrame) -> DataFrame:
    """For rows (id, fp), the first id of each fp and links (u, v) of fps: links (u, v) of ids that connect the same rows.

    Each row is linked to the first of its fp, and the first rows of linked fps to each other. No components are found
    here, so that links of several kinds can be joined and need it once.
    """
    of = leaves.select("fp", "first_id").repartition(F.xxhash64("fp"))  # by another key, so that both sides of the join are shuffled and a hot leaf can be split
    own = rows.select("id", "fp").join(of, "fp").where(~F.col("id").eqNullSafe(F.col("first_id"))).select(F.col("id").alias("u"), F.col("first_id").alias("v"))
    for end in ("u", "v"):
        links = links.join(leaves.select(F.col("fp").alias(end), F.col("first_id").alias(f"first_{end}")), end)
    return own.unionByName(links.select(F.col("first_u").alias("u"), F.col("first_v").alias("v")))
