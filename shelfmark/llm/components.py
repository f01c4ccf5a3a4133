"""Connected components of a graph given as a table of edges.

Alternates the large-star and small-star steps: every node hands its neighbours
its smallest neighbour.  Steps are joins-free groupings, and each round is a
written table, so a graph of any size or shape is never held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest of each u and its v; a hot u is reduced before the shuffle."""
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, keep: Column) -> DataFrame:
    """Links every kept neighbour v of u, and u itself, to the smallest around u."""
    smallest = _smallest(pairs)
    # an ordinary inner join: its hot side can be split
    moved = pairs.where(keep).join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge between two different nodes.

    The component is the smallest node in it.  Nulls, self-links and repeated
    edges are ignored; without edges the result is empty.
    """
    links = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where(F.col("u") != F.col("v"))
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = None
    while True:
        # large-star: neighbours above u move to the smallest around u
        links = _star(_both(links), F.col("v") > F.col("u"))
        # small-star: u and its neighbours, all below u, move to the smallest of them
        pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        links = stage(_star(pairs, F.lit(True)), "links")
        count, total = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # stars that no longer change are the components
        if sign == (count, total):
            break
        sign = (count, total)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
