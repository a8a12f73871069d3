"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MOST_ROUNDS = 60


def _star_large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))


def _star_small(links: DataFrame) -> DataFrame:
    least = cut_lineage(links.groupBy("a").agg(F.min("b").alias("m")))
    met = links.join(least, "a")
    return met.select("a", F.col("m").alias("b")).unionAll(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Every link goes from a node with no other link to one that is nobody's larger end."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        links.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (longs ``a``, ``b``): the smallest node it reaches.

    Every node in turn hands its larger neighbours, then its smaller ones, to the least of them
    (alternating stars), until each component is one star. Links are never gathered by node: a
    minimum per node is aggregated map-side, written, and joined back. Being a table of its own it
    is broadcast where its size allows; else a node with very many links is a skewed join, which
    AQE can split. Each round is written to the shared folder. Links to itself and repeated links
    change nothing; without links there are no rows.
    """
    now = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(MOST_ROUNDS):
        now = cut_lineage(_star_small(_star_large(now)))
        if _settled(now):
            break
    else:
        raise RuntimeError("links did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


class Union:
    """Union-find over positions 0..n-1; the smallest position is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
