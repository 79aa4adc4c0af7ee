"""Connected components of a link table, by alternating large and small stars.

Each step rewrites the edges towards the smallest neighbour seen so far, which
keeps their number and ends in a star per component (Kiveris et al., 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.sources.staging import Staging


def _stars(edges: DataFrame, smallest: DataFrame, keep) -> DataFrame:
    """Each neighbour that ``keep`` takes, tied to the centre's smallest one.

    The join is split by AQE where a centre has very many neighbours.
    """
    return edges.join(smallest, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _stars(both, smallest, F.col("v") > F.col("u")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = _stars(down, smallest, F.lit(True))
    centres = smallest.select("u", F.col("m").alias("v"))
    return tied.unionByName(centres).filter("u != v").distinct()


def components(links: DataFrame, staging: Staging, label: str = "cc") -> DataFrame:
    """``vertex`` and the smallest vertex of its component, for every vertex that
    has a link and is not that smallest one. ``links`` has bigint columns u, v."""
    edges = staging.write(links.select("u", "v").filter("u != v").distinct(), f"{label}-0")
    state = None
    step = 0
    while True:
        step += 1
        edges = staging.write(_small_star(_large_star(edges)), f"{label}-{step}")
        staging.discard(f"{label}-{step - 1}")
        # The edges as a set, seen through two order-free sums.
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("max(v)")).first()
        if now == state:
            return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        state = now
