"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C


def components(links: DataFrame, scratch: C.Scratch | None = None) -> DataFrame:
    """links (a, b; long, not null) to (node, component): for every node that has a link to another, the smallest node reachable.

    Each round ends in the shared folder. A star's smallest neighbour comes from a partial aggregate, so a hub's links meet only
    in the join, which Spark can split. The last round's table is the result's source; scratch: what removes it later.
    """
    rounds = C.Scratch(links.sparkSession)
    edges = rounds.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = rounds.stored(small, "stars", now[0])
        rounds.clear(keep=1)
    if scratch is not None:
        scratch.paths += rounds.paths
    # every node but the smallest of its component has one edge, to that smallest one
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
