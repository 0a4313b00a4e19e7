"""Connected components of a graph of long node ids, by distributed star contraction (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, release, uses, written


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star: larger neighbours, then smaller ones, are tied to the least of them."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    # now a > b; each a is tied to the least of its smaller neighbours, and so are these
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    tied = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(smallest.select("a", F.col("m").alias("b"))).distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) of the same components: each node is tied to the least of its neighbours and itself, and edges
    join these instead. In dense groups most edges become equal, before rounds of stars repeat them. Nulls are ignored."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "dense-edges")
    release(edges)
    both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least-neighbours")
    half = now.join(least, "a").select(F.col("m").alias("x"), F.col("b").alias("a")).distinct()
    whole = half.join(least, "a").select(F.col("x").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return uses(whole.unionAll(least.filter("a <> m").select("a", F.col("m").alias("b"))), now, least)


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component): the least node that is reachable. edges: columns a and b, in any order, repeats allowed.

    Only nodes with an edge to another node appear; self-loops and nulls are ignored; no edges give no rows. Each
    round is written to the shared folder, and stops when no edge changes; a chain of n nodes takes O(log n) rounds.
    Nothing but counts reaches the driver. Raises if ``limit`` rounds don't suffice. Work tables that ``edges`` reads
    are deleted once they have been.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "edges")
    release(edges)
    seen = None
    for _ in range(limit):
        new = written(_stars(now), "edges")
        # sums of hashes stand for the set of edges
        print_ = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if print_ == seen:
            return uses(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), now)
        seen = print_
    raise RuntimeError("components did not settle")
