"""Connected components by alternating large-star and small-star steps.

Each step is a minimum by vertex, which is summed before it is shuffled, and a join of that minimum back to the
edges. The minima are written before they are joined: then both sides of the join are dealt out for it alone, and
Spark can split a vertex with very many edges among tasks. Rounds write their edges to the shared folder; nothing of
the graph reaches the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, saved


def large_star(edges: DataFrame) -> DataFrame:
    """Links each vertex's larger neighbours to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    out = saved(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    dropped(least)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    """Links each vertex and its smaller neighbours to the least of these; an edge's larger end is ``a``."""
    least = saved(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = saved(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    dropped(least)
    return out


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for each vertex a that has an edge and isn't the least of its component, which is b.

    ``edges`` has two columns of longs; direction, loops and repeats don't matter.
    """
    a, b = edges.columns
    now = saved(edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = state(now)
    while seen[0]:
        wide = large_star(now)
        new = small_star(wide)
        dropped(now)
        dropped(wide)
        now, before, seen = new, seen, state(new)
        if seen == before:
            break
    return now
