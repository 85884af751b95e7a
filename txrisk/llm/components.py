"""Connected components by alternating large-star and small-star rounds.

Every round is two minimum aggregations (combined map-side) and two equi-joins
over the edge table; no neighbour list is ever gathered, so a hub costs an
aggregation row per map task and AQE may split its join partition. Rounds are
stored in the shared folder, and the number of rounds grows with the logarithm
of the component diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import store


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"),
              F.sum(F.xxhash64("lo", "hi") % 1_000_003).alias("s")).first()
    return r["n"], r["x"], r["s"]


def _round(e: DataFrame) -> DataFrame:
    both = (e.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
            .unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))))
    near = both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    # large star: neighbours above u move to the smallest vertex u can see
    large = (both.where(F.col("v") > F.col("u")).join(near, "u")
             .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
             .where(F.col("hi") != F.col("lo")).distinct())
    # small star: the lower neighbours of each vertex meet at its smallest one
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = (large.join(low, "hi").where(F.col("lo") != F.col("m"))
             .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
    return small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of ``edges``; label = smallest node reachable.

    Edges are undirected pairs of longs; repeated edges, both directions, self
    loops and an empty table are allowed (self loops and null ends are ignored).
    """
    e = (edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"),
                      (F.col(u).isNotNull() & F.col(v).isNotNull()).alias("ok"))
         .where(F.col("ok") & (F.col("hi") != F.col("lo"))).select("hi", "lo").distinct())
    e = store(e, "components")
    now = _signature(e)
    while now[0]:
        nxt = store(_round(e), "components")
        before, now, e = now, _signature(nxt), nxt
        if now == before:
            break
    return (e.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
            .unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("label"))
                         .distinct()))
