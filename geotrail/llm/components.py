"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freed, packed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) -> (node, label): each node of an edge with the smallest node that it reaches.

    Nodes are non-null longs; loops, repeated and reversed edges are welcome; no edge gives no row. Each step moves
    edges to the smallest neighbour by a minimum per node, which is partly aggregated before the shuffle, and a join, so
    no list of neighbours is gathered; the edge table is cut to the shared checkpoint folder after each round. The
    driver sees a count and a checksum of it. In the end the rounds' shuffle files are let go.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen, now = mark, packed(now, mark[0])
        # large star: larger neighbours of u move to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the smallest of those
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").select("u", "v", "m")
        now = cut(down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    both = least = large = down = None
    freed(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
