"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step sends every edge towards the smallest neighbour; the number of edges never grows. A node's minimum and degree
are pre-aggregated. Edges of a node of at least `HUB` edges (and a ten-thousandth of all) meet its minimum in a broadcast
join, so the hub that a large component turns into is no task of its own; there are at most 20,000 such nodes, as an edge
counts for two. All others meet theirs by shuffle, where none has more edges than that. Edges stay distributed and are
written to the shared folder after each round (as a table, so that
plans do not gather constraints from round to round); the driver only sees their number and a checksum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_folder, stored

HUB = 64


def _meet(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """edges (u, v) with the m of least (u, m, n edges) for u."""
    hubs = F.broadcast(least.where(F.col("n") >= hub).select(F.col("u").alias("h"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, F.col("u") == F.col("h"), "left")
    rest = marked.where("h IS NULL").select("u", "v").join(least.where(F.col("n") < hub).select("u", "m"), "u").select("u", "v", "m")
    return marked.where("h IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _meet(both, least, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _meet(down, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node that has an edge, the smallest node reachable. edges: u, v of a type with an order."""
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/0")
    state, turn = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state, turn = now, turn + 1
        hub = max(HUB, now[0] // 10_000)
        edges = stored(_small_star(_large_star(edges, hub).distinct(), hub).distinct(), f"{folder}/{turn}")
        remove(spark, f"{folder}/{turn - 1}")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
