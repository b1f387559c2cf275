"""Connected components by alternating large-star and small-star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import cut


#: A hub has at least this share of all edge ends, so there are at most as many hubs as its inverse.
HUB = 1 / 256
#: With fewer edges in all no node has enough of them to hold a task up.
MANY = 1_000_000


def _met(around: DataFrame, least: DataFrame) -> DataFrame:
    """``around`` with the label m of each u. Edges of hubs stay where they are and the labels of
    the hubs, 256 at most, come to them; all others meet by a shuffle on u."""
    hubs = least.crossJoin(F.broadcast(least.agg(F.sum("n").alias("ends")))).filter(F.col("n") >= F.greatest(F.col("ends") * HUB, F.lit(2))).select("u", "m")
    rest = around.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return around.join(F.broadcast(hubs), "u").unionByName(rest.join(least.select("u", "m"), "u"))


def _star(edges: DataFrame, large: bool, hubs: bool) -> DataFrame:
    """One star step on edges (u, v): link neighbours to the smallest label seen at a node."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = _met(around, least) if hubs else around.join(least.select("u", "m"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u itself keeps its own link to m through the neighbour's view of it.
        return out.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the smallest node of its component.

    Each round is cut to the shared folder. Stops when a round changes nothing; the number of
    rounds grows with the logarithm of a component's size, so more than ``most_rounds`` is an error.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
    hubs = state[0] >= MANY
    for _ in range(most_rounds):
        now = cut(_star(_star(now, True, hubs), False, hubs))
        after = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"no fixed point within {most_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(roots).groupBy("node").agg(F.min("label").alias("label"))
