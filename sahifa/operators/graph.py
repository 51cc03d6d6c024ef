"""Breadth-first walks over a category graph, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut


def walk(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, parents): each node that can be reached, once, at its smallest depth.

    edges: parent, child, ord; roots: node. Of several ways of one depth the one with the smallest (parents, ord) wins,
    in place of the order in which requests happened to end. parents is the path from the root, without the node itself.
    A level joins the frontier with the edges, drops what was seen and is written to the shared folder, so a lost
    executor costs one level. Null nodes are ignored; a cycle ends by itself; max_depth None walks until nothing is new.
    """
    links = edges.select("parent", "child", "ord").where("parent is not null and child is not null")
    frontier = cut(roots.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parents")))
    levels = [frontier]
    seen = frontier.select("node")
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        reached = frontier.join(links, frontier["node"] == links["parent"]).select("child", F.concat("parents", F.array("node")).alias("parents"), "ord")
        new = reached.join(seen, reached["child"] == seen["node"], "left_anti")
        best = new.groupBy("child").agg(F.min(F.struct("parents", "ord")).alias("m"))
        frontier = cut(best.select(F.col("child").alias("node"), F.lit(depth).alias("depth"), F.col("m.parents").alias("parents")))
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("node"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out
