"""Connected components of an edge table by random hooking.

In each round every node hooks to its neighbour of least rank if that rank is under its own. Ranks are hashes of
the node and the round, so on every graph, however its numbers run, half of the nodes or more are expected to hook, and
the trees so made are shallow: a few steps of pointer doubling flatten them. Edges then go from tree to tree. Rounds
are logarithmic in the size of the largest component; a node's neighbours are only ever aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint, release


def _rank(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), node.alias("n"))


def _flatten(up: DataFrame) -> DataFrame:
    """(node, up) with every node pointing to the root of its tree."""
    while True:
        over = up.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        higher = checkpoint(up.join(over, up["up"] == over["mid"]).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        release(up)
        up = higher
        if not higher.agg(F.max("moved")).first()[0]:
            return higher


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another: root is the smallest node it is connected with.

    ``edges`` hold whole numbers; direction, repeats and loops do not matter; rows with a null are ignored.
    """
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))
    edges = checkpoint(edges.distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(maps)
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min(_rank(F.col("other"), turn)).alias("m"))
        hooked = least.select("node", F.when(F.col("m") < _rank(F.col("node"), turn), F.col("m.n")).otherwise(F.col("node")).alias("up"))
        tree = _flatten(checkpoint(hooked))
        maps.append(tree)
        tree = tree.select("node", "up")
        one, two = tree.toDF("a", "ua"), tree.toDF("b", "ub")
        left = edges.join(one, "a").join(two, "b").filter(F.col("ua") != F.col("ub"))
        left = checkpoint(left.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        release(edges)
        edges = left
    if not maps:
        return edges.toDF("node", "root")
    found = maps[-1].select("node", "up")
    for tree in reversed(maps[:-1]):
        above = found.toDF("mid", "top")
        found = tree.join(above, tree["up"] == above["mid"], "left").select("node", F.coalesce("top", "up").alias("up"))
    found = checkpoint(found)
    release(edges, *maps)
    low = found.groupBy("up").agg(F.min("node").alias("root"))
    return found.join(low, "up").select("node", "root")
