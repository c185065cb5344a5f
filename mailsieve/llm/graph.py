"""Connected components of link tables, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: columns `a` and `b` of any orderable type, in any order.

    Returns node and component (the smallest node reachable), a row for each node that has a link. Every round gives each
    node its smallest neighbour if that is smaller, then follows one more step (from the fifth round on twice as far each
    time, as a chain of ascending nodes loses only two by one step), and goes on with the links between what is left;
    each step is cut by a checkpoint. Null ends, self links and repeated links do nothing; no links, no rows.
    """
    pairs = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    for k in range(max_rounds):
        if pairs.isEmpty():
            break
        both = pairs.union(pairs.select("b", "a"))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to"))
        for _ in range(max(1, k - 2)):
            onward = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
            to = cut(to.join(onward.hint("merge"), "to").select("node", F.col("further").alias("to")))
        levels.append(to)
        first, second = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")  # merged: these tables grow with the input
        pairs = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"links remain after {max_rounds} rounds")
    if not levels:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = levels[-1]
    for to in reversed(levels[:-1]):
        after = out.select(F.col("node").alias("to"), F.col("to").alias("last"))
        out = to.join(after.hint("merge"), "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    return out.withColumnRenamed("to", "component")
