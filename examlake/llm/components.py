"""Union-find at the scale of a cluster: connected components by hooking and contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of the edges and the smallest node that can be reached from it.

    Each round hooks every node to its smallest neighbour, jumps once along the pointers (path halving) and contracts the edges to the
    roots found; edges should be a written table, as they are read more than once. A star vanishes in one round, a path halves. Loops and repeated edges don't matter; without edges, no row.
    """
    left = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")
    found, own = None, False
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        onward = hooked.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        roots = written(hooked.join(onward, "p").select(F.col("a").alias("node"), F.least("p", "pp").alias("root")), "roots")
        if found is None:
            found = roots.withColumnRenamed("root", "component")
        else:
            step = roots.select(F.col("node").alias("component"), "root")
            moved = written(found.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "components")
            drop_written(found)
            found = moved
        of_a, of_b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        nearer = left.join(of_a, "a").join(of_b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        last, left = left, written(nearer.where("a <> b").distinct(), "edges")
        if own:
            drop_written(last)
        own = True
        if roots.inputFiles() != found.inputFiles():
            drop_written(roots)
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
