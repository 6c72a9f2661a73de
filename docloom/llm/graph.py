"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docloom.session import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); root is some node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by pointer doubling, and contracts the edges to those ends.  Every
    component with an edge at least halves its nodes in a round.  All tables stay
    distributed; only counts reach the driver.  Self loops and repeated edges are
    harmless; no edges give no rows.
    """
    left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
    left = work.save(left, "edges")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        hook = work.save(hook, "hooks")
        while True:
            far = hook.alias("x").join(hook.alias("y"), F.col("x.root") == F.col("y.node"))
            far = work.save(far.select("x.node", F.col("y.root").alias("root"), (F.col("x.root") != F.col("y.root")).alias("moved")), "jumped")
            moved = not far.where("moved").isEmpty()
            hook = far.drop("moved")
            if not moved:
                break
        ends = lambda name, to: hook.select(F.col("node").alias(name), F.col("root").alias(to))
        left = left.join(ends("a", "ra"), "a").join(ends("b", "rb"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        left = work.save(left, "contracted")
        if found is None:
            found = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            found = work.save(found.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "found")
    return found if found is not None else edges.sparkSession.createDataFrame([], "node long, root long")
