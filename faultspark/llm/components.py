"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.sources.stage import ensure_checkpoint_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link the neighbours of each node to its smallest neighbour (or itself).

    The smallest neighbour is a combined aggregate, so a node with very many neighbours is never gathered.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(low, "a")
    if large:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node that it reaches.

    ``edges`` has columns a and b of one type that can be ordered, without nulls; direction, repeats and loops do not
    matter. Each round is written to the shared folder, so lost executors do not restart the iteration. The loop ends
    when a round changes nothing: then every edge points from a node to its root.
    """
    ensure_checkpoint_dir(edges)
    state = edges.where("a <> b").select("a", "b").distinct().checkpoint()
    mark = None
    while True:
        state = _star(_star(state, True), False).checkpoint()
        row = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (row.n, row.h) == mark:
            break
        mark = (row.n, row.h)
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
