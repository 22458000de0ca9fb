"""Connected components with the smallest member as id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component): for every node with an edge to another, the smallest node it is connected with.

    Labels start as the smallest neighbour. In each round all nodes of one label take the smallest label that any of them
    sees across an edge, or their label's own label if that is smaller: whole regions merge at once, and rounds grow with the
    logarithm of the number of regions. What a region sees is aggregated per label before the shuffle, so a region of any
    size is one row there. Each round is a written table. Stops when no label changes, which is counted exactly. NULL ends and loops are no
    edges; no edges give no rows; more than max_rounds rounds raise RuntimeError.
    """
    scratch = Scratch(edges.sparkSession, "graph", "zstd")
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    pairs = ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    # Each pair has one way round here, so that both ways are told apart without a further shuffle.
    both = scratch.keep(pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*"))
    labels = scratch.keep(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("label")))
    for _ in range(max_rounds):
        around = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("l")), "y").groupBy("x").agg(F.min("l").alias("l"))
        seen = labels.join(around, "x")
        hook = seen.groupBy("label").agg(F.min("l").alias("low"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("up"))
        new = F.least("label", "low", "up")
        after = scratch.keep(labels.join(hook.join(jump, "label"), "label").select("x", new.alias("label"), (new != F.col("label")).alias("moved")))
        done = after.where("moved").isEmpty()
        scratch.drop(labels)
        labels = after
        scratch.settle()
        if done:
            scratch.drop(both)
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
