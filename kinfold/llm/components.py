"""Problem 2: one group id for everything linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def connected_groups(links: DataFrame, a: str = "source_path", b: str = "duplicate_of", max_rounds: int = 200) -> DataFrame:
    """(node, group_id) for every node linked to another: group_id is the smallest node of its connected set.

    Hash-to-min, held as rows (v, u) "u is in the cluster set of v" so that no set is ever one value in
    one task. Each round every v takes m, the minimum of its set and itself, sends the whole set to m
    and m to every member. A star (every member of m holds m alone, counted exactly) is done and leaves
    the rounds, which end when none is left, so late rounds move only the sets that still change.
    Rounds grow with the logarithm of the longest chain.

    Texts are replaced by numbers first, in the texts' own order (one range sort of the distinct
    nodes), so the rounds move 16 bytes a row and the smallest number is the smallest text in
    code-point order. Minima are pre-aggregated before the shuffle; the join that brings them back is
    a sort-merge join whose hot keys adaptive execution splits. Each round is a written table.

    Links with a NULL or empty end and links of a node with itself link nothing. Repeated links and
    both directions count once. No links: no rows. Other columns are ignored. More than max_rounds
    rounds raise RuntimeError.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != "") & (F.col("y") != "") & (F.col("x") != F.col("y"))
    )
    pairs = scratch.keep(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    nodes = nodes.repartitionByRange(parts, "node").sortWithinPartitions("node").withColumn("nid", F.monotonically_increasing_id())
    nodes = scratch.keep(nodes)
    edges = (
        pairs.join(nodes.select(F.col("node").alias("x"), F.col("nid").alias("v")), "x")
        .join(nodes.select(F.col("node").alias("y"), F.col("nid").alias("u")), "y")
        .select("v", "u")
    )
    sets = scratch.keep(edges.union(edges.select("u", "v")))
    labels = []
    for _ in range(max_rounds):
        minima = sets.groupBy("v").agg(F.min("u").alias("lowest"), F.count(F.lit(1)).alias("size"))
        # A star is done: its minimum holds as many members as there are nodes that hold this minimum alone.
        leaf = (F.col("lowest") < F.col("v")) & (F.col("size") == 1)
        rooted = minima.withColumn("root", F.when(F.col("lowest") > F.col("v"), F.col("v")).when(leaf, F.col("lowest")))
        held = F.max(F.when(F.col("v") == F.col("root"), F.col("size")))
        stars = rooted.where("root is not null").groupBy("root").agg(F.count_if(F.col("v") != F.col("root")).alias("leaves"), held.alias("held"))
        done = stars.where(F.col("leaves") == F.col("held")).select("root", F.lit(True).alias("done"))
        known = rooted.join(done, "root", "left").select("v", F.least("v", "lowest").alias("m"), F.coalesce("done", F.lit(False)).alias("done"))
        known = scratch.keep(known)
        labels.append(known.where("done").select("v", "m"))
        met = sets.join(known.where("not done").select("v", "m"), "v")
        sent = met.select(F.explode(F.array(F.struct("m", F.col("u").alias("w")), F.struct("m", F.col("v").alias("w")))).alias("s")).select("s.*")
        sent = sent.where(F.col("m") != F.col("w")).distinct()
        both = sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("w").alias("u")), F.struct(F.col("w").alias("v"), F.col("m").alias("u")))).alias("s"))
        after = scratch.keep(both.select("s.*"))
        scratch.drop(sets)
        sets = after
        if sets.isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    label = labels[0]
    for part in labels[1:]:
        label = label.union(part)
    return (
        label.join(nodes.select(F.col("nid").alias("v"), "node"), "v")
        .join(nodes.select(F.col("nid").alias("m"), F.col("node").alias("group_id")), "m")
        .select("node", "group_id")
    )
