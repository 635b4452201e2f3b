"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import Workspace, join_groups

#: Rounds without jumps; most graphs of near copies are stars and end within them.
PLAIN_ROUNDS = 4


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """``a, b`` (longs) -> ``node, comp``: the smallest node each node can reach; nodes without edges are absent.

    A round takes the smallest label among a node and its neighbours (a map-side combined
    minimum). Graphs that need more rounds also jump from a label to that label's own label, so
    a path halves. A node with very many edges, and a label that very many nodes
    have, are told to their rows by ``join_groups``, so neither is a hot key. Every
    round's labels are written to the shared folder, which cuts the lineage: a
    lost executor costs parts of one round.
    """
    own = edges.select("a").union(edges.select(F.col("b").alias("a"))).select("a", F.col("a").alias("b"))
    both = work.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").union(own).distinct(), f"{name}_edges")
    size = both.count()
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"), F.count("*").alias("n")), f"{name}_0", size)
    step, more = 0, not labels.isEmpty()
    while more:
        near = join_groups(both, labels.select(F.col("node").alias("b"), "comp", "n"), ["b"], F.col("a"))
        lower = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("comp"), F.max(F.when(F.col("a") == F.col("b"), F.col("comp"))).alias("old"), F.count("*").alias("n"))
        step += 1
        following = work.table(lower, f"{name}_{step}", size)
        more = not following.where("comp <> old").isEmpty()
        work.drop(f"{name}_{step - 1}")
        if more and step >= PLAIN_ROUNDS:
            named = following.groupBy("comp").agg(F.count("*").alias("n"))
            further = work.table(named.join(following.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp"), f"{name}_further", size)
            jumped = join_groups(following.select("node", "comp", F.col("n").alias("degree")), further, ["comp"], F.col("node"))
            step += 1
            following = work.table(jumped.select("node", F.least("comp", "further").alias("comp"), F.col("degree").alias("n")), f"{name}_{step}", size)
            work.drop(f"{name}_{step - 1}", f"{name}_further")
        labels = following.select("node", "comp", "n")
    work.drop(f"{name}_edges")
    return labels.select("node", "comp")
