"""Strongly connected components of a whole directed graph at once, by trimming and colouring forward and backward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.operators.iterate import Rounds


def _spread(labels: DataFrame, edges: DataFrame, rounds: Rounds) -> DataFrame:
    """labels (node, c) after the largest c has gone along edges (src, dst) as far as it gets; only changed nodes send."""
    front = labels
    while True:
        got = front.select(F.col("node").alias("src"), "c").join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("new"))
        front = rounds.keep(labels.join(got, "node").where("new > c").select("node", F.col("new").alias("c")))
        if front.isEmpty():
            return labels
        labels = rounds.keep(labels.join(front.select("node", F.col("c").alias("new")), "node", "left").select("node", F.coalesce("new", "c").alias("c")))


def strong_components(edges: DataFrame, trims: int = 2) -> DataFrame:
    """(node, component): the smallest node of each node's strongly connected component.

    A round first takes nodes without edges in or without edges out, which are components of their own. Then the largest
    node number spreads forward; nodes of one colour that the colour's own node can be reached from form its component,
    found for all colours at once by going backward inside them. Edges between colours join no component and go."""
    rounds = Rounds()
    both = edges.select("src").unionAll(edges.select("dst")).distinct().withColumnRenamed("src", "node")
    nodes = rounds.keep(both)
    left = rounds.keep(edges.select("src", "dst").where("src <> dst").distinct())
    done: list[DataFrame] = []
    while not nodes.isEmpty():
        for _ in range(trims):
            inner = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            alone = rounds.keep(nodes.join(inner, "node", "left_anti"), last=True)
            if alone.isEmpty():
                break
            done.append(alone.select("node", F.col("node").alias("component")))
            nodes = rounds.keep(nodes.join(inner, "node", "left_semi"))
            left = rounds.keep(left.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if nodes.isEmpty():
            break
        colour = _spread(nodes.select("node", F.col("node").alias("c")), left, rounds)
        own = left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst")
        own = rounds.keep(own)
        back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        none = F.when(F.col("node") == F.col("c"), F.col("c"))
        reached = _spread(colour.select("node", F.coalesce(none, F.lit(-(1 << 63))).alias("c")), back, rounds)
        found = rounds.keep(reached.where(F.col("c") > F.lit(-(1 << 63))), last=True)
        least = found.groupBy("c").agg(F.min("node").alias("component"))
        done.append(found.join(least, "c").select("node", "component"))
        nodes = rounds.keep(nodes.join(found, "node", "left_anti"))
        left = rounds.keep(own.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        rounds.tidy(nodes, left)
    out = done[0] if done else nodes.select("node", F.col("node").alias("component"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def largest(components: DataFrame) -> DataFrame:
    """Nodes of the largest component (node, component), the one of the smallest node on ties."""
    size = components.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(size.select("component")), "component", "left_semi").select("node", "component")
