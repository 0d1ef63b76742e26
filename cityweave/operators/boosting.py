"""Gradient boosting for several classes from histograms: one aggregate a level sums the gradients of all nodes of all classes.

Rows are (id, x array<double>, y), y the number of the class or null where it is to be told. Features are cut into bins once;
a null is a bin of its own, the lowest, so that what is missing can tell something by itself. The driver sees histograms
only (classes x nodes x features x bins) and trees of a bounded depth; rows stay where they are and keep a score and a node
number for each class."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators.iterate import Rounds

#: Steps at whose multiples gains are told apart, so that the order of additions decides nothing.
GRAIN = 1e-9


@dataclass
class Boosted:
    """Bin edges by feature, the scores to start from, and trees: for each round and class (feature, bin) of each inner node,
    in levels, and the values of the leaves. A row goes right where its bin is over the node's; feature -1 goes left."""

    edges: list[list[float]]
    start: list[float]
    rate: float
    trees: list[list[tuple[list[tuple[int, int]], list[float]]]] = field(default_factory=list)

    def bins(self, x: str = "x") -> Column:
        """array<int>: 0 for a missing value, else one more than the number of edges below it."""
        one = lambda j, e: F.coalesce(F.lit(1) + sum(((F.get(x, F.lit(j)) > v).cast("int") for v in e), F.lit(0)), F.lit(0))
        return F.array(*(one(j, e) for j, e in enumerate(self.edges)))

    def leaf(self, splits: list[tuple[int, int]], depth: int, b: Column) -> Column:
        """Place of a row's leaf under a tree's splits."""
        node = F.lit(0)
        for level in range(depth):
            node = next_node(node, splits[(1 << level) - 1 : (1 << (level + 1)) - 1], b)
        return node


def next_node(node: Column, splits: list[tuple[int, int]], b: Column) -> Column:
    """Of a level's nodes the one below: twice the place, and one more to the right."""
    feature, cut = (F.array(*(F.lit(s[i]) for s in splits)) for i in (0, 1))
    at = F.get(feature, node)
    return node * 2 + F.when((at >= 0) & (F.get(b, F.greatest(at, F.lit(0))) > F.get(cut, node)), 1).otherwise(0)


def best_splits(sums: dict, nodes: int, features: int, bins: int, least: int, ridge: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The best (feature, bin) of each node by the second-order gain, and (2 * nodes, 2) sums of gradients and curvatures on
    both sides. sums: (node, feature, bin) to (g, h, n). Equal gains go to the first feature, then bin."""
    table = np.zeros((nodes, features, bins, 3))
    for key, value in sums.items():
        table[key] = value
    left = table.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 2] >= least) & (right[..., 2] >= least), np.round(gain / GRAIN) * GRAIN, -1.0)
    flat = gain.reshape(nodes, -1)
    best, splits, sides = flat.argmax(axis=1), [], np.zeros((2 * nodes, 2))
    for node in range(nodes):
        f, b = divmod(int(best[node]), bins)
        if flat[node, best[node]] > GRAIN:
            splits.append((f, b))
            sides[2 * node], sides[2 * node + 1] = left[node, f, b, :2], right[node, f, b, :2]
        else:
            splits.append((-1, 0))
            sides[2 * node] = whole[node, 0, 0, :2]
    return splits, sides


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def fit(rows: DataFrame, features: int, classes: int, rounds: int = 20, depth: int = 3, rate: float = 0.1, most_bins: int = 32, least: int = 20, ridge: float = 1.0) -> Boosted:
    """Trees on the rows with a class; at least two classes."""
    kept = Rounds()
    known = rows.where("y is not null")
    shares = [i / most_bins for i in range(1, most_bins)]
    cuts = known.agg(*(F.percentile_approx(F.get("x", F.lit(j)), shares, 10_000).alias(f"c{j}") for j in range(features))).first()
    size = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # a row for each class
    total = max(1, sum(size.values()))
    model = Boosted([sorted(set(c or [])) for c in cuts], [float(np.log((size.get(k, 0) + 1) / (total + classes))) for k in range(classes)], rate)
    bins = most_bins + 1
    now = kept.keep(known.select("y", model.bins().alias("b"), *(F.lit(s).alias(f"s{k}") for k, s in enumerate(model.start))))
    for _ in range(rounds):
        chance = softmax([F.col(f"s{k}") for k in range(classes)])
        state = now.select("*", *(p.alias(f"p{k}") for k, p in enumerate(chance)), *(F.lit(0).alias(f"n{k}") for k in range(classes)))
        trees: list[tuple[list[tuple[int, int]], list[float]]] = [([], []) for _ in range(classes)]
        for level in range(depth):
            one = lambda k: F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("node"), (F.col(f"p{k}") - (F.col("y") == k).cast("double")).alias("g"), (F.col(f"p{k}") * (1 - F.col(f"p{k}"))).alias("h"))
            long = state.select("b", F.explode(F.array(*map(one, range(classes)))).alias("c")).select("c.*", F.posexplode("b").alias("f", "bin"))
            sums = long.groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
            by: list[dict] = [{} for _ in range(classes)]
            for r in sums:
                by[r.k][r.node, r.f, r.bin] = (r.g, r.h, r.n)
            for k in range(classes):
                splits, sides = best_splits(by[k], 1 << level, features, bins, least, ridge)
                values = [float(-g / (h + ridge)) for g, h in sides]
                trees[k] = (trees[k][0] + splits, values)
                state = state.withColumn(f"n{k}", next_node(F.col(f"n{k}"), splits, F.col("b")))
        model.trees.append(trees)
        more = [(F.col(f"s{k}") + rate * F.get(F.array(*map(F.lit, trees[k][1])), F.col(f"n{k}"))).alias(f"s{k}") for k in range(classes)]
        now = kept.keep(state.select("y", "b", *more))
        kept.tidy(now)
    kept.tidy()
    return model


def predicted(rows: DataFrame, model: Boosted) -> DataFrame:
    """rows with p, the chances of the classes; one pass, the trees are part of the plan."""
    classes = len(model.start)
    out = rows.withColumn("_b", model.bins())
    for k in range(classes):
        score = F.lit(model.start[k])
        for trees in model.trees:
            splits, values = trees[k]
            depth = len(values).bit_length() - 1
            score = score + model.rate * F.get(F.array(*map(F.lit, values)), model.leaf(splits, depth, F.col("_b")))
        out = out.withColumn(f"_s{k}", score)
    return out.withColumn("p", F.array(*softmax([F.col(f"_s{k}") for k in range(classes)]))).drop("_b", *(f"_s{k}" for k in range(classes)))
