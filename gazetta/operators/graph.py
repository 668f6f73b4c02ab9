"""Graph walks as iterated joins over edge tables, with the lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetta.sources.storage import cut


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached. Edges (a, b), either way.

    Alternates linking every larger neighbour and every smaller neighbour to the
    smallest one, which halves paths; minima are aggregated in part before the shuffle.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    same = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(*same).first()
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = now.agg(*same).first()
        if after == before:
            break
        before = after
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    out = nodes.join(roots, nodes["node"] == roots["u"], "left")
    return out.select("node", F.coalesce("root", "node").alias("root"))


def expand(edges: DataFrame, starts: DataFrame, depth: int, top_k: int) -> DataFrame:
    """(node, depth): breadth-first, over each node's top_k heaviest edges (a, b, weight)."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    best = cut(edges.withColumn("__r", rank).filter(F.col("__r") <= top_k).select("a", "b"))
    seen = starts.select("node", F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(best, front["node"] == best["a"]).select(F.col("b").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(node, rank) of an undirected weighted graph (a, b, weight)."""
    both = edges.select("a", "b", "weight").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    out = F.sum("weight").over(Window.partitionBy("a"))
    moves = cut(both.withColumn("share", F.col("weight") / out).select("a", "b", "share"))
    nodes = cut(moves.select(F.col("a").alias("node")).distinct())
    n = max(1, nodes.count())
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        flow = moves.join(rank, moves["a"] == rank["node"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = cut(nodes.join(flow, "node", "left").select("node", ((1 - alpha) / n + alpha * F.coalesce("flow", F.lit(0.0))).alias("rank")))
        moved = new.alias("n").join(rank.alias("o"), "node").agg(F.sum(F.abs(F.col("n.rank") - F.col("o.rank")))).first()[0] or 0.0
        rank = new
        if moved < tolerance * n:
            break
    return rank


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): every node takes the label of the largest weight around it,
    itself included at its strongest edge, the smallest label on ties."""
    both = cut(edges.filter("a <> b").select("a", "b", "weight").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    own = both.groupBy("a").agg(F.max("weight").alias("weight")).select("a", F.col("a").alias("b"), "weight")
    arcs = cut(both.unionByName(own))
    labels = own.select(F.col("a").alias("node"), F.col("a").alias("label"))
    for _ in range(rounds):
        votes = arcs.join(labels, arcs["b"] == labels["node"]).groupBy("a", "label").agg(F.sum("weight").alias("w"))
        new = cut(votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("label")).select(F.col("a").alias("node"), "label"))
        changed = new.alias("n").join(labels.alias("o"), "node").filter("n.label <> o.label").isEmpty()
        labels = new
        if changed:
            break
    return labels


def degree(edges: DataFrame) -> DataFrame:
    """node, degree, weighted_degree and the degree's share of all other nodes."""
    both = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    out = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    nodes = both.agg(F.count_distinct("node").alias("__nodes"))
    others = (F.col("__nodes") - 1).cast("double")
    return out.join(F.broadcast(nodes)).withColumn("centrality", F.col("degree") / F.nullif(others, F.lit(0.0))).drop("__nodes")  # a single row


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    return both.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
