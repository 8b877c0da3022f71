"""Interaction graphs: node features, both-way edges, negative samples, attention weights and weighted sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame, a: str = "drug_a", b: str = "drug_b", *carry: str) -> DataFrame:
    """src, dst for each edge and its reverse."""
    forth = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *carry)
    return forth.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"), *carry))


def node_features(edges: DataFrame, columns: list[str], a: str = "drug_a", b: str = "drug_b") -> DataFrame:
    """Means of the columns over all pairs that touch a node, and its degree."""
    sides = both_ways(edges, a, b, *columns)
    return sides.groupBy(F.col("src").alias("node")).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], F.count("*").alias("degree"))


def segment_softmax(edges: DataFrame, target: str, score: str) -> DataFrame:
    """Weights of the edges into each target: exp(score - max) over their sum; the max is 0 at least.

    Sums are joined back instead of taken over a window, so a node with very many edges is combined before the shuffle.
    """
    top = edges.groupBy(target).agg(F.greatest(F.lit(0.0), F.max(score)).alias("_top"))
    shifted = edges.join(top, target).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(target).agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, target).withColumn("weight", F.col("_e") / (F.col("_sum") + 1e-9)).drop("_top", "_e", "_sum")


def weighted_sums(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """For each target the sum of its sources' columns times the edges' weights: edges (src, dst, weight), nodes (node, ...)."""
    joined = edges.join(nodes.select(F.col("node").alias("src"), *columns), "src")
    return joined.groupBy(F.col("dst").alias("node")).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"sum_{c}") for c in columns])


def negative_samples(positives: DataFrame, nodes: DataFrame, each: int = 5, a: str = "drug_a", b: str = "drug_b", seed: int = 42) -> DataFrame:
    """At most ``each`` unordered pairs a positive that are no positives, drawn by hash: src, dst.

    Every positive draws two places in the list of nodes ``each`` times, so
    the work follows the edges; pairs drawn twice, loops and positives go.
    ``nodes`` has node and node_id, without gaps from 0.
    """
    n = nodes.count()
    draw = lambda k: F.pmod(F.conv(F.left(F.md5(F.concat_ws("|", a, b, "turn", F.lit(f"{seed}-{k}")).cast("binary")), F.lit(8)), 16, 10).cast("long"), F.lit(max(1, n)))
    drawn = positives.select(a, b, F.explode(F.sequence(F.lit(1), F.lit(each))).alias("turn")).withColumn("turn", F.col("turn").cast("string")).select(draw(0).alias("i"), draw(1).alias("j"))
    ids = nodes.select("node", "node_id")
    pairs = drawn.where("i <> j").distinct().join(ids.withColumnsRenamed({"node": "x", "node_id": "i"}), "i").join(ids.withColumnsRenamed({"node": "y", "node_id": "j"}), "j")
    pairs = pairs.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
    known = positives.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    return pairs.join(known, ["src", "dst"], "left_anti")
