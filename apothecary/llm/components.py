"""Connected components by alternating large and small stars, all in shuffled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import shuffle_partitions, stored

_SHARE = 1000  # a node with this part of all rows or more is hot: at most so many are


_ROWS = 100_000  # of an edge table, in a task


def _hung(edges: DataFrame, tasks: int) -> DataFrame:
    """Each edge's end ``u`` with ``m``, the least of ``u`` and its neighbours.

    The least of hot nodes, which are ``_SHARE`` at most, are broadcast, so
    that the rows of a star's centre never meet in one task. Tables that one
    task can hold are joined as they are.
    """
    if tasks == 1:
        least = edges.groupBy("u").agg(F.min("v").alias("least"))
        return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))
    least = stored(edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).coalesce(tasks))
    total = least.agg(F.sum("n")).first()[0] or 0
    hot = least.where((F.col("n") * _SHARE >= total) & (F.col("n") > 1)).select("u", F.col("least").alias("hot"))
    marked = edges.join(F.broadcast(hot), "u", "left")
    near = marked.where("hot is not null").select("u", "v", F.least("u", "hot").alias("m"))
    rest = marked.where("hot is null").select("u", "v").join(least.select("u", "least").hint("shuffle_hash"), "u").select("u", "v", F.least("u", "least").alias("m"))
    return near.union(rest)


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the least node of its component.

    Nulls and loops are ignored; an empty table gives an empty result. The
    rounds needed grow with the logarithm of the longest chain; if
    ``most_rounds`` do not settle the result, that is an error.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges)
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # Late rounds have few edges: as many tasks as their number asks for.
        tasks = max(1, min(shuffle_partitions(edges.sparkSession), 2 * state[0] // _ROWS))
        both = edges.union(edges.select("v", "u"))
        large = _hung(both, tasks).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _hung(stored(large.coalesce(tasks)) if tasks > 1 else large, tasks)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
