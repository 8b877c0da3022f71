"""Nearest neighbours by cosine from a kd-tree over low-dimensional stable projections.

For unit vectors x and y and a Gaussian projection to m dimensions, the
squared projected distance over the squared distance follows a chi-square law
with m degrees of freedom. So projected neighbours are verified nearest first
until the test holds: once the projected distance reaches the chi-square
quantile times the distance of the k-th best so far, a better neighbour is
left unseen with a small probability only.

The upper levels of the tree part the rows into leaves; a leaf with more rows
than a task should hold is dealt to several blocks. A query first visits one
block of its own leaf for a bound, then every leaf that the test leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apothecary.llm.common import checkpointed, chosen, shuffle_partitions

_BUCKET = 48


def chi_square_quantile(m: int, z: float) -> float:
    """The quantile at the standard normal score ``z``, after Wilson and Hilferty."""
    return m * (1 - 2 / (9 * m) + z * (2 / (9 * m)) ** 0.5) ** 3


class Tree:
    """A balanced kd-tree of ``depth`` levels fitted to a bounded sample of projections."""

    def __init__(self, sample: np.ndarray, depth: int):
        m = sample.shape[1]
        self.depth, n = depth, 2**depth
        self.dim, self.at = np.zeros(n, dtype=np.int64), np.zeros(n)
        self.low, self.high = np.full((n, m), -np.inf), np.full((n, m), np.inf)
        parts = {1: (sample, self.low[0].copy(), self.high[0].copy())}
        for node in range(1, n):
            rows, low, high = parts.pop(node)
            d = int(np.ptp(rows, axis=0).argmax()) if len(rows) else 0
            at = float(np.median(rows[:, d])) if len(rows) else 0.0
            self.dim[node], self.at[node] = d, at
            left = rows[:, d] <= at
            for child, keep, edge in ((2 * node, left, "high"), (2 * node + 1, ~left, "low")):
                lo, hi = low.copy(), high.copy()
                (hi if edge == "high" else lo)[d] = at
                parts[child] = (rows[keep], lo, hi)
        for node, (_, lo, hi) in parts.items():
            self.low[node - n], self.high[node - n] = lo, hi

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return node - 2**self.depth

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distances from a point to the leaves' cells."""
        return (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(axis=1)


def _projection(dims: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, m))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in one fixed order of summation: equal vectors get equal scores."""
    dot, xx, qq = np.zeros(len(x)), np.zeros(len(x)), 0.0
    for j in range(x.shape[1]):
        dot += x[:, j] * q[j]
        xx += x[:, j] * x[:, j]
        qq += q[j] * q[j]
    return dot / (np.sqrt(xx) * np.sqrt(qq))


class _Block:
    """Rows of one block, in small buckets of a local kd-tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray):
        order, ends = [], []
        work = [np.arange(len(ids))]
        while work:
            rows = work.pop()
            if len(rows) <= _BUCKET or not np.ptp(p[rows], axis=0).max() > 0:
                order.append(rows)
                ends.append(len(rows))
                continue
            d = int(np.ptp(p[rows], axis=0).argmax())
            half = np.argpartition(p[rows, d], len(rows) // 2)
            work += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        order = np.concatenate(order)
        self.ids, self.x, self.unit = ids[order], x[order], _unit(x[order])
        self.begin = np.r_[0, np.cumsum(ends)[:-1]]
        self.end = np.cumsum(ends)
        self.low, self.high = np.minimum.reduceat(p[order], self.begin), np.maximum.reduceat(p[order], self.begin)

    def nearest(self, query_id: int, q: np.ndarray, point: np.ndarray, k: int, bound: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (id, score) found; ``bound`` is a squared distance within which k are known."""
        unit = q / np.sqrt((q * q).sum())
        far = (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        best, rows = np.empty(0), np.empty(0, dtype=np.int64)
        step, at = 2, 0
        while at < len(order) and far[order[at]] <= reach * (bound + 1e-9):
            take = order[at : at + step]
            seen = np.concatenate([np.arange(self.begin[b], self.end[b]) for b in take])
            seen = seen[self.ids[seen] != query_id]
            best, rows = np.r_[best, self.unit[seen] @ unit], np.r_[rows, seen]
            if len(best) >= k:
                least = np.partition(best, len(best) - k)[len(best) - k]
                keep = best >= least - 1e-9
                best, rows = best[keep], rows[keep]
                bound = min(bound, max(0.0, 2 - 2 * least))
            at += step
            step = min(2 * step, 64)
        score = _exact(self.x[rows], q)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def _visit(k: int, reach: float):
    """Rows sorted by block, its vectors before its queries, to the best candidates of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, block, out = None, [], None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for now, is_query, vec_id, bound, x, p in zip(*(part.column(n).to_pylist() for n in ("block", "is_query", "vec_id", "bound", "x", "p")), strict=True):
                    if now != key:
                        key, vectors, block = now, [], None
                    if not is_query:
                        vectors.append((vec_id, x, p))
                        continue
                    if not vectors:
                        continue
                    if block is None:
                        ids, xs, ps = zip(*vectors, strict=True)
                        block = _Block(np.array(ids, dtype=np.int64), np.array(xs, dtype=np.float64), np.array(ps))
                    ids, scores = block.nearest(vec_id, np.array(x, dtype=np.float64), np.array(p), k, bound, reach)
                    out += [(vec_id, int(i), float(s)) for i, s in zip(ids, scores, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])
                    out = []

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = 10, z: float = 2.05, leaf_rows: int = 4096, sample: int = 20_000, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank from 1, vec_id, score (the cosine in double precision).

    ``queries`` is a part of ``vectors``' rows or has the same two columns; a
    vector of the query's own id is no candidate. Ties go to the smaller id.
    ``z`` 2.05 sets the test's confidence to 0.98. The tree's upper levels are
    fitted to at most about ``sample`` rows; every row is indexed.

    Rows with a null id, and vectors that are null, zero, of another length
    than most, or hold null or non-finite components, take no part. Repeated
    rows count once. Empty tables give an empty result.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        x = F.col("x")
        df = chosen(df, vec_id=id_col, x=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))
        fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
        return df.where(fine)

    rows, asked = valid(vectors), valid(queries)
    sizes = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = sizes[0]["dims"], sizes[0]["count"]
    rows, asked = (df.where(F.size("x") == dims).dropDuplicates(["vec_id", "x"]) for df in (rows, asked))
    matrix = _projection(dims, m, seed)
    share = min(1.0, sample / total)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").limit(2 * sample).collect()
    points = _unit(np.array([r.x for r in drawn], dtype=np.float64)) @ matrix if drawn else np.zeros((1, m))
    depth = int(np.clip(np.ceil(np.log2(max(1, total / leaf_rows))), 0, 12))
    tree = Tree(points, depth)
    reach = chi_square_quantile(m, z)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _unit(_vectors(batch.column("x"))) @ matrix
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(list(p), pa.list_(pa.float64())), pa.array(tree.leaf(p))], names=["vec_id", "x", "p", "leaf"])

    schema = "vec_id long, x array<double>, p array<double>, leaf long"
    placed = rows.mapInArrow(place, schema)
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # at most 4096 rows
    parts = np.ones(2**depth, dtype=np.int64)
    for leaf, n in counts.items():
        parts[leaf] = -(-n // (2 * leaf_rows))
    first_block = np.r_[0, np.cumsum(parts)[:-1]]
    of_leaf = F.create_map(*[F.lit(int(v)) for leaf in range(2**depth) for v in (leaf, parts[leaf])])
    start = F.create_map(*[F.lit(int(v)) for leaf in range(2**depth) for v in (leaf, first_block[leaf])])
    block = F.element_at(start, F.col("leaf").cast("int")) + F.pmod(F.xxhash64("vec_id"), F.element_at(of_leaf, F.col("leaf").cast("int")))
    everything = placed.select(block.cast("long").alias("block"), F.lit(False).alias("is_query"), "vec_id", F.lit(None).cast("double").alias("bound"), "x", "p")

    def visited(visits: DataFrame) -> DataFrame:
        both = everything.unionByName(visits).repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "is_query", "vec_id")
        return both.mapInArrow(_visit(k, reach), "query_id long, vec_id long, score double")

    homes = asked.mapInArrow(place, schema)
    bounded = visited(homes.select(block.cast("long").alias("block"), F.lit(True).alias("is_query"), "vec_id", F.lit(4.0).alias("bound"), "x", "p"))
    bounded = bounded.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bounded = checkpointed(bounded.select("query_id", F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))).otherwise(4.0).alias("bound")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                bounds = [4.0 if b is None else b for b in part.column("bound").to_pylist()]
                row, open_blocks = [], []
                for n, (p, bound) in enumerate(zip(part.column("p").to_pylist(), bounds, strict=True)):
                    for leaf in np.flatnonzero(tree.distances(np.array(p)) <= reach * (bound + 1e-9)):
                        open_blocks += range(first_block[leaf], first_block[leaf] + parts[leaf])
                        row += [n] * int(parts[leaf])
                taken = part.select(["vec_id", "x", "p"]).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(open_blocks, pa.int64()), pa.array([True] * len(row)), taken.column(0), pa.array([bounds[n] for n in row], pa.float64()), taken.column(1), taken.column(2)], names=["block", "is_query", "vec_id", "bound", "x", "p"])

    opened = homes.join(bounded.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    visits = opened.select("vec_id", "x", "p", "bound").mapInArrow(spread, "block long, is_query boolean, vec_id long, bound double, x array<double>, p array<double>")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = visited(visits).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
