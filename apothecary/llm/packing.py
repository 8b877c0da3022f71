"""Packing documents into sequences as a cutting-stock problem.

Pieces are counted by length class. A linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation: an
unbounded knapsack prices new patterns against the duals. Rounded-down
patterns and a first-fit rest give a pattern list, and ranked pieces of each
class are dealt to it. Only the histogram, bounded by the sequence length,
reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apothecary.llm.common import checkpointed, chosen, shuffle_partitions
from apothecary.llm.pretokens import ByteBpe

#: The pre-token pattern of byte-level BPE vocabularies: a fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut every ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    docs = chosen(docs, doc_id=id_col, text=text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, step = ByteBpe(path, BYTE_LEVEL), end_id.to_bytes(4, "little"), 4 * size
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.encoded(text or "") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    out.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _priced(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value within ``capacity``, by unbounded knapsack dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.searchsorted(sizes, room, side="right")
        if fits:
            values = duals[:fits] + best[room - sizes[:fits]]
            k = int(values.argmax())
            if values[k] > best[room] + 1e-12:
                best[room], choice[room] = values[k], k
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) pairs that use up ``demand`` exactly, close to the fewest sequences.

    ``sizes`` ascend, each within ``capacity``. The linear program's basic
    solution is rounded down; what is left goes by first fit, largest first.
    """
    m = len(sizes)
    if not m:
        return []
    basis, cost = np.diag(capacity // sizes).astype(float), np.ones(m)  # a pattern a column
    inverse, loosened = np.diag(1.0 / np.diag(basis)), demand + np.linspace(1e-4, 2e-4, m)  # no ties between leaving patterns
    bound = float(sizes @ demand) / capacity
    for _ in range(most_rounds):
        duals, weights = cost @ inverse, inverse @ loosened
        total, lowest = float(cost @ weights), int(duals.argmin())
        if duals[lowest] < -1e-9:  # more of a class than asked for may be cheaper
            column, price = -np.eye(1, m, lowest)[0], 0.0
        else:
            value, column = _priced(duals, sizes, capacity)
            bound, price = max(bound, total / max(value, 1e-9)), 1.0
            if value <= 1 + 1e-7:
                break
        if total - bound < max(0.5, 5e-4 * total):
            break
        entering = inverse @ column
        ratios = np.where(entering > 1e-9, weights / np.where(entering > 1e-9, entering, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out], cost[out] = column, price
        row = inverse[out] / entering[out]
        inverse -= np.outer(entering, row)
        inverse[out] = row
    times = inverse @ demand
    found, left = [], demand.copy()
    for k in range(m):
        pattern = basis[:, k].astype(np.int64)
        used = pattern > 0
        if not used.any():
            continue
        n = max(0, min(int(np.floor(times[k] + 1e-6)), int((left[used] // pattern[used]).min())))
        if n:
            found.append((pattern, n))
            left = left - n * pattern
    while left.any():
        pattern, room = np.zeros(m, dtype=np.int64), capacity
        for k in range(m - 1, -1, -1):
            n = min(int(left[k]), room // int(sizes[k]))
            pattern[k], room = n, room - n * int(sizes[k])
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        found.append((pattern, n))
        left = left - n * pattern
    return found


def _ranked(pieces: DataFrame) -> DataFrame:
    """Ranks from 0 within each class, counted by slices so that a frequent class never meets in one task."""
    slices = max(64, 2 * shuffle_partitions(pieces.sparkSession))
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)).cast("int"))
    counts = pieces.groupBy("size", "slice").count()
    sizes: dict[int, list] = {}
    for r in counts.collect():  # at most classes x slices rows
        sizes.setdefault(r["size"], []).append((r["slice"], r["count"]))
    before = []
    for size, found in sizes.items():
        total = 0
        for at, n in sorted(found):
            before.append((size, at, total))
            total += n
    bases = pieces.sparkSession.createDataFrame(before, "size int, slice int, base long")
    within = Window.partitionBy("size", "slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(bases), ["size", "slice"]).withColumn("rank", F.col("rank") + F.col("base")).drop("slice", "base")


def pack(pieces: DataFrame, size: int = 2048, grain: int = 8) -> DataFrame:
    """The pieces with sequence_id and offset; no sequence holds more than ``size`` tokens.

    Lengths are classed by ``grain`` tokens, rounded up. An empty input gives
    an empty result; equal pieces are ranked apart.
    """
    capacity = size // grain
    pieces = checkpointed(pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int")))
    histogram = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most size / grain rows
    sizes = np.array(sorted(histogram), dtype=np.int64)
    patterns = cutting_patterns(sizes, np.array([histogram[s] for s in sizes], dtype=np.int64), capacity)
    plan: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    at, first = dict.fromkeys(plan, 0), 0
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern):
            s, n = int(sizes[k]), int(pattern[k])
            plan[s].append((at[s], n, first))
            at[s] += n * times
        first += times
    steps = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for s, v in plan.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, ranks = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(ranks), dtype=np.int64)
            for s in np.unique(classes):
                rows = np.flatnonzero(classes == s)
                starts, counts, firsts = steps[int(s)]
                k = np.searchsorted(starts, ranks[rows], side="right") - 1
                sequence[rows] = firsts[k] + (ranks[rows] - starts[k]) // counts[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, rank long, sequence_id long"
    names = [c.split()[0] for c in columns.split(", ")]
    dealt = _ranked(pieces).select(*names[:-1]).mapInArrow(deal, columns)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.sum("length").over(before) - F.col("length")
    return dealt.withColumn("offset", offset).drop("size", "rank")
