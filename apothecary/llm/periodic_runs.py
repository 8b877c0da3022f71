"""Runs of repeated word sequences by string synchronising sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import chosen, slices

_LOAD = 1 << 20  # bytes of text that a task takes at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_OMITTED = np.uint64(0xFFFFFFFFFFFFFFFF)
LEAST_LENGTH, LEAST_EXPONENT = 6, 4


class _Names:
    """Exact names of the windows of 1, 2, 4, ... words: equal names, equal words.

    A window that occurs once is named by its place, n + start; so are those
    that the end cuts off. Naming ends where every window occurs once.
    """

    def __init__(self, ids: np.ndarray):
        self.n, self._places = len(ids), np.arange(len(ids))
        self.levels = [self._named(ids, self._places)]
        width = 1
        while (self.levels[-1] < self.n).any():
            last, at = self.levels[-1], self._places[: max(0, self.n - 2 * width + 1)]
            at = at[(last[at] < self.n) & (last[at + width] < self.n)]
            self.levels.append(self._named(last[at].astype(np.int64) * self.n + last[at + width], at))
            width *= 2

    def _named(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        repeated = counts[inverse] > 1
        out = (self.n + self._places).astype(np.int32 if self.n < 1 << 30 else np.int64)
        out[at[repeated]] = inverse[repeated]
        return out

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretches around ``at`` in which words ``period`` apart are equal."""
        right, left = at.copy(), at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            right += (names[right] == names[right + period]).astype(np.int64) << k
            before = left - (1 << k)
            held = np.maximum(before, 0)
            left = np.where((before >= 0) & (names[held] == names[held + period]), before, left)
        return left, right + period


def _synchronised(names: np.ndarray, tau: int, found: np.ndarray) -> np.ndarray:
    """The synchronising set at one scale: places chosen by the 2 tau words from there alone.

    A place is chosen where the least hash of the windows of ``tau`` words
    from it to ``tau`` places on is that of the first or the last of them.
    Windows in highly periodic regions, of a period of tau / 4 or less, are
    omitted; ``found`` has these regions from the scales below. Any other
    stretch of 3 tau - 1 words has a chosen place among its first tau.
    """
    order = names.astype(np.uint64) * _ODD
    order ^= order >> np.uint64(32)
    regions = found[(4 * found[:, 2] <= tau) & (found[:, 1] - found[:, 0] >= tau)]
    edges = np.zeros(len(names) + 1, dtype=np.int64)
    np.add.at(edges, regions[:, 0], 1)
    np.add.at(edges, regions[:, 1] - tau + 1, -1)
    order[np.cumsum(edges[:-1]) > 0] = _OMITTED
    least, width = order, 1
    while width < tau:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    return np.flatnonzero((least != _OMITTED) & ((least == order[: len(least)]) | (least == order[tau:])))


def runs_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows of start, end and smallest period of every maximal run of four periods or more.

    ``ids`` has a word of its own before, between and after the texts, so no
    run crosses them; ``longest`` is the length of the longest text. Scale tau
    has the periods from tau to 2 tau - 1: chosen places next to each other among
    those of equal 2 tau words propose their distance, and exact names decide.
    """
    names = _Names(ids)
    found = np.empty((0, 3), dtype=np.int64)
    for k in range(len(names.levels) - 1):
        tau, context = 1 << k, names.levels[k + 1]
        if LEAST_EXPONENT * tau > longest:
            break
        at = _synchronised(names.levels[k], tau, found)
        at = at[context[at] < names.n]
        at = at[np.argsort(context[at], kind="stable")]
        apart = at[1:] - at[:-1]
        paired = (context[at[1:]] == context[at[:-1]]) & (apart >= tau) & (apart < 2 * tau)
        at, period = at[:-1][paired], apart[paired]
        start, end = names.stretch(at, period)
        rows = np.unique(np.column_stack([start, end, period])[end - start >= LEAST_EXPONENT * period], axis=0)
        found = np.concatenate([found, rows])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)][: len(found)]  # a multiple of a period covers the same words
    return found[first & (found[:, 1] - found[:, 0] >= LEAST_LENGTH)]


def runs_and_kept(texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Of each UTF-8 text its runs (start, length, period) by start and period, and its words without the repeats."""
    words = [t.split() for t in texts]  # bytes split at the six ASCII blanks
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begins = np.cumsum(np.r_[1, sizes[:-1] + 1]) if len(sizes) else sizes
    known: dict[bytes, int] = {}
    ids = np.empty(int(sizes.sum()) + len(words) + 1, dtype=np.int64)
    bounds = np.r_[begins - 1, len(ids) - 1]
    for begin, of in zip(begins.tolist(), words, strict=True):
        ids[begin : begin + len(of)] = [known.setdefault(w, len(known)) for w in of]
    ids[bounds] = len(known) + np.arange(len(bounds))
    found = runs_of(ids, int(sizes.max(initial=0)))
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    first = np.searchsorted(found[:, 0], np.r_[begins, len(ids)])
    out = []
    for k, (begin, of) in enumerate(zip(begins.tolist(), words, strict=True)):
        own = found[first[k] : first[k + 1]]
        if len(own):
            of = [w for w, stays in zip(of, kept[begin : begin + len(of)].tolist(), strict=True) if stays]
        out.append(([(s - begin, e - s, q) for s, e, q in own.tolist()], b" ".join(of)))
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs among the words of each whole text: doc_id, ``runs`` and ``collapsed``.

    Words are what ASCII blanks part. A run is a stretch of words with smallest
    period q, of at least 6 words and 4 periods, that can't be extended either
    way; ``runs`` is an array of start (word number from 0), length and period
    by start and period. ``collapsed`` has the words joined by single blanks,
    of each run only the first period.

    One row a row of ``docs``: null and blank texts have no runs and an empty
    ``collapsed``, null ids stay null, repeated rows get equal results, other
    columns are left out whatever their names, and an empty table gives an
    empty result. Texts are read in the tasks that scan them, without a
    shuffle, a megabyte at a time; a longer text comes alone and takes some 200
    bytes a word.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in (g for whole in batches for g in slices(whole, "data", _LOAD)):
            found = runs_and_kept(batch.column("data").to_pylist())
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in found], kind)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "runs": runs, "collapsed": pa.array([c.decode() for _, c in found], pa.string())})

    data = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return data.mapInArrow(search, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string")
