"""Removing repeated substrings by refining buckets of text positions.

A suffix array sorted by bucket-pointer refinement starts from q-gram
buckets and refines each by the bucket identifiers found at later offsets,
reusing every update. Here the identifiers are 64-bit values built the same
way, by doubling: the identifier of 2k bytes mixes the identifiers of k bytes
at offsets 0 and k. Only as many positions are bucketed as can decide:

* The initial buckets hold *anchors*: positions whose q-gram identifier is the
  least among those of some string of ``length`` bytes. Equal strings have
  their anchor at the same offset, so they meet in the same bucket. Buckets of
  one anchor are final.
* The rest are refined by the identifier of the whole range of strings that
  the anchor stands for. Anchors equal in it repeat all those strings.
* Buckets that fall apart there are refined by what all strings of a few
  neighbouring offsets have in common, and last string by string.

Anchors repeated inside a batch are settled there, before any shuffle, and
counts are pre-aggregated, so a passage in a third of all documents doesn't
meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from apothecary.llm.common import Bits, slices, stored

_Q = 32
_CELL = 17  # neighbouring offsets refined together
_FIRST = -(2**63)  # the order of a null id
_LOAD = 1 << 19  # bytes of text that a task searches at a time
_U = np.uint64


def _byte_ids() -> np.ndarray:
    return np.random.default_rng(20_240_517).integers(1, 2**64 - 1, 256, dtype=_U, endpoint=True)


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Identifiers of joined strings from those of their parts; ``k`` names the level."""
    out = a * _U(0x9E3779B97F4A7C15 + 2 * k)
    out += b
    out ^= out >> _U(29)
    out *= _U(0xBF58476D1CE4E5B9)
    return out


class _Buckets:
    """Identifiers of all positions of concatenated texts, level by level."""

    def __init__(self, data: np.ndarray, length: int):
        level, self.length = _byte_ids()[data], length
        k = 1
        while 2 * k <= length - _CELL:
            level = _mixed(level[:-k], level[k:], k) if len(level) > k else level[:0]
            k *= 2
            if k == _Q:
                self.q = level
        self.largest, self._top = k, level

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """Identifiers of the ``length`` bytes at each start."""
        return _mixed(self._top[starts], self._top[starts + (self.length - self.largest)], 99)

    def cores(self, anchors: np.ndarray, cell: int) -> np.ndarray:
        """Identifiers of the bytes that the strings of one cell of offsets before their anchor share."""
        starts = anchors - _CELL * cell
        return _mixed(self._top[starts], self._top[starts + (self.length - _CELL + 1 - self.largest)], 98 - cell)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def _runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts joined in ``data``: anchor identifier, identifier of its range, first and last start it stands for, how far it lies behind the first, 16 bits of each cell's core."""
    none = np.empty(0, dtype=np.int64)
    nothing = none.astype(_U), none.astype(_U), none, none, none, np.empty((0, 2), dtype=np.int64)
    if len(data) < length:
        return nothing
    buckets = _Buckets(data, length)
    keys = (buckets.q & _U(0xFFFFFFFFF0000000)) | np.arange(len(buckets.q), dtype=_U)
    anchor = (_least(keys, length - _Q + 1) & _U(0x0FFFFFFF)).astype(np.int64)  # of each start
    valid = np.ones(len(anchor), dtype=bool)
    for end in ends:  # a string may not run over the end of its text
        valid[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return nothing
    cut = np.flatnonzero((np.diff(anchor[starts]) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.r_[0, cut]], starts[np.r_[cut, len(starts)] - 1]
    at = anchor[first]
    shape = ((last - first) * 256 + (at - first)).astype(_U)
    packed = np.zeros((len(at), 2), dtype=_U)
    for cell in range(8):
        inside = np.flatnonzero(((at - last) // _CELL <= cell) & (cell <= (at - first) // _CELL))
        if len(inside):
            core = (buckets.cores(at[inside], cell) >> _U(40)) % _U(65535) + _U(1)
            packed[inside, cell // 4] |= core << _U(16 * (cell % 4))
    return buckets.q[at], _mixed(_mixed(buckets.strings(first), buckets.strings(last), 7), shape, 8), first, last, at - first, packed.view(np.int64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends - sizes, ends


def _loads(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, places and bytes of the texts of a batch, about ``_LOAD`` bytes at a time.

    A longer text comes in parts, each a load by itself, that overlap by
    ``length`` - 1 bytes: every string of ``length`` bytes is whole in one.
    """
    rows, parts, total = [], [], 0
    for part in slices(batch, "data", _LOAD):
        for row, text in zip(part.column("row").to_pylist(), part.column("data").to_pylist(), strict=True):
            if parts and total + len(text) > _LOAD:
                yield rows, [0] * len(rows), parts
                rows, parts, total = [], [], 0
            if len(text) > _LOAD:
                for at in range(0, len(text) - length + 1, _LOAD):
                    yield [row], [at], [text[at : at + _LOAD + length - 1]]
                continue
            rows.append(row)
            parts.append(text)
            total += len(text)
    if parts:
        yield rows, [0] * len(rows), parts


def _numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.append_column("row", pa.array(np.arange(batch.num_rows)))


def _anchors(length: int, shared: Bits | None = None):
    """Rows (kind 0: anchors; 1: settled repeats) of bucket, range, key, tag, start and number of starts.

    With ``shared``, of the anchors only those whose bucket may hold others.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_numbered, batches):
            keys, tags = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tag"))
            before = np.empty(0, dtype=_U)  # classes in the parts of a long text so far
            for rows, places, texts in _loads(batch, length):
                data, begins, ends = _joined(texts)
                bucket, ranged, first, last, back, cells = _runs(data, ends, length)
                piece = np.searchsorted(ends, first, side="right")
                row, start = np.array(rows)[piece], first - begins[piece] + np.array(places)[piece]
                key, tag = keys[row], tags[row]
                order = np.lexsort((start, tag, key, ranged, bucket))
                columns = [x[order] for x in (bucket, ranged, key, tag, start)]
                equal = [np.r_[False, x[1:] == x[:-1]] if len(x) else np.zeros(0, dtype=bool) for x in columns]
                member = equal[0] & equal[1]  # not the first of its class
                head = np.maximum.accumulate(np.where(member, 0, np.arange(len(order))))
                again = member & ((columns[2] != columns[2][head]) | (equal[2] & equal[3]))
                if len(rows) == 1:
                    kinds = _mixed(bucket, ranged, 9)
                    again |= np.isin(kinds[order], before) & (places[0] > 0)
                    before = np.union1d(before, kinds) if places[0] else kinds
                copy = member & equal[2] & equal[3] & equal[4]  # of a row given twice
                keep = ~copy & (again | shared.has(columns[0].view(np.int64))) if shared else ~copy
                kind, order = again[keep].astype(np.int64), order[keep]
                bucket, ranged, key, tag, start, first, last, back, cells = (x[order] for x in (bucket, ranged, key, tag, start, first, last, back, cells))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (kind, bucket.view(np.int64), ranged.view(np.int64), key, tag, (start << 8) | (last - first + 1), back, cells[:, 0], cells[:, 1])],
                    names=["kind", "bucket", "ranged", "key", "tag", "at", "back", "cells", "more_cells"],
                )

    return find


def _strings(length: int):
    """Rows (string, key, tag, start) of every start of the given ranges of a text; kind 1: repeated in this text.

    A text goes part by part, with the strings that it held before in mind.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "data", _LOAD)):
            for key, tag, text, ranges in zip(*(part.column(n).to_pylist() for n in ("key", "tag", "data", "ranges")), strict=True):
                data, spans = np.frombuffer(text, dtype=np.uint8), np.array(_unpacked(ranges), dtype=np.int64).reshape(-1, 2)
                before = np.empty(0, dtype=_U)
                for low in range(0, len(data), _LOAD):
                    near = spans[(spans[:, 0] < low + _LOAD) & (spans[:, 0] + spans[:, 1] > low)]
                    if not len(near):
                        continue
                    starts = np.unique(np.concatenate([np.arange(max(a, low), min(a + n, low + _LOAD)) for a, n in near]))
                    strings = _Buckets(data[low : low + _LOAD + length], length).strings(starts - low)
                    kind = np.ones(len(starts), dtype=np.int64)
                    kind[np.unique(strings, return_index=True)[1]] = 0
                    kind[np.isin(strings, before)] = 1
                    if len(data) > low + _LOAD:
                        before = np.union1d(before, strings)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kind), pa.array(strings.view(np.int64)), *(pa.array(np.full(len(starts), x, dtype=np.int64)) for x in (key, tag)), pa.array((starts << 8) | 1)],
                        names=["kind", "string", "key", "tag", "at"],
                    )

    return find


def _cut(length: int):
    """What is left of each text, and what was removed; ``rest`` goes along."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (g for whole in batches for g in slices(whole, "data", _LOAD)):
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for doc_id, text, ranges in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "data", "ranges")), strict=True):
                spans: list[list[int]] = []
                for first, n in _unpacked(ranges):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], first + n - 1 + length)
                    else:
                        spans.append([first, first + n - 1 + length])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                row = (doc_id, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"), [x for s in spans for x in s])
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
            columns = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("rest")], names=[*out, "rest"])

    return cut


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the bytes that a string of ``length`` bytes covers which starts earlier too.

    Earlier is a smaller id, or the same document and an earlier start. One
    row a row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of
    the remaining bytes, ``kept`` (those bytes as text; bytes of a character
    that was cut through are left out) and ``spans`` (start and end of each
    removed run). The columns named in ``carry`` come along in a struct ``rest``.

    Null texts count as empty; a null id comes before all others; texts
    shorter than ``length`` stay whole; long ones are searched part by part.
    Rows that share an id come at one place in the order: none is earlier than
    another, and a row given twice gets the same result twice. They are told
    apart by a 64-bit hash of their text. An empty table gives an empty result.
    ``length`` is 84 to 128.
    """
    if not 84 <= length <= 128:
        raise ValueError("length is 84 to 128")
    rest = F.struct(*([F.col(f"`{c}`") for c in carry] or [F.lit(True).alias("given")]))
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest")).select(
        "rest",
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("doc_id", F.lit(_FIRST)).cast("long").alias("key"),
        F.xxhash64("text").alias("tag"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"),
    )
    long = docs.where(F.length("data") >= length).select("key", "tag", "data")
    columns = "kind long, bucket long, ranged long, key long, tag long, at long, back long, cells long, more_cells long"
    counts = long.mapInArrow(_anchors(length), columns).where("kind = 0").groupBy("bucket").count()
    repeated = stored(counts.where("count > 1").select("bucket"))
    found = stored(long.mapInArrow(_anchors(length, Bits(repeated, "bucket", repeated.count())), columns))
    text = ("key", "tag")
    settled = found.where("kind = 1").select(*text, "at")

    anchors = found.where("kind = 0").drop("kind")
    classes = anchors.groupBy("bucket", "ranged").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    classes = stored(classes)
    split = classes.groupBy("bucket").count().where("count > 1").select("bucket", F.lit(True).alias("split"))
    refined = stored(classes.join(split, "bucket", "left").where("n > 1 or split"))
    members = anchors.join(refined, ["bucket", "ranged"]).where("key <> first or split")
    is_first = F.col("key") == F.col("first")
    details = [F.when(is_first, F.col(c)).alias(c) for c in ("bucket", "back", "cells", "more_cells")]
    members = stored(members.select(*text, "at", is_first.alias("is_first"), *details))
    again = members.where("not is_first").select(*text, "at")
    open_ranges = stored(_by_text(_alike_cells(members.where("is_first"))))
    strings = _parted(docs, open_ranges)[1].where("ranges is not null").select(*text, "data", "ranges")
    strings = stored(strings.mapInArrow(_strings(length), "kind long, string long, key long, tag long, at long"))
    earliest = strings.where("kind = 0").groupBy("string").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    late = stored(strings.where("kind = 0").join(earliest, "string").where("key <> first").select(*text, "at"))
    late = late.unionByName(strings.where("kind = 1").select(*text, "at"))

    removed = stored(_by_text(settled.unionByName(again).unionByName(late)))
    result = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<long>").add(docs.schema["rest"])
    untouched, cut = _parted(docs, removed)
    whole = untouched.select("rest", "doc_id", "data", F.lit(None).cast("array<long>").alias("ranges")).mapInArrow(_cut(length), result)
    return whole.unionByName(cut.select("rest", "doc_id", "data", "ranges").mapInArrow(_cut(length), result))


def _parted(docs: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that surely have no ranges, which stay where they are, and the others joined to theirs."""
    slot = F.xxhash64("key", "tag")
    seen = Bits(ranges.select(slot.alias("slot")), "slot", ranges.count()).column("slot")
    marked = docs.withColumn("slot", slot).withColumn("seen", seen)
    return marked.where("not seen"), marked.where("seen").join(ranges.hint("shuffle_hash"), ["key", "tag"], "left")


def _alike_cells(anchors: DataFrame) -> DataFrame:
    """Of the anchors' ranges the parts of which another anchor of the bucket has an equal core."""
    core = [F.shiftrightunsigned(F.col("cells" if cell < 4 else "more_cells"), 16 * (cell % 4)).bitwiseAND(65535) for cell in range(8)]
    cells = F.array(*[F.struct(F.lit(cell).alias("cell"), c.alias("core")) for cell, c in enumerate(core)])
    rows = anchors.withColumn("one", F.explode(F.filter(cells, lambda c: c["core"] > 0))).select("bucket", "key", "tag", "at", "back", "one.cell", "one.core")
    alike = rows.groupBy("bucket", "cell", "core").count().where("count > 1").select("bucket", "cell", "core")
    rows = rows.join(alike, ["bucket", "cell", "core"], "left_semi")
    start = F.shiftright("at", 8)
    nearest = start + F.col("back") - F.col("cell") * _CELL
    low = F.greatest(start, nearest - (_CELL - 1))
    high = F.least(start + F.col("at").bitwiseAND(255) - 1, nearest)
    return rows.select("key", "tag", (F.shiftleft(low, 8) + (high - low + 1)).alias("at"))


def _by_text(rows: DataFrame) -> DataFrame:
    """The ranges of each text, told apart by key and 64-bit hash, in one array, packed as they are: start, number of starts."""
    return rows.groupBy("key", "tag").agg(F.collect_list("at").alias("ranges"))


def _unpacked(ranges: list[int] | None) -> list[tuple[int, int]]:
    """First start and number of starts of each range, in order."""
    return sorted((r >> 8, r & 255) for r in ranges or ())
