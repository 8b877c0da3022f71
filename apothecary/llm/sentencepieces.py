"""SentencePiece encoding by a batched Viterbi search, and decoding.

The pieces and scores of a model file are read as a unigram model: a text's
ids are the segmentation of greatest total score. A text is cut at spaces
first, which no piece crosses. Distinct words of equal length advance
together: hashes of all their substrings probe the sorted piece keys, and
vectorised maxima over the last piece store backpointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import chosen
from apothecary.llm.pretokens import units

_MARK = "▁"
_PROBE = "Ａ  b\u00a0① ﬁ e\u0301 "  # nothing of this stays as it is under the usual normalisations
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


def _step(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of strings longer by one letter."""
    out = hashes * _BASE + letters + np.uint64(1)
    return (out ^ (out >> _SHIFT)) * _TURN


class UnigramModel:
    """Pieces and scores of a ``.model`` file with byte fallback and identity normalisation."""

    def __init__(self, path: str, cache: int = 500_000):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        if file.normalize(_PROBE) != _MARK + _PROBE.replace(" ", _MARK):
            raise ValueError("the file normalises texts: only identity normalisation behind a space in front is known here")
        size = file.get_piece_size()
        self.byte_ids = np.array([file.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        plain = [i for i in range(size) if not (file.is_control(i) or file.is_unknown(i) or file.is_unused(i) or file.is_byte(i))]
        pieces = [file.id_to_piece(i) for i in plain]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece holds a space after another letter")
        scores = np.array([file.get_score(i) for i in plain])
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self._keys, self._scores, self._ids = keys[order], scores[order], np.array(plain, dtype=np.int32)[order]
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self._letters = dict(zip(plain, pieces, strict=True))
        self._unknown = scores.min() - 10.0
        self._bytes = [file.id_to_piece(i).replace(_MARK, " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids):
            self._bytes[i] = bytes([b])
        for i in range(size):
            if file.is_control(i):
                self._bytes[i] = b""
        self._most, self._known = cache, {}

    @staticmethod
    def _key(text: str) -> int:
        h = np.zeros(1, dtype=np.uint64)
        for c in text:
            h = _step(h, np.array([ord(c)], dtype=np.uint64))
        return int(h[0])

    def _segment(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of words of one length."""
        n, length = len(words), len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, length).astype(np.uint64)
        most = min(self.longest, length)
        ids = np.full((n, length, most + 1), -1, dtype=np.int32)  # of the piece from a start with a length
        scores = np.full((n, length, most + 1), -np.inf)
        hashes = np.zeros((n, length), dtype=np.uint64)
        for size in range(1, most + 1):
            hashes = _step(hashes[:, : length - size + 1], letters[:, size - 1 :])
            at = np.minimum(np.searchsorted(self._keys, hashes), len(self._keys) - 1)
            found = self._keys[at] == hashes
            ids[:, : length - size + 1, size] = np.where(found, self._ids[at], -1)
            scores[:, : length - size + 1, size] = np.where(found, self._scores[at], -np.inf)
        scores[:, :, 1] = np.where(ids[:, :, 1] < 0, self._unknown, scores[:, :, 1])
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), dtype=np.int32)
        every = np.arange(n)
        for end in range(1, length + 1):
            sizes = np.arange(min(most, end), 0, -1)  # of equal scores the longest last piece wins
            reached = best[:, end - sizes] + scores[:, end - sizes, sizes]
            pick = reached.argmax(axis=1)
            best[:, end], back[:, end] = reached[every, pick], sizes[pick]
        end, taken, steps = np.full(n, length), np.zeros(n, dtype=np.int64), []
        while (end > 0).any():
            size = np.where(end > 0, back[every, end], 0)
            end = end - size
            taken += size > 0
            steps.append(np.where(size > 0, ids[every, np.minimum(end, length - 1), size], 0))
        path = np.stack(steps[::-1], axis=1).astype("<i4")  # each row's ids are its last
        odd = (path < 0).any(axis=1)
        total = path.shape[1]
        out = [path[k, total - taken[k] :].tobytes() for k in range(n)]
        for k in np.flatnonzero(odd):  # letters without a piece become their bytes
            found, at = [], 0
            for i in path[k, total - taken[k] :]:
                size = 1 if i < 0 else len(self._letters[i])
                found.append(self.byte_ids[list(words[k][at].encode("utf-8", "replace"))] if i < 0 else np.array([i]))
                at += size
            out[k] = np.concatenate(found).astype("<i4").tobytes()
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        learnt: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, 400_000 // (length * min(self.longest, length)))
            for low in range(0, len(group), step):
                part = group[low : low + step]
                learnt.update(zip(part, self._segment(part), strict=True))
        return learnt

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: of greatest total score, as the library gives them for a unigram model but for ties; none for an empty one."""
        known, cut = self._known, [units(text) if text else [] for text in texts]
        if len(known) > self._most:
            known.clear()
        new = set().union(*cut).difference(known)
        parts = {u: self._parts(u) for u in new}
        words = set().union(*parts.values())
        learnt = self._learn(words)
        for u, own in parts.items():
            known[u] = b"".join([learnt[w] for w in own])
        return [np.frombuffer(b"".join(map(known.__getitem__, u)), dtype="<i4") for u in cut]

    @staticmethod
    def _parts(unit: str) -> list[str]:
        """A unit behind its space mark, cut at line feeds, which no piece holds."""
        first, *later = unit.replace(" ", _MARK).split("\n")
        out = [_MARK + first]
        for part in later:
            out += ["\n", part] if part else ["\n"]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; the space that encoding puts in front is taken off. Invalid bytes become U+FFFD."""
        table, out = self._bytes, []
        for i in ids:
            joined = b"".join([table[k] for k in i.tolist()])
            out.append((joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace"))
        return out


def _rows(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ids (array of int) of each row of ``docs``.

    Null texts count as empty and have no ids; null ids and repeated rows
    stay; an empty table gives an empty result. The mark U+2581 inside a text
    is read as a space, as the library does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UnigramModel(path)
        for batch in batches:
            for part in _rows(batch, 500):
                ids = model.encode([(t or "").replace(_MARK, " ") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "text", "ids"])

    rows = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text of rows of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UnigramModel(path)
        for batch in batches:
            for part in _rows(batch, 500):
                texts = model.decode([np.array(i or [], dtype=np.int32) for i in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = chosen(encoded, doc_id=id_col, ids=ids_col).select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def encoded_and_decoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` with a further column ``decoded``: the text that ``decode`` gives for the ids, in one pass."""
    encoded = encode(docs, path, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UnigramModel(path)
        for batch in batches:
            for part in _rows(batch, 500):
                lists = part.column("ids")
                flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum([len(x) for x in lists])]
                texts = model.decode([flat[ends[k] : ends[k + 1]] for k in range(len(lists))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")
