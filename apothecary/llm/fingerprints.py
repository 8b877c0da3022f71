"""I-Match fingerprints with several random lexicon subsets.

Terms whose inverse document frequency lies in a band form the lexicon. A
document's distinct lexicon terms are sorted, and the part of them in each of
several random subsets of the lexicon is hashed. A subset that misses every
changed term hashes alike, so the share of equal hashes tells how near two
documents are. Subsets come in halving rates, so that short and long
documents both find some that hold a few of their terms.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import chosen, shuffle_partitions, stored

_FIRST = -(2**63)  # the order of a null id
_FLUSH = 800_000


def terms(text: str) -> set[str]:
    """Distinct words in lower case, without the marks that end clauses."""
    for mark in ".,;:!?":
        text = text.replace(mark, " ")
    return set(text.lower().split())


def lexicon(docs: DataFrame, text_col: str = "text", most_often: float = 1 / 50, least_often: float = 1 / 1500) -> DataFrame:
    """Terms found in at least two documents and between the two shares of all documents, with their counts.

    A document with d distinct terms adds to at most d counts, so there are
    at most (mean d) / ``least_often`` terms, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(terms(text or ""))
                if len(found) > _FLUSH:
                    yield pa.RecordBatch.from_pydict({"term": list(found), "n": list(found.values())})
                    found.clear()
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    total = docs.count()
    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "term string, n long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("df"))
    return counts.where((F.col("df") >= max(2, total * least_often)) & (F.col("df") <= max(2, total * most_often)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    """Hashes of random subsets of a sorted lexicon: ``subsets`` of them, at rates 1/8, 1/16, ... 1/1024 in turn."""

    def __init__(self, lexicon: list[str], subsets: int = 128, seed: int = 7):
        self.subsets, self.seed = subsets, seed
        self._index = {t: k for k, t in enumerate(lexicon)}
        self._values, sizes, self._held = self._drawn(lexicon)
        self._from = np.r_[0, np.cumsum(sizes)]
        self._powers = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, dtype=np.uint64))

    def _drawn(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each term's hash, in how many subsets it is, and those subsets term by term."""
        salt = self.seed.to_bytes(8, "little")
        values = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=8, salt=salt).digest() for t in terms), dtype="<u8").astype(np.uint64)
        each = np.arange(self.subsets, dtype=np.uint64)
        bound = (2.0 ** (24 - 3 - np.arange(self.subsets) % 8)).astype(np.uint64)
        sizes, held = [], []
        for low in range(0, len(values), 8192):
            inside = (_spread(values[low : low + 8192, None] + each * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) < bound
            sizes.append(inside.sum(axis=1))
            held.append(np.nonzero(inside)[1].astype(np.uint16))
        return values, np.concatenate([np.empty(0, dtype=np.int64), *sizes]).astype(np.int64), np.concatenate([np.empty(0, dtype=np.uint16), *held])

    def known(self, words: set[str]) -> set[int]:
        """Places in the lexicon."""
        return {*map(self._index.get, words)} - {None}

    def __call__(self, text: str) -> str:
        words = terms(text)
        return self.of(self.known(words), lambda: words)

    def of(self, known: set[int], all_words: Callable[[], set[str]]) -> str:
        """Four hexadecimal digits a subset; 0000 where it holds none of the terms.

        A text without lexicon terms is hashed by all its terms; one without
        terms has zeros only.
        """
        words = known or all_words()
        if known:
            terms_at = np.sort(np.fromiter(known, dtype=np.int64, count=len(known)))
            sizes = self._from[terms_at + 1] - self._from[terms_at]
            subset = self._held[np.repeat(self._from[terms_at] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
            values = np.repeat(self._values[terms_at], sizes)
        elif words:
            each, sizes, subset = self._drawn(sorted(words))
            values = np.repeat(each, sizes)
        hashes = np.zeros(self.subsets, dtype=">u2")
        if words and len(subset):
            order = np.argsort(subset, kind="stable")  # each subset's terms together, still sorted
            subset, values = subset[order], values[order]
            begin = np.flatnonzero(np.r_[True, subset[1:] != subset[:-1]])
            rank = np.arange(len(subset)) - np.repeat(begin, np.diff(np.r_[begin, len(subset)]))
            mixed = np.add.reduceat(values * self._powers[rank & 1023], begin)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            hashes[subset[begin]] = (mixed >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        return hashes.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal hashes among the subsets that hold a term of either; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f), dtype=">u2") for f in (a, b))
    either = (x > 0) | (y > 0)
    return float(((x == y) & either).sum() / either.sum())


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents in ranges of ascending id, each range followed by a copy of the next range's first document.

    The ranges' bounds and firsts, one a shuffle partition, are all that the driver sees.
    """
    from pyspark.ml.feature import Bucketizer

    parts = shuffle_partitions(docs.sparkSession)
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(_FIRST)).cast("long")).withColumn("at", F.col("key").cast("double"))
    bounds = sorted(set(docs.select("at").approxQuantile("at", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    if bounds:
        inner = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="at", outputCol="range").transform(docs)
        docs = inner.withColumn("range", F.col("range").cast("int"))
    else:
        docs = docs.withColumn("range", F.lit(0))
    firsts = sorted((r["range"], r["first"]) for r in docs.groupBy("range").agg(F.min("key").alias("first")).collect())
    before = [(firsts[k - 1][0], first) for k, (_, first) in enumerate(firsts)]
    copies = docs.sparkSession.createDataFrame(before, "before int, key long")
    places = F.array(F.struct("range", F.lit(False).alias("copy")))
    also = F.when(F.col("before").isNotNull(), F.array(F.struct(F.col("before").alias("range"), F.lit(True).alias("copy")))).otherwise(F.array().cast("array<struct<range:int,copy:boolean>>"))
    placed = docs.join(F.broadcast(copies), "key", "left").withColumn("place", F.explode(F.concat(places, also)))
    placed = placed.select("place.range", "place.copy", "key", "doc_id", "text")
    return placed.repartition(parts, "range").sortWithinPartitions("range", "copy", "key", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", subsets: int = 128) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how near they are.

    The edited text has the last quarter of the code points (rounded down)
    replaced by the first as many of the next document's, by ascending id;
    the first document follows the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    ``edited`` itself.

    Null texts count as empty; null ids come first; rows that share an id are
    ordered by text, and repeated rows follow each other. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    docs = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited string"
    if docs.isEmpty():
        return spark.createDataFrame([], schema)
    words = spark.sparkContext.broadcast(sorted(r.term for r in stored(lexicon(docs).select("term")).collect()))
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(words.value, subsets)
        out: list[tuple] = []
        held: tuple | None = None
        for batch in batches:
            for where, copy, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("range", "copy", "doc_id", "text")), strict=True):
                keep = len(text) - len(text) // 4
                cut = max(text.rfind(" ", 0, keep), 0)  # no term crosses it
                head = prints.known(terms(text[:cut]))
                own = prints.of(head | prints.known(terms(text[cut:])), lambda text=text: terms(text))
                if held and held[0] == where and not held[1]:
                    out.append(_compared(prints, held, own, text))
                held = (where, copy, doc_id, text, own, cut, head)
            if out:
                yield _batch(out, names)
                out = []

    return _ordered(docs).mapInArrow(compare, schema)


def _compared(prints: Fingerprinter, row: tuple, next_print: str, next_text: str) -> tuple:
    _, _, doc_id, text, own, cut, head = row
    n = len(text) // 4
    edited = text[: len(text) - n] + next_text[:n]
    other = prints.of(head | prints.known(terms(edited[cut:])), lambda: terms(edited))
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, next_print), edited


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
