"""All pairs of documents whose word shingles have a Jaccard likeness of a threshold or more.

Candidates share a band of MinHash values. They are compared a few MinHash
values at a time; a pair is dropped when the posterior probability that it
reaches the threshold falls below a tolerance, and the rest are verified
exactly on their shingles. Candidates are linked through the least member of
each band bucket, the linked sets, or their buckets where that sends fewer
copies, are dealt in blocks, and pairs exist only inside a task, as matrices:
a group of thousands of near copies never becomes a table of pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import chosen, shuffle_partitions, slices, stored
from apothecary.llm.components import connected_components

#: Values in a band and bands: a pair at likeness 0.8 shares none with probability 1e-6.
ROWS, BANDS = 6, 46
_U = np.uint64
_STEP = 23  # MinHash values compared at a time


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word: values of its bytes times powers of an odd number, by sums over the joined text."""
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out, done = [], 0
    while done < len(data):  # long texts go block by block, cut behind a word
        block = data[done : done + _BLOCK]
        if done + len(block) < len(data):
            gaps = np.flatnonzero(block == 32)
            block = block[: gaps[-1]] if len(gaps) else data[done : done + int(np.argmax(data[done:] == 32))] if (data[done:] == 32).any() else data[done:]
        gaps = np.flatnonzero(block == 32)
        begin, end = np.r_[0, gaps + 1], np.r_[gaps, len(block)]
        place = np.arange(len(block)) - np.repeat(begin, np.diff(np.r_[begin, len(block)]))
        sums = np.r_[_U(0), np.cumsum(_BYTES[block] * _POWERS[place & 1023] + (place >> 10).astype(_U))]
        out.append(_mix(sums[end] - sums[begin] + (end - begin).astype(_U)))
        done += len(block) + 1
    return np.concatenate(out)


_BLOCK = 1 << 18
_GAP = re.compile(r"\s")
_BYTES = np.random.default_rng(41).integers(1, 2**64 - 1, 256, dtype=_U)
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, dtype=_U))


def text_blocks(text: str, size: int = 1 << 16) -> Iterator[str]:
    """A text in parts of about ``size`` letters, cut at white space, so that the words of a long one are never all held."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def text_hashes(text: str) -> np.ndarray:
    """The hashes of a text's words, in order."""
    found = [word_hashes(words) for words in map(str.split, text_blocks(text)) if words]
    return np.concatenate(found) if found else np.empty(0, dtype=_U)


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Distinct runs of ``width`` words as sorted 64-bit hashes; a shorter text is one shingle."""
    h = text_hashes(text)
    if not len(h):
        return np.empty(0, dtype=_U)
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, dtype=_U)
    for k in range(width):
        out = _mix(out + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(97).integers(1, 2**32, (2, n), dtype=np.uint32)
    return a | np.uint32(1), b


def minhashes(found: np.ndarray, n: int = ROWS * BANDS) -> np.ndarray:
    a, b = _factors(n)
    least, low = np.full(n, 2**32 - 1, dtype=np.uint32), (found >> _U(32)).astype(np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at : at + 512, None] * a + b).min(axis=0), out=least)
    return least


def _bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS).astype(_U)
    key = np.arange(BANDS, dtype=_U)
    for k in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + parts[:, k])
    return key


def _first_shared(signatures: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band that each pair shares, or ``BANDS``."""
    same = (signatures[left] == signatures[right]).reshape(-1, BANDS, ROWS).all(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)


def least_matches(threshold: float, tolerance: float, most: int = ROWS * BANDS) -> dict[int, int]:
    """For n compared values, the fewest equal ones with which a pair stays.

    Under a uniform prior the likeness given m of n equal is Beta(m + 1, n - m + 1),
    which reaches the threshold with the probability of at most m successes in n + 1 draws.
    """
    found = {}
    for n in range(_STEP, most + 1, _STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                found[n] = m
                break
    return found


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of shared shingles of each pair: by matrix product where pairs are many."""
    if len(left) < 400:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], dtype=np.int64)
    members = np.unique(np.r_[left, right])
    sizes = [len(sets[i]) for i in members]
    values, where = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
    row = np.repeat(np.arange(len(members)), sizes)
    common = np.bincount(where, minlength=len(values)) > 1
    place = np.cumsum(common) - 1
    keep = common[where]
    row, column = row[keep], place[where[keep]]
    product = np.zeros((len(members), len(members)), dtype=np.float32)
    for low in range(0, int(common.sum()), 8192):
        inside = (column >= low) & (column < low + 8192)
        dense = np.zeros((len(members), 8192), dtype=np.float32)
        dense[row[inside], column[inside] - low] = 1
        product += dense @ dense.T
    at = np.searchsorted(members, left), np.searchsorted(members, right)
    return product[at].astype(np.int64)


def _linked(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float, stay: dict[int, int], band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (one of ``first``, a later one or one of ``second``) that share a band and reach the threshold, tile by tile.

    With ``band`` of 0 or more, only pairs of which it is the first shared one.
    """
    signatures = np.array([minhashes(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    same = first is second
    for a in range(0, len(first), 256):
        for b in range(a if same else 0, len(second), 256):
            x, y = first[a : a + 256], second[b : b + 256]
            left, right = (v.ravel() for v in np.meshgrid(x, y, indexing="ij"))
            ratio = np.minimum(sizes[left], sizes[right]) / np.maximum(sizes[left], sizes[right])
            go = ratio >= threshold - 1e-12
            if same and a == b:
                go &= left < right
            left, right = left[go], right[go]
            matches = np.zeros(len(left), dtype=np.int64)
            for n, least in stay.items():
                matches += (signatures[left, n - _STEP : n] == signatures[right, n - _STEP : n]).sum(axis=1)
                go = matches >= least
                left, right, matches = left[go], right[go], matches[go]
                if not len(left):
                    break
            if len(left):
                bands = _first_shared(signatures, left, right)
                go = bands == band if band >= 0 else bands < BANDS
                left, right = left[go], right[go]
            if len(left):
                shared = _overlaps(sets, left, right)
                go = shared >= threshold * (sizes[left] + sizes[right] - shared) - 1e-9
                yield left[go], right[go]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member that each of n can reach."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for left, right in pairs:
            low = np.minimum(root[left], root[right])
            np.minimum.at(root, left, low)
            np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def _verify(threshold: float, tolerance: float):
    """Of rows sorted by task: links and a least linked member for each text of each task."""

    def settle(key: tuple, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        stay = least_matches(threshold, tolerance)
        _, band, one, two = key
        texts = np.array([r[0] for r in rows], dtype=np.int64)
        sets = [np.frombuffer(r[2], dtype=_U) for r in rows]
        block = np.array([r[1] for r in rows])
        everyone = np.arange(len(rows))
        first, second = (everyone, everyone) if one == two else (everyone[block == one], everyone[block == two])
        pairs = list(_linked(sets, first, first if first is second else second, threshold, stay, band))
        links = np.zeros(len(rows), dtype=np.int64)
        for left, right in pairs:
            links += np.bincount(left, minlength=len(rows)) + np.bincount(right, minlength=len(rows))
        root = texts[_roots(len(rows), pairs)]
        found = links > 0
        return pa.RecordBatch.from_arrays([pa.array(texts[found]), pa.array(root[found]), pa.array(links[found])], names=["text_key", "root", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for part in slices(batch, "shingles"):
                for *now, text, block, found in zip(*(part.column(n).to_pylist() for n in ("group", "band", "one", "two", "text_key", "block", "shingles")), strict=True):
                    if tuple(now) != key:
                        if len(rows) > 1:
                            yield settle(key, rows)
                        key, rows = tuple(now), []
                    if not rows or rows[-1][0] != text:
                        rows.append((text, block, found))
        if len(rows) > 1:
            yield settle(key, rows)

    return run


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-8, block: int = 2048, block_shingles: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """One row a row of ``docs``: doc_id, class_id, n_links and n_copies.

    Shingles are the distinct runs of ``width`` words (parted by white space);
    a text of fewer words is one shingle. ``class_id`` is the least id among
    the documents that links and equal shingle sets connect. ``n_links``
    counts the different texts (shingle sets) at ``threshold`` or more;
    ``n_copies`` the documents with this very set, itself included.

    Null texts and texts without words link to nothing and are classes of
    their own (n_copies 1). Rows that repeat an id and a text are copies. A
    null id is the least only where all are null. An empty table gives an
    empty result.

    A task compares two blocks of at most about ``block`` texts and
    ``block_shingles`` shingles, a text at least.

    Where ids may repeat with different texts, ``keys`` adds text_hash (xxhash64
    of the text), which tells the rows of an id apart, and root, which tells
    classes with the same least id apart (null without words).
    """
    spark = docs.sparkSession
    hashed, rooted = (["text_hash"], ["root"]) if keys else ([], [])
    docs = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most_rows=500):
                keys, bands, sizes = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text or "", width)
                    keys.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                    bands.append(_bands(minhashes(s)).view(np.int64).tolist() if len(s) else [])
                    sizes.append(len(s))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "text_key", "size", "bands"])

    sketched = stored(docs.mapInArrow(sketch, "doc_id long, text_hash long, text_key long, size long, bands array<long>"))
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
    texts = sketched.where("text_key is not null").groupBy("text_key").agg(one, F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = stored(texts.select("text_key", F.col("one.doc_id").alias("first_id"), F.col("one.text_hash").alias("first_hash"), "n_copies", "size", "bands"))

    banded = texts.select("text_key", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("text_key").alias("least"), F.count("*").alias("n")).where("n > 1")
    near = stored(banded.join(buckets, "bucket").select("text_key", "band", "bucket", "least"))
    sets = connected_components(near.where("text_key <> least").select(F.col("text_key").alias("u"), F.col("least").alias("v"))).withColumnRenamed("node", "text_key")
    sets = stored(sets.join(texts.select("text_key", "first_id", "first_hash", "size"), "text_key"))
    dealt = stored(_dealt(sets, near, block, block_shingles))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of rows given many times, a task passes on one
        for batch in batches:
            for part in slices(batch, "text", most_rows=500):
                found, keep = [], []
                for text, key in zip(part.column("text").to_pylist(), part.column("text_key").to_pylist(), strict=True):
                    found.append(shingles(text or "", width) if key not in done else np.empty(0, dtype=_U))
                    keep.append(len(found[-1]) > 0 and xxhash.xxh3_64_intdigest(found[-1].tobytes()) - 2**63 == key)
                    if keep[-1]:
                        done.add(key)
                if len(done) > 1_000_000:
                    done.clear()
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column("text_key"), part.column("places"), pa.array([s.tobytes() for s in found])], names=["text_key", "places", "shingles"]).filter(keep)

    places = F.collect_list(F.struct("group", "band", "block", "n_blocks")).alias("places")
    of_text = dealt.groupBy("text_key", "first_id", "first_hash").agg(places)
    found = docs["doc_id"].eqNullSafe(of_text["first_id"]) & (docs["text_hash"] == of_text["first_hash"])
    rows = docs.join(of_text.hint("shuffle_hash"), found).select("text_key", "places", "text")
    rows = rows.mapInArrow(shingle, "text_key long, places array<struct<group:long,band:int,block:int,n_blocks:int>>, shingles binary")
    rows = rows.select("text_key", "shingles", F.inline("places")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("text_key", "group", "band", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "shingles")
    tasks = rows.repartition(shuffle_partitions(spark), "group", "band", "one", "two").sortWithinPartitions("group", "band", "one", "two", "text_key")
    verified = stored(tasks.mapInArrow(_verify(threshold, tolerance), "text_key long, root long, n_links long"))

    links = verified.groupBy("text_key").agg(F.sum("n_links").alias("n_links"))
    classes = connected_components(verified.select(F.col("text_key").alias("u"), F.col("root").alias("v")))
    joined = texts.select("text_key", "first_id", "n_copies").join(classes.withColumnRenamed("node", "text_key"), "text_key", "left").join(links, "text_key", "left")
    joined = joined.withColumn("root", F.coalesce("root", "text_key"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("class_id"))
    joined = joined.join(least, "root").select("text_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", *rooted)
    worded = sketched.where("text_key is not null").select("doc_id", *hashed, "text_key").join(joined, "text_key").drop("text_key")
    alone = sketched.where("text_key is null").select("doc_id", *hashed, F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), *(F.lit(None).cast("long").alias(c) for c in rooted))
    return worded.unionByName(alone)


def _blocks(sets: DataFrame, key: str, block: int, block_shingles: int) -> DataFrame:
    """Of each group its shingles and the number of blocks it is dealt to."""
    wanted = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_shingles))
    return sets.groupBy(key).agg(F.sum("size").alias("shingles"), wanted.cast("int").alias("n_blocks"))


def _dealt(sets: DataFrame, near: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Where each text is compared: (text_key, first_id, first_hash, group, band, block, n_blocks).

    A linked set is one group (band -1) and each of its blocks meets each
    other. Where links through third texts have made a set so large that its
    band buckets, each dealt in blocks of its own, send fewer copies of
    texts, the buckets are the groups. Both ways compare every pair that shares a band.
    """
    whole = _blocks(sets, "root", block, block_shingles)
    large = whole.where("n_blocks > 1")
    inside = near.select("text_key", "band", "bucket").join(sets.join(large.select("root"), "root", "left_semi"), "text_key")
    parts = _blocks(inside, "bucket", block, block_shingles)
    cost = inside.select("root", "bucket").distinct().join(parts, "bucket").groupBy("root").agg(F.sum(F.col("shingles") * F.col("n_blocks")).alias("cost"))
    apart = large.join(cost, "root").where(F.col("cost") < F.col("shingles") * F.col("n_blocks")).select("root")
    by_set = sets.join(whole, "root").join(apart, "root", "left_anti").select("text_key", "first_id", "first_hash", F.col("root").alias("group"), F.lit(-1).alias("band"), "n_blocks")
    by_bucket = inside.join(apart, "root", "left_semi").join(parts, "bucket").select("text_key", "first_id", "first_hash", F.col("bucket").alias("group"), "band", "n_blocks")
    return by_set.unionByName(by_bucket).withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("n_blocks")).cast("int"))
