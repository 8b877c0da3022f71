"""Token counts without token ids.

Every distinct pre-token is encoded once; documents are joined to those
counts through their pre-token frequencies and the products are summed.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.common import chosen, stored
from apothecary.llm.pretokens import units

_FLUSH = 800_000


def _counter(path: str):
    """A function from pre-tokens to their numbers of tokens, and whether pre-tokens keep their space."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda pieces: [len(ids) for ids in model.encode(pieces, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda pieces: [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def _keys(text: str, space: str) -> Counter:
    first, *later = units(text)
    found = Counter(later)
    if space:
        found = Counter({space + u: n for u, n in found.items()})
    found[first] += 1
    return found


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, head: int = 200_000) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_bytes, n_tokens and over_limit.

    ``path`` is a vocabulary file: ``.json`` for the tokenizers library,
    ``.model`` for sentencepiece. Counts are those of the library for the
    whole text, without added special tokens, truncation or padding.

    The ``head`` most frequent pre-tokens (a fixed bound) are broadcast with
    their counts, so the shuffled join holds the long tail only and no
    frequent word meets in one task.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows
    stay rows of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = chosen(docs, doc_id=id_col, text=text_col)
    space = "" if path.endswith(".model") else " "

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(_keys(text or "", space))
                if len(found) > _FLUSH:
                    yield pa.RecordBatch.from_pydict({"piece": list(found), "freq": list(found.values())})
                    found.clear()
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(found), pa.string()), "freq": pa.array(list(found.values()), pa.int64())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count(batch.column(0).to_pylist()), pa.int64())], names=["piece", "freq", "n"])

    vocabulary = docs.select("text").mapInArrow(frequencies, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    vocabulary = stored(vocabulary.mapInArrow(encode, "piece string, freq long, n long"))
    # The least frequency that leaves at most ``head`` pre-tokens, by half powers of two.
    step = F.floor(2 * F.log2("freq")).cast("int").alias("step")
    above, least = 0, None
    for r in vocabulary.groupBy(step).count().orderBy(F.desc("step")).collect():  # at most 128 rows
        above += r["count"]
        if above > head:
            break
        least = r["step"]
    frequent = vocabulary.where(F.floor(2 * F.log2("freq")) >= least).select("piece", "n").collect() if least is not None else []
    known = spark.sparkContext.broadcast({r.piece: r.n for r in frequent})

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, row = known.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: dict = {"row": [], "doc_id": [], "n_bytes": [], "piece_hash": [], "amount": []}
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    total, rare = 0, []
                    for piece, freq in _keys(text or "", space).items():
                        n = counts.get(piece)
                        if n is None:
                            rare.append((piece.encode(), freq))
                        else:
                            total += n * freq
                    # The document's own row comes first; its hash only spreads it.
                    out["row"] += [row] * (1 + len(rare))
                    out["doc_id"] += [doc_id] + [None] * len(rare)
                    out["n_bytes"] += [len((text or "").encode())] + [None] * len(rare)
                    out["piece_hash"] += [row * 0x5DEECE66D % (1 << 60)] + [_signed(xxhash.xxh64_intdigest(p, 42)) for p, _ in rare]
                    out["amount"] += [total << 17 | 1 << 16] + [f << 17 | zlib.crc32(p) & 65535 for p, f in rare]
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(per_document, "row long, doc_id long, n_bytes long, piece_hash long, amount long")
    # Pre-tokens meet by 80 bits of hash; bit 16 marks a document's own row, which meets none.
    hashed = vocabulary.select(F.xxhash64("piece").alias("piece_hash"), F.crc32(F.encode("piece", "UTF-8")).bitwiseAND(65535).alias("tag"), "n")
    joined = rows.withColumn("tag", F.col("amount").bitwiseAND(131071)).join(hashed, ["piece_hash", "tag"], "left")
    tokens = F.shiftright("amount", 17) * F.coalesce("n", F.lit(1))
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
