"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_ROW_GROUP = 32 << 20  # what a writer of an intermediate table buffers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage as a Parquet table in the shared folder: smaller than a checkpoint.

    In a loop it also cuts the optimizer's constraints, which a checkpoint
    keeps and which double from round to round.

    Nothing before the table is read again, so the shuffle files that made it
    are removed when it is written. Tables of one application lie in one
    folder, which ``clear_stored`` removes when their results are written.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{_stored_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(cleanup, None)
    if before is not None:
        spark.conf.set(cleanup, "true")
    try:
        df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def _stored_folder(spark: SparkSession) -> str:
    return f"{_shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Removes the tables that ``stored`` wrote in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_stored_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most_rows`` rows and about ``most_bytes`` bytes of a column, a row at least: what a task unpacks at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and (total + n > most_bytes or k - at == most_rows):
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if len(sizes) > at:
        yield batch.slice(at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chosen(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns never clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


class Bits:
    """A bitmap over the low bits of a column of hashes.

    It thins what a join would shuffle before the exact join: a hash whose bit
    is not set has no match. It has some 32 bits for each of ``rows`` hashes,
    2 ** 28 bits (32 MB) at most; where it fills up it thins less and nothing
    is lost.
    """

    def __init__(self, df: DataFrame, column: str, rows: int):
        log2 = min(28, max(18, (32 * rows).bit_length()))
        slot = (F.col(column).bitwiseAND((1 << log2) - 1) + 1).alias("slot")
        parts = df.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        bits = bytearray(1 << log2 >> 3)
        for r in parts.collect():  # at most 8192 rows of 4 KB
            low = (r["part"] - 1) * 4096
            bits[low : low + 4096] = r["bits"]
        self.log2, self._shared = log2, df.sparkSession.sparkContext.broadcast(bytes(bits))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self._shared.value, dtype=np.uint8)
        slots = hashes & ((1 << self.log2) - 1)
        return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1

    def column(self, name: str) -> Column:
        """Whether a column's hash may be among those seen."""
        has = self.has

        @F.arrow_udf("boolean")
        def seen(hashes: pa.Array) -> pa.Array:
            return pa.array(has(hashes.to_numpy(zero_copy_only=False)))

        return seen(F.col(name))
