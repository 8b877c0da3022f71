"""From documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.llm import jaccard, packing, quality, suffix_dedup
from apothecary.llm.common import Bits, public_tokenizer, stored, table

ORACLE_SQL = None  # a classifier and an exact byte-string match are not SQL

#: Settings for rows that hold whole texts: what a scan and an exchange with Python hold at a time.
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch sizes; results are the same. They hold on, as a stage's plan runs when its result is written."""
    for name, value in SMALL_BATCHES.items():
        spark.conf.set(name, value)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null texts count as empty; rows without an id are scored like others;
    repeated rows stay; an empty table stays empty. No column is added or
    changed, whatever its name.
    """
    _small_batches(spark)
    scorer = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(scorer, F.col("text")) >= 0.5)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; documents without an id, a text or a word stay.

    Ids may repeat: a row goes by its id and text, and of several texts of the
    least id one stays, as of a row given twice. A bitmap of the ids that go,
    or that several rows share, keeps all other texts out of the shuffle. An
    empty table stays empty; columns of any name pass through.
    """
    _small_batches(spark)
    groups = stored(jaccard.jaccard_groups(docs, keys=True).where("doc_id is not null").select("doc_id", "text_hash", "class_id", "root"))
    least = groups.where("doc_id = class_id and root is not null").groupBy("root", "doc_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most")
    others = groups.join(least, ["root", "doc_id"]).where("text_hash <> least").select("doc_id", "text_hash")
    going = stored(groups.where("doc_id <> class_id").select("doc_id", "text_hash").union(others).distinct().select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")))
    shared = groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    doubtful = Bits(going.select("_id").union(shared).select(F.xxhash64("_id").alias("slot")), "slot", going.count())
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")
    marked = docs.select(given, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text")).withColumn("_slot", F.xxhash64("_id"))
    marked = marked.withColumn("_seen", doubtful.column("_slot") & F.col("_id").isNotNull())
    unique = marked.where("not _seen").select("given")
    checked = marked.where("_seen").join(going, ["_id", "_text"], "left_anti").dropDuplicates(["_id", "_text"]).select("given")
    return unique.unionByName(checked).select("given.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier too; n_chars, where there is one, follows the text.

    A null text becomes empty; a null id comes first in the order; repeated
    rows get the same text; an empty table stays empty; other columns pass.
    """
    _small_batches(spark)
    found = suffix_dedup.remove_repeats(docs, carry=tuple(docs.columns))
    kept = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[kept.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048; a null text has its end token only."""
    _small_batches(spark)
    return packing.pack(packing.token_pieces(docs, public_tokenizer("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
