"""Vector search, BM25, fusion, reranking and query expansion over embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import text, vectors
from apothecary.functions.numbers import squash
from apothecary.operators import retrieval
from apothecary.sources.tables import table


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vectors.unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.norm(unit), 6).alias("unit_norm"), F.round(F.get(unit, F.lit(0)), 6).alias("first"))


_NORM_SQL = """
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)
SELECT vec_id, round(n, 6) AS norm, round(CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END, 6) AS unit_norm, round(v[1] / CASE WHEN n = 0 THEN 1e-9 ELSE n END, 6) AS first FROM n
"""


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a label: the mean of its vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    means = rows.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"])
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("vector"))


_CENTROIDS_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
m AS (SELECT label, place, round(avg(x), 9) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM e) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(x ORDER BY place) AS v FROM m GROUP BY 1),
qn AS (SELECT query_id, v, sqrt(list_dot_product(v, v)) AS n FROM q)
"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(retrieval.dense_top_k(_centroids(spark, sf_dir), _corpus(spark, sf_dir), 50))


def _dense_sql(where: str, k: int) -> str:
    return f"""
WITH {_CENTROIDS_SQL}, s AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(qn.v, e.v) / (qn.n * e.n) AS score FROM qn, e WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= {k})
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r
"""


def filtered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata filter comes before the top k."""
    return _shown(retrieval.dense_top_k(_centroids(spark, sf_dir), _corpus(spark, sf_dir).where("label >= 5"), 10))


def post_fusion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source filter comes after the top k, so fewer rows may be left."""
    found = retrieval.dense_top_k(_centroids(spark, sf_dir), _corpus(spark, sf_dir), 50)
    return _shown(found.join(_corpus(spark, sf_dir).where("label >= 5").select("chunk_id"), "chunk_id", "left_semi"))


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.bm25_top_k(queries, docs, k)


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_bm25(spark, sf_dir, 50))


_BM25_SQL = r"""
WITH t AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS t FROM documents),
l AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM t), p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM l GROUP BY 1, 2, 3),
g AS (SELECT count(*) AS n, avg(len(t)) AS mean_dl FROM t), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT term, mean_dl, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM d, g), z AS (SELECT avg(idf) AS mean_idf FROM i),
f AS (SELECT term, mean_dl, CASE WHEN idf < 0 THEN mean_idf * 0.25 ELSE idf END AS idf FROM i, z),
a AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark),
b AS (SELECT query_id, term, count(*) AS times FROM a GROUP BY 1, 2),
s AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean_dl))) AS score FROM b JOIN f USING (term) JOIN p USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 50)
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r
"""


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine ranks fused with ranks by the plain inner product with the centroid's first half."""
    centroids = _centroids(spark, sf_dir)
    dense = retrieval.dense_top_k(centroids, _corpus(spark, sf_dir), 50)
    halves = centroids.select("query_id", F.slice("vector", 1, 32).alias("vector"))
    other = retrieval.dense_top_k(halves, _corpus(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 32)), 50)
    return retrieval.fuse(dense, other).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "rank", F.round("rrf_score", 9).alias("rrf_score"))


_FUSION_SQL = f"""
WITH {_CENTROIDS_SQL},
a AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(qn.v, e.v) / (qn.n * e.n) AS score FROM qn, e),
b AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(qn.v[1:32], e.v[1:32]) / (sqrt(list_dot_product(qn.v[1:32], qn.v[1:32])) * sqrt(list_dot_product(e.v[1:32], e.v[1:32]))) AS score FROM qn, e),
ra AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS d FROM a QUALIFY d <= 50),
rb AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS s FROM b QUALIFY s <= 50),
f AS (SELECT query_id, chunk_id, d, s, coalesce(1.0 / (60 + d), 0) + coalesce(1.0 / (60 + s), 0) AS rrf FROM ra FULL JOIN rb USING (query_id, chunk_id))
SELECT query_id, chunk_id, coalesce(d, -1) AS dense_rank, coalesce(s, -1) AS sparse_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, d NULLS LAST, s NULLS LAST, chunk_id) AS rank, round(rrf, 9) AS rrf_score FROM f
"""


def weighted_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents a language by length score plus a bonus for their source."""
    docs = table(spark, sf_dir, "documents")
    score = squash((F.length("text") - 2000) / 1000)
    bonus = F.when(F.col("source") == "src1", 0.8).when(F.col("source") == "src2", 0.5).when(F.col("source") == "src3", 0.3).otherwise(0.0)
    found = retrieval.rerank(docs.select("doc_id", "lang", "source", "text"), score, bonus, ["lang"], "doc_id")
    return found.select("lang", "rank", "original_rank", "doc_id", F.round("weighted", 6).alias("weighted"))


_RERANK_SQL = """
WITH s AS (SELECT doc_id, lang, 1 / (1 + exp(-((length(text) - 2000) / 1000))) AS score, CASE source WHEN 'src1' THEN 0.8 WHEN 'src2' THEN 0.5 WHEN 'src3' THEN 0.3 ELSE 0.0 END AS bonus FROM documents),
o AS (SELECT *, score + bonus AS weighted, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, doc_id) AS original_rank FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(weighted, 9) DESC, doc_id) AS rank FROM o QUALIFY rank <= 5)
SELECT lang, rank, original_rank, doc_id, round(weighted, 6) AS weighted FROM r
"""


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name with the brands it goes by, at most twelve, without repeats that differ in case only."""
    parts = table(spark, sf_dir, "part")
    terms = parts.groupBy("p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    listed = text.distinct_ignoring_case(F.concat(F.array("p_name"), F.array(F.upper("p_name")), F.slice("brands", 1, 12)))
    return terms.select("p_name", F.array_join(listed, "|").alias("terms"), F.size(listed).alias("n_terms"))


_EXPANSION_SQL = """
WITH b AS (SELECT p_name, list_sort(list(DISTINCT p_brand))[1:12] AS b FROM part GROUP BY 1)
SELECT p_name, array_to_string(list_concat([p_name], b), '|') AS terms, len(b) + 1 AS n_terms FROM b
"""

QUERIES = {
    "q23_l2_normalise": l2_normalise,
    "q24_dense_top_k": dense_top_k,
    "q25_filtered_top_k": filtered_top_k,
    "q26_bm25": bm25,
    "q27_rank_fusion": rank_fusion,
    "q28_post_fusion_filter": post_fusion_filter,
    "q29_weighted_rerank": weighted_rerank,
    "q30_query_expansion": query_expansion,
}
SQL = {
    "q23_l2_normalise": _NORM_SQL,
    "q24_dense_top_k": _dense_sql("true", 50),
    "q25_filtered_top_k": _dense_sql("label >= 5", 10),
    "q26_bm25": _BM25_SQL,
    "q27_rank_fusion": _FUSION_SQL,
    "q28_post_fusion_filter": _dense_sql("true", 50).replace("FROM r\n", "FROM r WHERE chunk_id IN (SELECT vec_id FROM embeddings WHERE label >= 5)\n"),
    "q29_weighted_rerank": _RERANK_SQL,
    "q30_query_expansion": _EXPANSION_SQL,
}
