"""Enzymes, severities of pairs, name resolution, graph preparation, hybrid retrieval and the chunk corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apothecary.functions import cyp, names, rules, text
from apothecary.functions.numbers import pair_key
from apothecary.operators import dedup, graph, metrics, profiles, resolution, retrieval
from apothecary.operators.tasks import tasks_for
from apothecary.plans import features, search
from apothecary.plans.signals import SQL as SIGNALS
from apothecary.plans.signals import pair_cooccurrence
from apothecary.sources.tables import table

#: Labels' sentences on enzymes: some parts get one.
_CYP_TEXTS = (
    "Strongly inhibits CYP3A4.",
    "It is metabolized by CYP 2D6 and induces cyp2c19.",
    "A substrate of CYP2C9; " + "no more is known of it. " * 8 + "CYP 1A2 was not tested.",
    "CYP2B6 inducer. " + "Far from it stands a long remark. " * 6 + "Inhibition of CYP2E1 and CYP2C8 was seen.",
    "CYP3A5 expression varies.",
    "Substrate of CYP3A4, metabolised via CYP2D6.",
    "No enzyme is named here.",
)


def _picked(texts: tuple[str, ...], place: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, texts)), place.cast("int")), F.lit(""))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _picked(_CYP_TEXTS, F.col("p_partkey") * 7 % 43)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("drug"), F.col("p_brand").alias("other"), F.concat("p_name", F.lit(" "), said, F.lit(" "), "p_brand").alias("text"))


def cyp_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.mentions(_labels(spark, sf_dir).drop("other"))


_LABELS_SQL = f"labels_ AS (SELECT p_partkey AS seq, p_name AS drug, p_brand AS other, p_name || ' ' || coalesce(({list(_CYP_TEXTS)!r})[p_partkey * 7 % 43 + 1], '') || ' ' || p_brand AS text FROM part)"
_ROLE_CASES = " ".join(f"WHEN regexp_matches(win, '{pattern}') THEN '{role}'" for role, pattern in cyp.ROLE_PATTERNS.items())
_FOUND_SQL = rf"""
{_LABELS_SQL},
c1 AS (SELECT *, regexp_extract_all(text, '{cyp.ENZYME_PATTERN}') AS f, regexp_split_to_array(text, '{cyp.ENZYME_PATTERN}') AS g FROM labels_),
c2 AS (SELECT *, unnest(f) AS m, generate_subscripts(f, 1) AS i FROM c1),
c3 AS (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM c2),
c4 AS (SELECT *, upper(regexp_replace(m, '\s', '', 'g')) AS enzyme, substr(text, greatest(0, s - 120) + 1, s + length(m) + 120 - greatest(0, s - 120)) AS win FROM c3),
c5 AS (SELECT *, CASE {_ROLE_CASES} END AS role, left(regexp_replace(win, '^\s+|\s+$', '', 'g'), 200) AS snippet FROM c4),
found AS (SELECT seq, drug, other, text, CAST(row_number() OVER (PARTITION BY seq ORDER BY i) - 1 AS INTEGER) AS place, enzyme, role, snippet FROM c5 WHERE role IS NOT NULL)
"""


def drug_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.enzyme_profiles(cyp_mentions(spark, sf_dir), "drug", ["seq", "place"])


def cyp_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drug_profiles(spark, sf_dir).select("drug", *[F.array_join(r, ",").alias(r) for r in cyp.ROLES], "snippet")


_PROFILE_SQL = f"""{_FOUND_SQL}, prof AS (SELECT lower(trim(drug)) AS drug, {", ".join(f"coalesce(list_sort(list(DISTINCT enzyme) FILTER (role = '{r}')), []) AS {r}" for r in cyp.ROLES)}, arg_min(snippet, {{'s': seq, 'p': place}}) AS snippet FROM found GROUP BY 1)
"""


def cyp_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.pair_figures(pair_cooccurrence(spark, sf_dir).select("drug_a", "drug_b"), drug_profiles(spark, sf_dir))


def enzyme_sql(pairs: str = SIGNALS["q01_pair_cooccurrence"]) -> str:
    """SQL of the twelve enzyme figures over the pairs that ``pairs`` selects."""
    lists = ", ".join(f"coalesce({s}.{r}, []) AS {s}_{r}" for s in "ab" for r in cyp.ROLES)
    every = f"list_distinct(flatten([{', '.join(f'{s}_{r}' for s in 'ab' for r in cyp.ROLES)}]))"
    crossed = lambda r: f"CAST(len(list_distinct(list_concat(list_intersect(a_{r}, b_substrate), list_intersect(b_{r}, a_substrate)))) AS INTEGER)"
    flags = ", ".join(f"CAST(list_contains(e, '{x}') AS INTEGER) AS {x.lower()}_involved" for x in cyp.FLAGGED)
    risk = "CASE x " + " ".join(f"WHEN '{e}' THEN {w}" for e, w in cyp.RISK.items()) + " ELSE 0 END"
    return f"""
WITH {_PROFILE_SQL}, s AS ({pairs}),
j AS (SELECT drug_a, drug_b, {lists}, coalesce(a.snippet, b.snippet, '') AS cyp_snippet FROM s LEFT JOIN prof a ON a.drug = lower(drug_a) LEFT JOIN prof b ON b.drug = lower(drug_b)),
k AS (SELECT *, {every} AS e FROM j)
SELECT drug_a, drug_b, CAST(len(list_intersect(a_substrate, b_substrate)) AS INTEGER) AS shared_cyp_count, {crossed("inhibitor")} AS inhibitor_substrate_pairs, {crossed("inducer")} AS inducer_substrate_pairs, {flags},
  CAST(coalesce(list_max(list_transform(e, lambda x: {risk})), 0) AS INTEGER) AS max_cyp_risk_score, CAST(len(e) > 0 AS INTEGER) AS any_cyp_interaction, CAST(len(e) AS INTEGER) AS n_enzymes_involved, cyp_snippet FROM k
"""


def cyp_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).select("seq", F.col("drug").alias("drug_a"), F.col("other").alias("drug_b"), F.col("text").alias("description"))
    return profiles.attributed(rows).select("seq", "place", "enzyme", "role", "drug")


_ATTRIBUTION_SQL = f"""
WITH {_FOUND_SQL}, p AS (SELECT *, strpos(lower(text), lower(enzyme)) AS pe, strpos(lower(text), lower(drug)) AS pa, strpos(lower(text), lower(other)) AS pb FROM found WHERE length(text) >= 20)
SELECT seq, place, enzyme, role, CASE WHEN CASE WHEN pa > 0 THEN abs(pa - pe) ELSE 9999 END <= CASE WHEN pb > 0 THEN abs(pb - pe) ELSE 9999 END THEN drug ELSE other END AS drug FROM p WHERE pe > 0
"""


def cyp_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each role the nine enzymes that most drugs have."""
    rows = drug_profiles(spark, sf_dir).select("drug", F.explode(F.map_from_arrays(F.array(*map(F.lit, cyp.ROLES)), F.array(*cyp.ROLES))).alias("role", "enzymes"))
    counts = rows.select("role", F.explode("enzymes").alias("enzyme")).groupBy("role", "enzyme").agg(F.count("*").alias("n_drugs"))
    return dedup.top_k(counts, ["role"], [F.desc("n_drugs"), F.col("enzyme")], 9)


_COVERED_SQL = f"""
WITH {_FOUND_SQL}, c AS (SELECT role, enzyme, count(DISTINCT lower(trim(drug))) AS n_drugs FROM found GROUP BY 1, 2)
SELECT role, enzyme, n_drugs, row_number() OVER (PARTITION BY role ORDER BY n_drugs DESC, enzyme) AS rank FROM c QUALIFY rank <= 9
"""

#: Names as patients give them: each part gets two.
_SAID = ("Warfarin 5mg daily", "Aspirin 81 mg", "Advil 400mg", "Glucophage XR 500mg", "contrast_dye", "Zocor 20mg", "clarithromycin twice a day", "SSRI", "Tramadol 50 mg prn", "Zestril", "potassium", "Toprol 25 mg", "Verapamil", "Cipro", "antacid", "Biaxin 1.5 g")


def pair_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, confidence and what follows for pairs of names as given, gravest first in each brand."""
    n = len(_SAID)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", names.generic_name(_picked(_SAID, F.col("p_partkey") % n)).alias("drug_a"), names.generic_name(_picked(_SAID, F.floor(F.col("p_partkey") / n) * 3 % n)).alias("drug_b"))
    severity, confidence = rules.known_pair(F.col("drug_a"), F.col("drug_b"))
    rows = rows.withColumn("severity", severity).withColumn("confidence", confidence)
    rows = rows.select(
        "*", rules.named(F.col("severity"), rules.SEVERITY_LABELS).alias("label"), rules.named(F.col("severity"), rules.MODEL_LABELS).alias("model_label"), rules.named(F.col("severity"), rules.ALERT_TYPES).alias("alert_type"),
        (F.col("severity") >= 2).alias("significant"), (F.col("confidence") < rules.LOW_CONFIDENCE).alias("needs_evidence"),
    )
    return dedup.ranked(rows, ["p_brand"], [F.desc("severity"), F.desc("confidence"), F.col("p_partkey")], "place")


def _severity_sql() -> str:
    n = len(_SAID)
    brands = " ".join(f"WHEN '{b}' THEN '{g}'" for b, g in names.GENERIC_NAMES.items())

    def generic(place: str) -> str:
        bare = f"trim(regexp_replace(trim(regexp_replace(lower(({list(_SAID)!r})[{place} + 1]), '{names.STRENGTH_TAIL}', '')), '{names.FREQUENCY_TAIL}', ''))"
        return f"CASE {bare} {brands} ELSE {bare} END"

    pairs = {"|".join(sorted(p)): v for p, v in rules.KNOWN_PAIRS.items()}
    case = lambda k: "CASE k " + " ".join(f"WHEN '{p}' THEN {v[k]}" for p, v in pairs.items()) + f" ELSE {rules.UNKNOWN_PAIR[k]} END"
    named = lambda values: f"({list(values)!r})[severity + 1]"
    return f"""
WITH a AS (SELECT p_partkey, p_brand, {generic(f"p_partkey % {n}")} AS drug_a, {generic(f"(p_partkey // {n}) * 3 % {n}")} AS drug_b FROM part),
k AS (SELECT *, least(drug_a, drug_b) || '|' || greatest(drug_a, drug_b) AS k FROM a),
s AS (SELECT * EXCLUDE k, CAST({case(0)} AS INTEGER) AS severity, CAST({case(1)} AS DOUBLE) AS confidence FROM k)
SELECT *, {named(rules.SEVERITY_LABELS)} AS label, {named(rules.MODEL_LABELS)} AS model_label, {named(rules.ALERT_TYPES)} AS alert_type, severity >= 2 AS significant, confidence < 0.6 AS needs_evidence,
  row_number() OVER (PARTITION BY p_brand ORDER BY severity DESC, confidence DESC, p_partkey) AS place FROM s
"""


def _raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as given: plain, with a strength, with a letter too many, with one changed and one left out, or garbled."""
    name, turn = F.col("p_name"), F.col("p_partkey") % 5
    given = F.when(turn == 0, F.upper(name)).when(turn == 1, F.concat(name, F.lit(" 20 mg oral"))).when(turn == 2, F.concat(name, F.lit("e"))).when(turn == 3, F.concat(F.substring(name, 1, 4), F.lit("#"), F.expr("substring(p_name, 6, length(p_name) - 6)"))).otherwise(F.concat(F.lit("zzz"), F.reverse(name)))
    return table(spark, sf_dir, "part").select(given.alias("name"))


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = table(spark, sf_dir, "part").select(F.lower("p_name").alias("term"))
    return resolution.resolve(_raw_names(spark, sf_dir), vocabulary)


def _resolution_sql() -> str:
    from apothecary.plans.texts import _bare_sql

    grams = lambda x: f"list_distinct(list_transform(generate_series(1, greatest(1, length({x}))), lambda k: substr('$' || {x} || '$', k, 3)))"
    return f"""
WITH r AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' 20 mg oral' WHEN 2 THEN p_name || 'e' WHEN 3 THEN substr(p_name, 1, 4) || '#' || substr(p_name, 6, length(p_name) - 6) ELSE 'zzz' || reverse(p_name) END AS name FROM part),
n AS (SELECT name, {_bare_sql("name")} AS normalised FROM r), t AS (SELECT DISTINCT lower(p_name) AS term FROM part),
x AS (SELECT DISTINCT normalised FROM n), o AS (SELECT normalised, unnest({grams("normalised")}) AS g FROM x WHERE normalised NOT IN (SELECT term FROM t)), v AS (SELECT term, unnest({grams("term")}) AS g FROM t),
c AS (SELECT DISTINCT normalised, term FROM o JOIN v USING (g)), e AS (SELECT *, levenshtein(normalised, term) AS d FROM c),
q AS (SELECT *, CAST(floor(100 * (1 - d / greatest(length(normalised), length(term)))) AS BIGINT) AS s FROM e),
b AS (SELECT normalised, min(d) AS d, arg_min(term, {{'d': d, 't': term}}) AS spelt, max(s) AS s, arg_min(term, {{'s': -s, 't': term}}) AS near FROM q GROUP BY 1)
SELECT name, n.normalised, CASE WHEN term IS NOT NULL THEN term WHEN d <= 1 THEN spelt WHEN s >= 80 THEN near END AS canonical,
  CASE WHEN term IS NOT NULL THEN 100 WHEN d <= 1 OR s >= 80 THEN s END AS score, CASE WHEN term IS NOT NULL THEN 'exact' WHEN d <= 1 THEN 'spelling' WHEN s >= 80 THEN 'approx' ELSE 'failed' END AS match_method
FROM n LEFT JOIN t ON n.normalised = term LEFT JOIN b ON b.normalised = n.normalised
"""


def mapping_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each way resolved, and their mean score."""
    return name_resolution(spark, sf_dir).groupBy("match_method").agg(F.count("*").alias("n_names"), F.countDistinct("normalised").alias("n_normalised"), F.round(F.avg("score"), 6).alias("mean_score"))


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and BM25 ranks fused, the source filter after fusion, then the best twenty of each query.

    The vectors of queries and documents are those of the same number.
    """
    vectors = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = queries.join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"))
    corpus = vectors.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    sparse = retrieval.bm25_top_k(queries, docs.select(F.col("doc_id").alias("chunk_id"), "text"), 50)
    fused = retrieval.fuse(retrieval.dense_top_k(asked, corpus, 50), sparse)
    allowed = docs.where("source in ('src1', 'src2', 'src3')").select(F.col("doc_id").alias("chunk_id"), "source")
    best = dedup.top_k(fused.drop("rank").join(allowed, "chunk_id"), ["query_id"], retrieval.fused_order(), 20)
    return best.select("query_id", "rank", "chunk_id", "source", "dense_rank", "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"))


def _hybrid_sql() -> str:
    sparse = search.SQL["q26_bm25"]
    return f"""
WITH sp AS ({sparse}),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
a AS (SELECT item_id AS query_id, c.vec_id AS chunk_id, list_dot_product(q.v, c.v) / (q.n * c.n) AS score FROM benchmark JOIN e q ON q.vec_id = item_id, e c WHERE c.vec_id IN (SELECT doc_id FROM documents)),
de AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS d FROM a QUALIFY d <= 50),
f AS (SELECT query_id, chunk_id, d, s, coalesce(1.0 / (60 + d), 0) + coalesce(1.0 / (60 + s), 0) AS rrf FROM de FULL JOIN (SELECT query_id, chunk_id, rank AS s FROM sp) USING (query_id, chunk_id)),
w AS (SELECT f.*, source FROM f JOIN documents ON doc_id = chunk_id WHERE source IN ('src1', 'src2', 'src3'))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, d NULLS LAST, s NULLS LAST, chunk_id) AS rank, chunk_id, source, coalesce(d, -1) AS dense_rank, coalesce(s, -1) AS sparse_rank, round(rrf, 9) AS rrf_score
FROM w QUALIFY rank <= 20
"""


def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources united in order, each text once: the first by source, then by id."""
    sources = {
        "drugbank": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("doc"), F.lit("interaction").alias("section_type"), F.concat_ws(" ", "p_name", F.lit("is sold as"), "p_brand", "p_type", F.lit("and more. " * 5)).alias("text")),
        "dailymed": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("doc"), F.when(F.col("doc_id") % 3 == 0, "boxed_warning").otherwise("summary").alias("section_type"), text.clean(F.col("text")).alias("text")),
        "faers": table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("role").alias("doc"), F.lit("narrative").alias("section_type"), text.clean(F.col("text")).alias("text")),
        "pubmed": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.lit("benchmark").alias("doc"), F.lit("abstract").alias("section_type"), text.clean(F.col("text")).alias("text")),
    }
    every = None
    for place, (name, rows) in enumerate(sources.items()):
        rows = rows.select(F.lit(name).alias("source"), F.lit(place).alias("source_rank"), F.col("seq").cast("long").alias("seq"), "doc", "section_type", "text")
        every = rows if every is None else every.unionByName(rows)
    kept = dedup.one_of_each_text(every.where(F.length("text") >= 80), "text", [F.col("source_rank"), F.col("seq")])
    chunk_id = F.concat_ws("_", "source", F.col("seq").cast("string"))
    return kept.select(chunk_id.alias("chunk_id"), "source", "doc", "section_type", F.length("text").alias("char_count"), text.token_estimate(F.col("text")).alias("token_estimate"), F.col("section_type").isin(*text.PRIORITY_SECTIONS).alias("priority"), text.content_hash(F.col("text")).alias("content_hash"))


def _corpus_sql() -> str:
    from apothecary.plans.texts import _clean_sql

    return f"""
WITH u AS (SELECT 'drugbank' AS source, 0 AS r, p_partkey AS seq, p_name AS doc, 'interaction' AS section_type, concat_ws(' ', p_name, 'is sold as', p_brand, p_type, '{"and more. " * 5}') AS text FROM part
 UNION ALL SELECT 'dailymed', 1, doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'boxed_warning' ELSE 'summary' END, {_clean_sql("text")} FROM documents
 UNION ALL SELECT 'faers', 2, conv_id * 1000 + turn, role, 'narrative', {_clean_sql("text")} FROM conversations
 UNION ALL SELECT 'pubmed', 3, item_id, 'benchmark', 'abstract', {_clean_sql("text")} FROM benchmark),
k AS (SELECT * FROM u WHERE length(text) >= 80 QUALIFY row_number() OVER (PARTITION BY sha1(lower(text)) ORDER BY r, seq) = 1)
SELECT source || '_' || seq AS chunk_id, source, doc, section_type, CAST(length(text) AS INTEGER) AS char_count, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_estimate, section_type IN {text.PRIORITY_SECTIONS!r} AS priority, sha1(lower(text)) AS content_hash FROM k
"""


def edge_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs reported more often than the mean and as many drawn ones that are not, with node ids and a split by hash order."""
    pairs = pair_cooccurrence(spark, sf_dir).select("drug_a", "drug_b", "report_count")
    mean = pairs.agg(F.avg("report_count").alias("mean"))
    positives = pairs.join(F.broadcast(mean)).where("report_count > mean").select("drug_a", "drug_b")
    nodes = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("node")).agg(F.min("p_partkey").alias("first"))
    nodes = metrics.numbered(nodes, "first").withColumnRenamed("place", "node_id")
    negatives = graph.negative_samples(positives, nodes)
    edges = positives.select(F.col("drug_a").alias("src"), F.col("drug_b").alias("dst"), F.lit(1).alias("label")).union(negatives.withColumn("label", F.lit(0)))
    ids = nodes.select("node", "node_id")
    for side in ("src", "dst"):
        edges = edges.join(ids.withColumnsRenamed({"node": side, "node_id": f"{side}_id"}), side)
    edges = metrics.stratified_split(edges.withColumn("edge", F.concat_ws("|", "src", "dst")), "label", "edge", 0.7, 0.15)
    return edges.select("src", "dst", "src_id", "dst_id", "label", "split")


_EDGE_SQL = f"""
WITH s AS ({SIGNALS["q01_pair_cooccurrence"]}), p AS (SELECT drug_a, drug_b FROM s WHERE report_count > (SELECT avg(report_count) FROM s)),
n AS (SELECT node, row_number() OVER (ORDER BY first) - 1 AS node_id FROM (SELECT p_name AS node, min(p_partkey) AS first FROM part GROUP BY 1)),
h AS (SELECT CAST('0x' || left(md5(drug_a || '|' || drug_b || '|' || t || '|42-0'), 8) AS BIGINT) % (SELECT count(*) FROM n) AS i, CAST('0x' || left(md5(drug_a || '|' || drug_b || '|' || t || '|42-1'), 8) AS BIGINT) % (SELECT count(*) FROM n) AS j FROM p, range(1, 6) x(t)),
g AS (SELECT DISTINCT least(x.node, y.node) AS src, greatest(x.node, y.node) AS dst FROM h JOIN n x ON x.node_id = i JOIN n y ON y.node_id = j WHERE i <> j),
e AS (SELECT drug_a AS src, drug_b AS dst, 1 AS label FROM p UNION ALL SELECT src, dst, 0 FROM g ANTI JOIN p ON src = drug_a AND dst = drug_b),
r AS (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY md5(src || '|' || dst || '-42'), src || '|' || dst) AS q FROM e)
SELECT src, dst, x.node_id AS src_id, y.node_id AS dst_id, label, CASE WHEN q < 0.7 THEN 'train' WHEN q < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM r JOIN n x ON x.node = src JOIN n y ON y.node = dst
"""


def attention_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's sum of its neighbours' features by attention weight."""
    nodes = features.node_features(spark, sf_dir)
    sums = graph.weighted_sums(features.attention_weights(spark, sf_dir), nodes, ["mean_report_count", "mean_max_severity"])
    return sums.select("node", F.round("sum_mean_report_count", 4).alias("sum_mean_report_count"), F.round("sum_mean_max_severity", 4).alias("sum_mean_max_severity"))


_SUMS_SQL = f"""
WITH w AS ({features.SQL["q54_attention_weights"]}), f AS ({features.SQL["q53_node_features"]})
SELECT dst AS node, round(sum(weight * mean_report_count), 4) AS sum_mean_report_count, round(sum(weight * mean_max_severity), 4) AS sum_mean_max_severity FROM w JOIN f ON f.node = src GROUP BY 1
"""


def prior_alert_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair a customer sends back, whether an earlier alert on it, in either order, was left unread.

    A missing mark counts as read in one reading and as unread in the other.
    """
    orders, items, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    read = F.when(F.col("l_tax") < 0.07, F.col("l_linestatus") == "F")
    rows = rows.select("o_custkey", F.upper("p_brand").alias("drug_a"), F.col("p_name").alias("drug_b"), pair_key(F.col("p_name"), F.col("p_brand")).alias("pair"), read.alias("read"), (F.col("l_returnflag") == "R").alias("asked"))
    rows = rows.repartition(tasks_for(table(spark, sf_dir, "lineitem")), "o_custkey")
    # Alerts of a pair in its spellings, so that those asked for need no second pass: all of a customer lie in one task.
    spelt = rows.groupBy("o_custkey", "pair", "drug_a", "drug_b").agg(F.bool_or(~F.coalesce("read", F.lit(True))).alias("strict"), F.bool_or(~F.coalesce("read", F.lit(False))).alias("loose"), F.count("*").alias("n_alerts"), F.bool_or("asked").alias("asked"))
    pair = Window.partitionBy("o_custkey", "pair")
    prior = {"strict": F.bool_or("strict"), "loose": F.bool_or("loose"), "n_alerts": F.sum("n_alerts")}
    known = F.col("o_custkey").isNotNull() & F.col("pair").isNotNull()
    whole = spelt.withColumns({c: F.when(known, how.over(pair)) for c, how in prior.items()})
    return whole.where("asked").select("o_custkey", "drug_a", "drug_b", *prior)


_PRIOR_SQL = """
WITH r AS (SELECT o_custkey, p_name, p_brand, l_returnflag, CASE WHEN l_tax < 0.07 THEN l_linestatus = 'F' END AS read, least(lower(p_name), lower(p_brand)) || '_' || greatest(lower(p_name), lower(p_brand)) AS pair FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
p AS (SELECT o_custkey, pair, bool_or(NOT coalesce(read, true)) AS strict, bool_or(NOT coalesce(read, false)) AS loose, count(*) AS n_alerts FROM r GROUP BY 1, 2),
a AS (SELECT DISTINCT o_custkey, upper(p_brand) AS drug_a, p_name AS drug_b, pair FROM r WHERE l_returnflag = 'R')
SELECT o_custkey, drug_a, drug_b, strict, loose, n_alerts FROM a LEFT JOIN p USING (o_custkey, pair)
"""


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro averages and the mean error of a severity over the rows of a grave one."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("quality").alias("actual"), (F.length("text") > 600).cast("int").alias("predicted"), (F.col("quality") * 3).alias("severity"), F.least(F.lit(3), F.floor(F.length("text") / 500)).cast("int").alias("guess"))
    return metrics.overall_scores(rows, "actual", "predicted", "severity", "guess").select("accuracy", "n_classes", *[F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "severity_mae")])


_OVERALL_SQL = """
WITH r AS (SELECT quality AS a, CAST(length(text) > 600 AS INTEGER) AS p, quality * 3 AS s, least(3, length(text) // 500) AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT a AS class FROM r UNION SELECT p FROM r),
x AS (SELECT class, (SELECT count(*) FROM r WHERE a = class) AS support, (SELECT count(*) FROM r WHERE p = class) AS given, (SELECT count(*) FROM r WHERE a = class AND p = class) AS hits FROM c),
t AS (SELECT CASE WHEN given = 0 THEN 0.0 ELSE hits / given END AS p, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r FROM x)
SELECT (SELECT avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END) FROM r) AS accuracy, count(*) AS n_classes, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall,
  round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 9) AS macro_f1, round((SELECT avg(abs(s - g)) FILTER (s > 0) FROM r), 9) AS severity_mae FROM t
"""


def patient_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole years from an order's day to a fixed one."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.age_at(F.col("o_orderdate").cast("date"), F.lit("2024-06-30").cast("date")).alias("age"))


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language the five longest documents as numbered evidence in one prompt, with its hash and size."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.length("text").alias("n"), F.left("text", F.lit(600)).alias("shown"))
    best = dedup.top_k(docs, ["lang"], [F.desc("n"), F.col("doc_id")], 5)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("shown"))
    blocks = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "doc_id"))).alias("blocks"))
    prompt = F.array_join(F.transform("blocks", lambda b: b["line"]), "\n")
    ids = F.array_join(F.transform("blocks", lambda b: b["doc_id"].cast("string")), ",")
    return blocks.select("lang", F.size("blocks").alias("n_blocks"), ids.alias("doc_ids"), F.md5(prompt.cast("binary")).alias("prompt_md5"), F.floor(F.length(prompt) / 4).cast("int").alias("token_estimate"), F.left(F.md5(F.concat_ws("|", "lang", ids, F.size("blocks").cast("string")).cast("binary")), F.lit(12)).alias("context_hash"))


_CONTEXT_SQL = """
WITH t AS (SELECT lang, doc_id, left(text, 600) AS shown, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS r FROM documents QUALIFY r <= 5),
g AS (SELECT lang, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) AS ids, string_agg('[' || r || '] ' || shown, chr(10) ORDER BY r) AS prompt FROM t GROUP BY 1)
SELECT lang, CAST(n AS INTEGER) AS n_blocks, ids AS doc_ids, md5(prompt) AS prompt_md5, CAST(length(prompt) // 4 AS INTEGER) AS token_estimate, left(md5(lang || '|' || ids || '|' || n), 12) AS context_hash FROM g
"""


def molecular_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of both sides of each co-occurring pair: weights, binding, half-lives, signals, flags and completeness."""
    return features.paired_figures(pair_cooccurrence(spark, sf_dir), drug_properties(spark, sf_dir))


#: Kinds of drugs: each part gets one.
KINDS = ("Small Molecule", "biotech", "small molecule", "SMALL MOLECULE", "")


def drug_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties by lower-case name, the first part's of each."""
    props = profiles_of_parts(dedup.keep_first(table(spark, sf_dir, "part"), [F.lower("p_name")], [F.col("p_partkey")]))
    sold = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("known", F.lit(1))
    return props.join(sold, "p_partkey", "left").withColumn("known", F.coalesce("known", F.lit(0))).drop("p_partkey")


def profiles_of_parts(parts: DataFrame) -> DataFrame:
    from apothecary.functions import numbers

    life, bound = features.given(features.LIVES), features.given(features.BOUNDS)
    return parts.select("p_partkey", F.lower("p_name").alias("drug"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("mw"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") - 25.0).alias("logp"), numbers.protein_binding(bound).alias("binding"), numbers.half_life_hours(life).alias("life"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("kind"), (F.col("p_size") > 40).cast("int").alias("boxed"), (F.col("p_size") % 3 == 0).cast("int").alias("interacts"))


def molecular_sql(pairs: str = SIGNALS["q01_pair_cooccurrence"]) -> str:
    """SQL of the thirty figures over the pairs and signals that ``pairs`` selects."""
    inner = features.SQL["q46_text_to_number"]
    side = lambda s: ", ".join(f"{s}.{c} AS {c}_{s}" for c in ("mw", "logp", "binding", "life", "kind")) + "".join(f", coalesce({s}.{c}, 0) AS {c}_{s}" for c in ("boxed", "interacts", "known"))
    gap = lambda c: f"CAST(coalesce(round(abs({c}_a - {c}_b), 4), 0) AS DOUBLE) AS {c}_diff"
    ratio = lambda c: f"CAST(coalesce(round({c}_a / nullif({c}_b, 0), 4), 1) AS DOUBLE) AS {c}_ratio"
    count = " + ".join(f"CASE WHEN {c}_{s} IS NULL THEN 0 ELSE 1 END" for c in ("mw", "logp", "binding", "life") for s in "ab")
    kind = lambda s, w: f"coalesce(contains(lower(kind_{s}), '{w}'), false)"
    return f"""
WITH n AS ({inner}), s AS ({pairs}),
f AS (SELECT p_partkey, lower(p_name) AS drug, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS mw, CASE WHEN p_size % 5 <> 0 THEN p_size - 25.0 END AS logp, ({list(KINDS)!r})[p_partkey % 5 + 1] AS kind, CAST(p_size > 40 AS INTEGER) AS boxed, CAST(p_size % 3 = 0 AS INTEGER) AS interacts,
  CAST(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS INTEGER) AS known FROM part
  QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1),
d AS (SELECT f.*, n.bound AS binding, n.hours AS life FROM f JOIN n USING (p_partkey)),
j AS (SELECT s.*, {side("a")}, {side("b")} FROM s LEFT JOIN d a ON a.drug = lower(trim(drug_a)) LEFT JOIN d b ON b.drug = lower(trim(drug_b)))
SELECT drug_a, drug_b, {", ".join(f"CAST(coalesce({c}_{s}, 0) AS DOUBLE) AS {c}_{s}" for c in ("mw", "logp", "binding", "life") for s in "ab")},
  {", ".join(map(gap, ("mw", "logp", "binding")))}, {", ".join(map(ratio, ("mw", "logp", "life")))},
  CAST({kind("a", "small")} AND {kind("b", "small")} AS INTEGER) AS both_small, CAST({kind("a", "biotech")} OR {kind("b", "biotech")} AS INTEGER) AS one_biologic,
  coalesce(report_count, 0) AS report_count, coalesce(death_count, 0) AS death_count, coalesce(max_severity, 0) AS max_severity, coalesce(round(death_count / report_count, 4), 0) AS death_rate, coalesce(round(ln(1 + report_count), 4), 0) AS signal_strength, CAST(report_count IS NOT NULL AS INTEGER) AS pair_seen,
  boxed_a, boxed_b, greatest(boxed_a, boxed_b) AS either_boxed, interacts_a, interacts_b, known_a, known_b, round(({count}) / 8, 3) AS completeness FROM j
"""


QUERIES = {
    "q59_cyp_mentions": cyp_mentions,
    "q60_cyp_profiles": cyp_profiles,
    "q61_cyp_pair_features": cyp_pair_features,
    "q62_cyp_attribution": cyp_attribution,
    "q63_cyp_coverage": cyp_coverage,
    "q64_pair_severity": pair_severity,
    "q65_name_resolution": name_resolution,
    "q66_mapping_methods": mapping_methods,
    "q67_hybrid_retrieval": hybrid_retrieval,
    "q68_chunk_corpus": chunk_corpus,
    "q69_edge_dataset": edge_dataset,
    "q70_attention_sums": attention_sums,
    "q71_prior_alert_flags": prior_alert_flags,
    "q72_overall_scores": overall_scores,
    "q73_patient_ages": patient_ages,
    "q74_context_blocks": context_blocks,
    "q75_molecular_features": molecular_features,
}
SQL = {
    "q59_cyp_mentions": f"WITH {_FOUND_SQL} SELECT seq, drug, place, enzyme, role, snippet FROM found",
    "q60_cyp_profiles": f"WITH {_PROFILE_SQL} SELECT drug, {', '.join(f'''array_to_string({r}, ',') AS {r}''' for r in cyp.ROLES)}, snippet FROM prof",
    "q61_cyp_pair_features": enzyme_sql(),
    "q62_cyp_attribution": _ATTRIBUTION_SQL,
    "q63_cyp_coverage": _COVERED_SQL,
    "q64_pair_severity": _severity_sql(),
    "q65_name_resolution": _resolution_sql(),
    "q66_mapping_methods": f"SELECT match_method, count(*) AS n_names, count(DISTINCT normalised) AS n_normalised, round(avg(score), 6) AS mean_score FROM ({_resolution_sql()}) GROUP BY 1",
    "q67_hybrid_retrieval": _hybrid_sql(),
    "q68_chunk_corpus": _corpus_sql(),
    "q69_edge_dataset": _EDGE_SQL,
    "q70_attention_sums": _SUMS_SQL,
    "q71_prior_alert_flags": _PRIOR_SQL,
    "q72_overall_scores": _OVERALL_SQL,
    "q73_patient_ages": "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-06-30') // 365 AS INTEGER) AS age FROM orders",
    "q74_context_blocks": _CONTEXT_SQL,
    "q75_molecular_features": molecular_sql(),
}
