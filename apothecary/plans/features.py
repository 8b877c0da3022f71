"""Pair features, preparation and metrics over part, lineitem, labels and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import numbers, rules
from apothecary.operators import graph, metrics
from apothecary.plans.signals import pair_cooccurrence
from apothecary.sources.tables import table


def role_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in entity pattern in documents, and the role that the words around give, by priority."""
    low = F.lower("text")
    found = F.regexp_extract_all("text", F.lit(r"(Th[a-z]+|Un[a-z]+)[ .,]"), F.lit(1))
    role = F.when(F.contains(low, F.lit("ing")), "inhibitor").when(F.contains(low, F.lit("tion")), "inducer").when(F.contains(low, F.lit("er")), "substrate")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("entity"), role.alias("role"))
    return rows.where("role is not null").groupBy("entity", "role").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_ROLE_SQL = r"""
WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(Th[a-z]+|Un[a-z]+)[ .,]', 1))) AS entity,
  CASE WHEN contains(lower(text), 'ing') THEN 'inhibitor' WHEN contains(lower(text), 'tion') THEN 'inducer' WHEN contains(lower(text), 'er') THEN 'substrate' END AS role FROM documents)
SELECT entity, role, count(*) AS n_docs, min(doc_id) AS first_doc FROM m WHERE role IS NOT NULL GROUP BY 1, 2
"""


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and ratios of two parts' figures for each co-occurring pair, with its signal."""
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_size").cast("double").alias("size"), F.max("p_retailprice").alias("price"))
    a = parts.select(F.col("p_name").alias("drug_a"), F.col("size").alias("size_a"), F.col("price").alias("price_a"))
    b = parts.select(F.col("p_name").alias("drug_b"), F.col("size").alias("size_b"), F.col("price").alias("price_b"))
    rows = pair_cooccurrence(spark, sf_dir).join(a, "drug_a", "left").join(b, "drug_b", "left")
    return rows.select(
        "drug_a", "drug_b",
        numbers.gap(F.col("size_a"), F.col("size_b")).alias("size_gap"),
        numbers.rounded(numbers.ratio(F.col("price_a"), F.col("price_b")), 6).alias("price_ratio"),
        F.round(F.log1p("report_count"), 6).alias("signal"),
        numbers.rounded(F.col("death_count") / F.col("report_count"), 6).alias("death_rate"),
    )


def _pair_features_sql() -> str:
    from apothecary.plans.signals import SQL

    return f"""
WITH s AS ({SQL["q01_pair_cooccurrence"]}), p AS (SELECT p_name, CAST(max(p_size) AS DOUBLE) AS size, max(p_retailprice) AS price FROM part GROUP BY 1)
SELECT drug_a, drug_b, abs(a.size - b.size) AS size_gap, round(a.price / nullif(b.price, 0), 6) AS price_ratio, round(ln(1 + report_count), 6) AS signal, round(death_count / report_count, 6) AS death_rate
FROM s LEFT JOIN p a ON a.p_name = drug_a LEFT JOIN p b ON b.p_name = drug_b
"""


def paired_figures(pairs: DataFrame, props: DataFrame) -> DataFrame:
    """The thirty figures of each pair, from its signal and both sides' properties.

    Gaps and ratios are to four places; a side without a figure has 0 (ratios
    1), a side without properties 0 in every flag. ``both_small`` and
    ``one_biologic`` tell the kinds of the two drugs. A pair with a null
    ``report_count`` was never reported: its signal is 0 and ``pair_seen`` 0.
    """
    figures = ("mw", "logp", "binding", "life")
    for side in "ab":
        renamed = props.select(F.col("drug").alias("_key"), *[F.col(c).alias(f"_{c}_{side}") for c in (*figures, "kind", "boxed", "interacts", "known")])
        pairs = pairs.join(renamed, F.lower(F.trim(f"drug_{side}")) == F.col("_key"), "left").drop("_key")
    a, b = ({c: F.col(f"_{c}_{side}") for c in figures} for side in "ab")
    filled = lambda c, value=0.0: F.coalesce(c.cast("double"), F.lit(value))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0))
    of_kind = lambda side, word: F.coalesce(F.contains(F.lower(f"_kind_{side}"), F.lit(word)), F.lit(False))
    reports = F.nullif(F.col("report_count"), F.lit(0))
    present = sum((F.col(f"_{c}_{side}").isNotNull().cast("int") for c in figures for side in "ab"), F.lit(0))
    return pairs.select(
        "drug_a", "drug_b",
        *[filled(F.col(f"_{c}_{side}")).alias(f"{c}_{side}") for c in figures for side in "ab"],
        *[filled(numbers.rounded(numbers.gap(a[c], b[c]), 4)).alias(f"{c}_diff") for c in ("mw", "logp", "binding")],
        *[filled(numbers.rounded(numbers.ratio(a[c], b[c]), 4), 1.0).alias(f"{c}_ratio") for c in ("mw", "logp", "life")],
        (of_kind("a", "small") & of_kind("b", "small")).cast("int").alias("both_small"), (of_kind("a", "biotech") | of_kind("b", "biotech")).cast("int").alias("one_biologic"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("report_count", "death_count", "max_severity")],
        filled(numbers.rounded(F.col("death_count") / reports, 4)).alias("death_rate"), filled(F.round(F.log1p("report_count"), 4)).alias("signal_strength"), F.col("report_count").isNotNull().cast("int").alias("pair_seen"),
        flag("_boxed_a").alias("boxed_a"), flag("_boxed_b").alias("boxed_b"), F.greatest(flag("_boxed_a"), flag("_boxed_b")).alias("either_boxed"), flag("_interacts_a").alias("interacts_a"), flag("_interacts_b").alias("interacts_b"), flag("_known_a").alias("known_a"), flag("_known_b").alias("known_b"),
        F.round(present / 8, 3).alias("completeness"),
    )


def set_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared and joint brands of each co-occurring pair."""
    sets = table(spark, sf_dir, "part").groupBy("p_name").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    a = sets.select(F.col("p_name").alias("drug_a"), F.col("brands").alias("brands_a"))
    b = sets.select(F.col("p_name").alias("drug_b"), F.col("brands").alias("brands_b"))
    rows = pair_cooccurrence(spark, sf_dir).select("drug_a", "drug_b").join(a, "drug_a").join(b, "drug_b")
    both, either = F.array_intersect("brands_a", "brands_b"), F.array_union("brands_a", "brands_b")
    return rows.select("drug_a", "drug_b", F.size(both).alias("n_shared"), F.size(either).alias("n_joint"), F.array_join(F.array_sort(both), ",").alias("shared"))


def _set_features_sql() -> str:
    from apothecary.plans.signals import SQL

    return f"""
WITH s AS ({SQL["q01_pair_cooccurrence"]}), b AS (SELECT p_name, list(DISTINCT p_brand) AS l FROM part GROUP BY 1)
SELECT drug_a, drug_b, CAST(len(list_intersect(a.l, b.l)) AS INTEGER) AS n_shared, CAST(len(list_distinct(list_concat(a.l, b.l))) AS INTEGER) AS n_joint, array_to_string(list_sort(list_intersect(a.l, b.l)), ',') AS shared
FROM s JOIN b a ON a.p_name = drug_a JOIN b b ON b.p_name = drug_b
"""


#: Descriptions that tell the patterns apart: each part gets one of each.
LIVES = ("2 to 4 hours", "about 90 minutes", "1-2 days (24 hours)", "3 weeks", "unknown", "1.5 - 2.5 days", "10-20 min", "6 hrs", "2.345 hours", "7days")
BOUNDS = ("High (>90%)", "55 to 65%", "below 10%", "97%", "", "40-60 %", "slowly bound, 12%", "Moderate", "30 - %")


def given(texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int"))


def text_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-lives, binding shares and severities out of descriptions."""
    said = F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(": "))
    severity = rules.severity_of_text(F.concat(F.col("p_type"), F.when(F.col("p_size") > 25, " Severe risk").otherwise(" minor risk")))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.half_life_hours(F.concat(said, given(LIVES))).alias("hours"), numbers.protein_binding(given(BOUNDS)).alias("bound"), severity.alias("severity"))


def _number_sql() -> str:
    figure = lambda pattern, k: f"TRY_CAST(nullif(regexp_extract(lower(life), '{pattern}', {k}), '') AS DOUBLE)"
    cases = []
    for pattern, hours in numbers.HALF_LIFE_PATTERNS:
        middle = f"(({figure(pattern, 1)} + {figure(pattern, 2)}) / 2)" if "-" in pattern else figure(pattern, 1)
        cases.append(f"{middle} * {hours}" if hours >= 1 else f"{middle} / 60")
    bound = lambda k: figure(numbers.BINDING_PATTERN, k).replace("lower(life)", "lower(bound)")
    words = " ".join(f"WHEN contains(lower(bound), '{w}') THEN {v}" for w, v in numbers.BINDING_WORDS)
    return f"""
WITH p AS (SELECT p_partkey, p_size, 'Size ' || p_size || ': ' || ({list(LIVES)!r})[p_partkey % {len(LIVES)} + 1] AS life, ({list(BOUNDS)!r})[p_partkey % {len(BOUNDS)} + 1] AS bound FROM part)
SELECT p_partkey, round(coalesce({", ".join(cases)}), 2) AS hours, CAST(coalesce(CASE {words} END, ({bound(1)} + {bound(2)}) / 2, {bound(3)}, {bound(1)}) AS DOUBLE) AS bound, CASE WHEN p_size > 25 THEN 3 ELSE 1 END AS severity FROM p
"""


def impute_and_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double")).alias("size"), F.when(F.col("p_partkey") % 9 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("price"))
    done = metrics.impute_and_cap(parts, ["size", "price"])
    return done.select("p_partkey", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


_IMPUTE_SQL = """
WITH r AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS s, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE p_retailprice END AS p FROM part),
m AS (SELECT quantile_cont(s, 0.5) FILTER (s <> 0) AS ms, quantile_cont(p, 0.5) FILTER (p <> 0) AS mp FROM r),
f AS (SELECT p_partkey, CASE WHEN s IS NULL OR s = 0 THEN ms ELSE s END AS s, CASE WHEN p IS NULL OR p = 0 THEN mp ELSE p END AS p FROM r, m),
q AS (SELECT quantile_cont(s, 0.999) AS qs, quantile_cont(p, 0.999) AS qp FROM f)
SELECT p_partkey, round(least(s, qs), 6) AS size, round(least(p, qp), 6) AS price FROM f, q
"""


def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.lit(3.0).alias("constant"))
    return metrics.standardise(parts, ["size", "constant"]).select("p_partkey", F.round("size", 6).alias("size"), "constant")


_STANDARD_SQL = "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size, CAST(0 AS DOUBLE) AS constant FROM part"


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf_dir, "labels"), "quality")


_WEIGHTS_SQL = "WITH c AS (SELECT quality, count(*) AS n_rows FROM labels WHERE quality IS NOT NULL GROUP BY 1) SELECT quality, n_rows, (SELECT sum(n_rows) FROM c) / ((SELECT count(*) FROM c) * n_rows) AS weight FROM c"


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of the labelled rows by class, in the order of a hash."""
    return metrics.stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "split")


_SPLIT_SQL = """
WITH r AS (SELECT doc_id, quality, percent_rank() OVER (PARTITION BY quality ORDER BY md5(doc_id || '-42'), doc_id) AS p FROM labels)
SELECT doc_id, quality, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM r
"""


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("guess"))
    return metrics.class_scores(rows, "quality", "guess")


_SCORES_SQL = """
WITH r AS (SELECT quality AS a, 1 - toxic AS p FROM labels), c AS (SELECT a AS class FROM r UNION SELECT p FROM r),
s AS (SELECT class, (SELECT count(*) FROM r WHERE a = class) AS support, (SELECT count(*) FROM r WHERE p = class) AS given, (SELECT count(*) FROM r WHERE a = class AND p = class) AS hits FROM c),
t AS (SELECT class, support, CASE WHEN given = 0 THEN 0.0 ELSE hits / given END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS recall FROM s)
SELECT class, support, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM t
"""


def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length tells its quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("quality", "n_chars")
    scores = metrics.ranking_scores(rows, "quality", "n_chars")
    return scores.select("n_positive", "n_negative", F.round("auc", 9).alias("auc"), F.round("average_precision", 9).alias("average_precision"))


_RANKING_SQL = """
WITH r AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), p AS (SELECT s FROM r WHERE y = 1), n AS (SELECT s FROM r WHERE y <> 1),
d AS (SELECT s, count(*) FILTER (y = 1) AS hits FROM r GROUP BY 1),
c AS (SELECT d.s, d.hits, (SELECT count(*) FROM r WHERE r.s >= d.s) AS above, (SELECT count(*) FROM p WHERE p.s >= d.s) AS tp FROM d)
SELECT (SELECT count(*) FROM p) AS n_positive, (SELECT count(*) FROM n) AS n_negative,
  round((SELECT avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) FROM p, n), 9) AS auc, round((SELECT sum(hits * tp / above) FROM c) / (SELECT count(*) FROM p), 9) AS average_precision
"""


def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.node_features(pair_cooccurrence(spark, sf_dir), ["report_count", "max_severity"])
    return nodes.select("node", F.round("mean_report_count", 6).alias("mean_report_count"), F.round("mean_max_severity", 6).alias("mean_max_severity"), "degree")


def _nodes_sql() -> str:
    from apothecary.plans.signals import SQL

    return f"""
WITH s AS ({SQL["q01_pair_cooccurrence"]}), e AS (SELECT drug_a AS node, report_count, max_severity FROM s UNION ALL SELECT drug_b, report_count, max_severity FROM s)
SELECT node, round(avg(report_count), 6) AS mean_report_count, round(avg(max_severity), 6) AS mean_max_severity, count(*) AS degree FROM e GROUP BY 1
"""


def attention_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.both_ways(pair_cooccurrence(spark, sf_dir), "drug_a", "drug_b", "report_count").withColumn("score", F.col("report_count") / 100)
    return graph.segment_softmax(edges, "dst", "score").select("src", "dst", F.round("weight", 9).alias("weight"))


def _attention_sql() -> str:
    from apothecary.plans.signals import SQL

    return f"""
WITH s AS ({SQL["q01_pair_cooccurrence"]}), e AS (SELECT drug_a AS src, drug_b AS dst, report_count / 100 AS score FROM s UNION ALL SELECT drug_b, drug_a, report_count / 100 FROM s),
x AS (SELECT src, dst, exp(score - greatest(0, max(score) OVER (PARTITION BY dst))) AS w FROM e)
SELECT src, dst, round(w / (sum(w) OVER (PARTITION BY dst) + 1e-9), 9) AS weight FROM x
"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and distinct names by type, with the share of those sold."""
    parts, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(1))
    return parts.join(items, "p_partkey", "left").groupBy("p_type").agg(F.count("*").alias("n_raw"), F.countDistinct(F.lower("p_name")).alias("n_distinct"), F.avg(F.coalesce("hit", F.lit(0))).alias("coverage"))


_COVERAGE_SQL = "SELECT p_type, count(*) AS n_raw, count(DISTINCT lower(p_name)) AS n_distinct, avg(CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem) THEN 1 ELSE 0 END) AS coverage FROM part GROUP BY 1"

QUERIES = {
    "q43_role_mentions": role_mentions,
    "q44_pair_features": pair_features,
    "q45_set_features": set_features,
    "q46_text_to_number": text_to_number,
    "q47_impute_and_cap": impute_and_cap,
    "q48_standardise": standardise,
    "q49_class_weights": class_weights,
    "q50_stratified_split": stratified_split,
    "q51_class_scores": class_scores,
    "q52_ranking_scores": ranking_scores,
    "q53_node_features": node_features,
    "q54_attention_weights": attention_weights,
    "q57_coverage": coverage,
}
SQL = {
    "q43_role_mentions": _ROLE_SQL,
    "q44_pair_features": _pair_features_sql(),
    "q45_set_features": _set_features_sql(),
    "q46_text_to_number": _number_sql(),
    "q47_impute_and_cap": _IMPUTE_SQL,
    "q48_standardise": _STANDARD_SQL,
    "q49_class_weights": _WEIGHTS_SQL,
    "q50_stratified_split": _SPLIT_SQL,
    "q51_class_scores": _SCORES_SQL,
    "q52_ranking_scores": _RANKING_SQL,
    "q53_node_features": _nodes_sql(),
    "q54_attention_weights": _attention_sql(),
    "q57_coverage": _COVERAGE_SQL,
}
