"""The feature matrix of drug pairs with its parameters, and scores of several classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import rules
from apothecary.functions.numbers import pair_key, rounded
from apothecary.operators import matrix, metrics, profiles
from apothecary.operators.settle import settled
from apothecary.plans import clinical, features
from apothecary.plans.signals import SQL as SIGNALS
from apothecary.plans.signals import pair_cooccurrence
from apothecary.sources.tables import table

#: Features whose nulls and zeros become a median, and whose cap is whose quantile: fixed values.
MEDIANS = ("mw_a", "mw_b", "mw_diff", "mw_ratio", "logp_a", "logp_b", "logp_diff", "logp_ratio", "binding_a", "binding_b", "binding_diff", "life_a", "life_b", "life_ratio")
CAPS = {"mw_a": "mw_a", "mw_b": "mw_a", "report_count": "report_count"}
#: What is known of pairs: each gets one by the lengths of its names; without a text there is no label.
_SAID = ("A major interaction.", "Moderate: monitor.", None, "Minor", "of no known effect", "SEVERE, seldom mild", "Serious harm")


def described_pairs(signals: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs as a drug table has them, with a severity where their description gives one: reported ones the other way round, and parts with their brand."""
    brands = parts.select(F.col("p_name").alias("drug_a"), F.col("p_brand").alias("drug_b")).distinct()
    pairs = signals.select(F.col("drug_b").alias("drug_a"), F.col("drug_a").alias("drug_b")).union(brands)
    said = F.element_at(F.array(*map(F.lit, _SAID)), ((F.length("drug_a") * 3 + F.length("drug_b") + F.ascii(F.substring("drug_a", 3, 1))) % len(_SAID) + 1).cast("int"))
    return pairs.withColumn("severity", F.when(said.isNotNull(), rules.severity_of_text(said)))


def with_signals(pairs: DataFrame, signals: DataFrame) -> DataFrame:
    """``pairs`` with report_count, death_count and max_severity of their signal in either order of the names; of several that with most reports; null without one."""
    best = signals.groupBy(pair_key(F.trim("drug_a"), F.trim("drug_b")).alias("_of")).agg(F.max_by(F.struct("report_count", "death_count", "max_severity"), F.struct("report_count", "death_count", "max_severity")).alias("_signal"))
    return pairs.withColumn("_key", pair_key(F.trim("drug_a"), F.trim("drug_b"))).join(best, F.col("_key") == F.col("_of"), "left").select(*pairs.columns, "_signal.*")


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 42 figures of each pair with a severity, its split by class, and the pair."""
    signals = settled(pair_cooccurrence(spark, sf_dir).select("drug_a", "drug_b", "report_count", "death_count", "max_severity"))
    pairs = matrix.labelled(described_pairs(signals, table(spark, sf_dir, "part")), "severity")
    figures = features.paired_figures(with_signals(pairs.drop("severity"), signals), clinical.drug_properties(spark, sf_dir))
    figures = profiles.pair_figures(figures, clinical.drug_profiles(spark, sf_dir))
    names = {c: f"_{c}" for c in ("drug_a", "drug_b")}
    labels = pairs.select("drug_a", "drug_b", "severity").withColumnsRenamed(names)
    rows = figures.join(labels, (F.col("drug_a") == F.col("_drug_a")) & (F.col("drug_b") == F.col("_drug_b"))).drop(*names.values())
    rows = rows.withColumn("pair", F.concat_ws("|", "drug_a", "drug_b"))
    return settled(metrics.stratified_split(rows, "severity", "pair"))


def _fitted(rows: DataFrame) -> DataFrame:
    columns = matrix.feature_columns(rows, ("severity",))
    return matrix.fit(rows.where("split = 'train'"), columns, MEDIANS, CAPS)


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix, filled, capped and scaled by what the training part gives."""
    rows = labelled_features(spark, sf_dir)
    parameters = _fitted(rows)
    scaled = matrix.scaled(rows, parameters)
    return scaled.select("drug_a", "drug_b", "severity", "split", *[rounded(F.col(c), 6).alias(c) for c in matrix.feature_columns(rows, ("severity",))])


def feature_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _fitted(labelled_features(spark, sf_dir))
    return fitted.select("position", "feature", *[rounded(F.col(c), 6).alias(c) for c in ("median", "cap", "mean", "deviation")])


FEATURES = (
    *[f"{c}_{s}" for c in ("mw", "logp", "binding", "life") for s in "ab"], "mw_diff", "logp_diff", "binding_diff", "mw_ratio", "logp_ratio", "life_ratio", "both_small", "one_biologic",
    "report_count", "death_count", "max_severity", "death_rate", "signal_strength", "pair_seen", "boxed_a", "boxed_b", "either_boxed", "interacts_a", "interacts_b", "known_a", "known_b", "completeness",
    "shared_cyp_count", "inhibitor_substrate_pairs", "inducer_substrate_pairs", *[f"{e.lower()}_involved" for e in clinical.cyp.FLAGGED], "max_cyp_risk_score", "any_cyp_interaction", "n_enzymes_involved",
)


def _matrix_sql() -> str:
    said = "[" + ", ".join("NULL" if t is None else f"'{t}'" for t in _SAID) + "]"
    severity = "greatest(" + ", ".join(f"CASE WHEN contains(lower(said), '{w}') THEN {s} ELSE 0 END" for w, s in rules.SEVERITY_WORDS.items()) + ")"
    pairs = f"""
SELECT * EXCLUDE (said), CASE WHEN said IS NOT NULL THEN {severity} END AS severity FROM (SELECT *, ({said})[(length(drug_a) * 3 + length(drug_b) + ascii(substr(drug_a, 3, 1))) % {len(_SAID)} + 1] AS said FROM
  (SELECT drug_b AS drug_a, drug_a AS drug_b, report_count, death_count, max_severity FROM ({SIGNALS["q01_pair_cooccurrence"]}) UNION ALL SELECT DISTINCT p_name, p_brand, NULL, NULL, NULL FROM part))"""
    signals = f"SELECT * FROM ({pairs}) WHERE severity IS NOT NULL"
    filled = ", ".join(f"CASE WHEN {c} <> 0 THEN {c} ELSE coalesce((SELECT {c} FROM md), 0) END AS {c}" if c in MEDIANS else f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
    capped = ", ".join(f"least({c}, (SELECT {CAPS[c]} FROM cp)) AS {c}" if c in CAPS else c for c in FEATURES)
    return f"""
WITH lab AS MATERIALIZED ({signals}), m1 AS ({clinical.molecular_sql("SELECT * FROM lab")}), m2 AS ({clinical.enzyme_sql("SELECT * FROM lab")}),
raw AS MATERIALIZED (SELECT drug_a, drug_b, severity, CASE WHEN q < 0.7 THEN 'train' WHEN q < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split, {", ".join(FEATURES)} FROM
  (SELECT m1.*, m2.* EXCLUDE (drug_a, drug_b), lab.severity, percent_rank() OVER (PARTITION BY lab.severity ORDER BY md5(drug_a || '|' || drug_b || '-42'), drug_a || '|' || drug_b) AS q FROM m1 JOIN m2 USING (drug_a, drug_b) JOIN lab USING (drug_a, drug_b))),
md AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) FILTER ({c} <> 0) AS {c}" for c in MEDIANS)} FROM raw WHERE split = 'train'),
fl AS MATERIALIZED (SELECT drug_a, drug_b, severity, split, {filled} FROM raw),
cp AS (SELECT {", ".join(f"quantile_cont({c}, 0.999) AS {c}" for c in sorted(set(CAPS.values())))} FROM fl WHERE split = 'train'),
cl AS MATERIALIZED (SELECT drug_a, drug_b, severity, split, {capped} FROM fl),
st AS MATERIALIZED (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)} FROM cl WHERE split = 'train')
"""


def _scaled_sql() -> str:
    scaled = ", ".join(f"round(({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in FEATURES)
    return f"{_matrix_sql()} SELECT drug_a, drug_b, severity, split, {scaled} FROM cl, st"


def _parameters_sql() -> str:
    of = lambda c, names, source: f"(SELECT round({names[c] if isinstance(names, dict) else c}, 6) FROM {source})" if c in names else "CAST(NULL AS DOUBLE)"
    each = [f"SELECT {i} AS position, '{c}' AS feature, {of(c, MEDIANS, 'md')} AS median, {of(c, CAPS, 'cp')} AS cap, round(a_{c}, 6) AS mean, round(CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS deviation FROM st" for i, c in enumerate(FEATURES)]
    return f"{_matrix_sql()} {' UNION ALL '.join(each)}"


#: Classes of documents by the number of letters, and what each class is scored by; no document is of class 4.
_CLASSES = {0: (7, 11), 1: (13, 5), 2: (4, 1), 3: (1000, 3), 4: (6, 5)}


def _class_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, str]]:
    def score(k: int) -> Column:
        modulus, step = _CLASSES[k]
        return (F.col("n_chars") * step % modulus).cast("double") / modulus

    rows = table(spark, sf_dir, "documents").select((F.col("n_chars") % 4).cast("int").alias("class"), *[score(k).alias(f"score_{k}") for k in _CLASSES])
    return rows, {k: f"score_{k}" for k in _CLASSES}


def class_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each class's score tells it from the other classes: ties, a full score and an absent class among them."""
    rows, scores = _class_rows(spark, sf_dir)
    areas = metrics.one_versus_rest(rows, "class", scores)
    return areas.select("class", "n_positive", "n_negative", F.round("auc", 9).alias("auc"), F.round("average_precision", 9).alias("average_precision"))


def macro_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scores = _class_rows(spark, sf_dir)
    found = metrics.macro_scores(metrics.one_versus_rest(rows, "class", scores))
    return found.select("n_classes", F.round("macro_auc", 9).alias("macro_auc"), F.round("macro_average_precision", 9).alias("macro_average_precision"))


_AREAS_SQL = f"""
WITH r AS ({" UNION ALL ".join(f"SELECT CAST(n_chars % 4 AS INTEGER) AS label, {k} AS class, n_chars * {step} % {m} / {m} AS s FROM documents" for k, (m, step) in _CLASSES.items())}),
d AS (SELECT class, s, count(*) FILTER (label = class) AS p, count(*) FILTER (label <> class) AS q FROM r GROUP BY 1, 2),
w AS (SELECT *, sum(p) OVER v AS tp, sum(q) OVER v AS fp FROM d WINDOW v AS (PARTITION BY class ORDER BY s DESC)),
x AS (SELECT class, CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(q) AS BIGINT) AS n_negative, sum(q * (tp - p / 2)) / (sum(p) * sum(q)) AS auc, sum(p * tp / (tp + fp)) / sum(p) AS average_precision FROM w GROUP BY 1 HAVING sum(p) > 0)
"""

QUERIES = {
    "q92_feature_matrix": feature_matrix,
    "q93_feature_parameters": feature_parameters,
    "q94_class_areas": class_areas,
    "q95_macro_areas": macro_areas,
}
SQL = {
    "q92_feature_matrix": _scaled_sql(),
    "q93_feature_parameters": _parameters_sql(),
    "q94_class_areas": f"{_AREAS_SQL} SELECT class, n_positive, n_negative, round(auc, 9) AS auc, round(average_precision, 9) AS average_precision FROM x",
    "q95_macro_areas": f"{_AREAS_SQL} SELECT count(*) AS n_classes, round(avg(auc), 9) AS macro_auc, round(avg(average_precision), 9) AS macro_average_precision FROM x",
}
