"""Feature preparation and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apothecary.operators.prefix import running_sums
from apothecary.operators.quantiles import exact_quantiles


def impute_and_cap(df: DataFrame, columns: list[str], cap: float = 0.999) -> DataFrame:
    """Nulls and zeros become the median of the other values; then values over the ``cap`` quantile become that quantile."""
    known = {c: F.when(F.col(c) != 0, F.col(c)) for c in columns}
    medians = exact_quantiles(df, {c: (known[c], 0.5) for c in columns}).first()
    filled = df.withColumns({c: F.coalesce(known[c], F.lit(medians[c])) for c in columns})
    caps = exact_quantiles(filled, {c: (c, cap) for c in columns}).first()
    return filled.withColumns({c: F.least(F.col(c), F.lit(caps[c])) for c in columns})


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1; constant columns become 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.avg), ("s", F.stddev_pop))])
    scaled = {c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "as"])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows and balanced weight n / (classes x rows) of each class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_rows"))
    totals = counts.agg(F.sum("n_rows").alias("_n"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(totals)).select(label, "n_rows", (F.col("_n") / (F.col("_k") * F.col("n_rows"))).alias("weight"))


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Column ``split`` with train, val or test in the given shares of each class, by the order of an MD5 hash.

    A row's place in its class is its place among the rows of one of 4096
    slices of the hash plus the number of rows in the slices before: no class
    is sorted in one task.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))).withColumn("_slice", F.left("_hash", F.lit(3)))
    counts = hashed.groupBy(label, "_slice").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy(label)
    before = counts.select(F.col(label).alias("_label"), "_slice", (F.sum("_n").over(by_label.orderBy("_slice")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_label).alias("_total"))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_hash", key)))
    placed = ranked.join(before.withColumnRenamed("_slice", "_of"), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_slice") == F.col("_of")))
    place = (F.col("_before") + F.col("_rank") - 1) / F.greatest(F.lit(1), F.col("_total") - 1)
    return placed.withColumn("split", F.when(place < train, "train").when(place < train + val, "val").otherwise("test")).select(*df.columns, "split")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class seen; 0 where undefined."""
    cells = confusion(df, actual, predicted)
    classes = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("class"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("x"))
    sums = classes.groupBy("x.class").agg(F.sum("x.a").alias("support"), F.sum("x.p").alias("given"), F.sum("x.hit").alias("hits"))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    scored = sums.withColumn("precision", share("hits", "given")).withColumn("recall", share("hits", "support"))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both)).select("class", "support", "precision", "recall", "f1")


def overall_scores(df: DataFrame, actual: str, predicted: str, severity: str, guess: str) -> DataFrame:
    """One row: accuracy, macro averages over the classes seen, and the mean error of ``guess`` where ``severity`` is over 0."""
    scores = class_scores(df, actual, predicted).agg(F.count("*").alias("n_classes"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    whole = df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"), F.avg(F.when(F.col(severity) > 0, F.abs(F.col(severity) - F.col(guess)))).alias("severity_mae"))
    return scores.join(F.broadcast(whole))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``place`` from 0 in ascending order of a column without repeats, counted over ranges of the order."""
    counted = running_sums(df.withColumn("_one", F.lit(1)), [F.col(order)], {"place": "_one"})
    return counted.withColumn("place", F.col("place") - 1).drop("_one")


def _areas(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n_positive, n_negative, auc and average_precision within ``by`` from the numbers ``p`` and ``q`` of positives and others at each distinct score ``s``."""
    run = running_sums(counts, [F.desc("s")], {"tp": "p", "fp": "q"}, by)
    totals = run.groupBy(*by).agg(F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"), F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("_won"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"))
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    return totals.select(*by, "n_positive", "n_negative", (F.col("_won") / (some("n_positive") * some("n_negative"))).alias("auc"), (F.col("_ap") / some("n_positive")).alias("average_precision"))


def ranking_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC area (ties by half), average precision and the two class counts, from counts per distinct score; null where a class is missing."""
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    return _areas(counts)


def one_versus_rest(df: DataFrame, label: str, scores: dict[int, str]) -> DataFrame:
    """Of each class that occurs in ``label``: n_positive, n_negative, auc and average_precision of its score column against all other rows.

    ``scores`` names a column for each class. A class without rows has no row
    here; one that is the label of every row has a null area. Rows with a null
    label take no part; a null score takes its row out of that class alone.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(name).cast("double").alias("s")) for c, name in scores.items()]))
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_label"), each.alias("x")).select("_label", "x.*").where("s is not null")
    counts = rows.groupBy("class", "s").agg(F.count_if(F.col("_label") == F.col("class")).alias("p"), F.count_if(F.col("_label") != F.col("class")).alias("q"))
    return _areas(counts, ("class",)).where("n_positive > 0")


def macro_scores(classes: DataFrame) -> DataFrame:
    """One row from ``one_versus_rest``: the number of classes and the means of auc and average_precision over those that have both kinds of rows."""
    return classes.where("auc is not null").agg(F.count("*").alias("n_classes"), F.avg("auc").alias("macro_auc"), F.avg("average_precision").alias("macro_average_precision"))
