"""Records of medications, laboratory values and searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Laboratory values that a profile takes, in its order: fixed values.
LABS = ("egfr", "creatinine", "ast", "alt", "inr", "hba1c", "potassium", "hemoglobin")


def medication_parts(said: Column) -> dict[str, Column]:
    """Name, dose and frequency: the first word, the second and the rest; null where there is none."""
    words = F.filter(F.split(said, r"\s+"), lambda w: w != "")
    rest = F.array_join(F.slice(words, 3, 1000), " ")
    return {"drug_name": F.coalesce(F.get(words, 0), said), "dose": F.get(words, 1), "frequency": F.when(F.size(words) > 2, rest)}


def lab_patch(labs: Column) -> Column:
    """The entries of a map of laboratory values that a profile takes and that have a value, as numbers."""
    return F.map_filter(F.transform_values(labs, lambda k, v: v.try_cast("double")), lambda k, v: k.isin(*LABS) & v.isNotNull())


def literature_query(drug_a: Column, drug_b: Column) -> Column:
    """The search for reports on a pair of drugs."""
    return F.format_string('"%s"[Title/Abstract] AND "%s"[Title/Abstract] AND (interaction OR toxicity OR adverse)', drug_a, drug_b)


def first_filled(**lists: Column) -> tuple[Column, Column]:
    """The first of several lists that is not empty, and its name; an empty list under ``none`` if all are."""
    filled = {name: F.coalesce(F.size(c) > 0, F.lit(False)) for name, c in lists.items()}
    chosen = F.coalesce(*[F.when(filled[name], c) for name, c in lists.items()], F.array().cast("array<string>"))
    return chosen, F.coalesce(*[F.when(filled[name], F.lit(name)) for name in lists], F.lit("none"))
