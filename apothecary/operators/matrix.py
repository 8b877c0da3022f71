"""A feature matrix: columns by type, filled, capped and scaled by parameters that are fitted on one part of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType

from apothecary.operators.quantiles import exact_quantiles

_NUMERIC = (DoubleType, FloatType, LongType, IntegerType, BooleanType)
PARAMETERS = "position int, feature string, median double, cap double, mean double, deviation double"


def labelled(rows: DataFrame, label: str, least: int = 0, most: int | None = None) -> DataFrame:
    """Rows that have a label, as an int of ``least`` and more; ``most`` keeps only so many, for trials."""
    kept = rows.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int")).where(F.col(label) >= least)
    return kept if most is None else kept.limit(most)


def feature_columns(rows: DataFrame, leave_out: tuple[str, ...]) -> list[str]:
    """Columns of double, float, long, int or boolean type in the table's order, but those of ``leave_out``."""
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in leave_out]


def _known(name: str) -> Column:
    return F.when(F.col(f"`{name}`").cast("double") != 0, F.col(f"`{name}`").cast("double"))


def _cleaned(name: str, median: float | None, cap: float | None, filled: bool) -> Column:
    value = F.coalesce(_known(name), F.lit(median or 0.0)) if filled else F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))
    return value if cap is None else F.least(value, F.lit(cap))


def fit(rows: DataFrame, features: list[str], medians: tuple[str, ...] = (), caps: dict[str, str] | None = None, cap: float = 0.999, bound: int = 65_536) -> DataFrame:
    """Parameters of each feature: position, feature, median, cap, mean and deviation (population's; a constant's is 1).

    Features of ``medians`` take the median of their values other than null
    and zero where they are null or zero (0 if they have no other), the rest
    take 0 where they are null. ``caps`` names for a feature the feature whose
    ``cap`` quantile, after filling, is its upper bound. Mean and deviation are
    of the filled and capped values. An empty table gives medians, caps and
    means of 0 and deviations of 1.
    """
    caps = {f: of for f, of in (caps or {}).items() if f in features and of in features}
    filled = [f for f in features if f in medians]
    median = exact_quantiles(rows, {f: (_known(f), 0.5) for f in filled}, bound=bound).first().asDict() if filled else {}
    sources = sorted(set(caps.values()))
    cut = exact_quantiles(rows, {f: (_cleaned(f, median.get(f), None, f in filled), cap) for f in sources}, bound=bound).first().asDict() if sources else {}
    limit = {f: cut[of] or 0.0 for f, of in caps.items()}
    clean = {f: _cleaned(f, median.get(f), limit.get(f), f in filled) for f in features}
    sums = rows.agg(*[how(clean[f]).alias(f"{n}{i}") for i, f in enumerate(features) for n, how in (("mean", F.avg), ("deviation", F.stddev_pop))]).first()
    table = [
        (i, f, (median.get(f) or 0.0) if f in filled else None, limit.get(f), sums[f"mean{i}"] or 0.0, _deviation(sums[f"deviation{i}"]))
        for i, f in enumerate(features)
    ]
    return rows.sparkSession.createDataFrame(table, PARAMETERS).coalesce(1)


def _deviation(value: float | None) -> float:
    return value if value and not math.isnan(value) else 1.0


def cleaned(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """``rows`` with every feature of ``parameters`` filled and capped, as double; other columns stay."""
    return rows.withColumns({p["feature"]: _cleaned(p["feature"], p["median"], p["cap"], p["median"] is not None) for p in _ordered(parameters)})


def scaled(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """``rows`` with every feature filled, capped and scaled by ``parameters``; other columns stay.

    Parameters have one row a feature and are read on the driver; rows of any
    table with these columns can be prepared, the fitted part's or new ones.
    """
    found = _ordered(parameters)
    clean = {p["feature"]: _cleaned(p["feature"], p["median"], p["cap"], p["median"] is not None) for p in found}
    return rows.withColumns({p["feature"]: (clean[p["feature"]] - F.lit(p["mean"])) / F.lit(p["deviation"]) for p in found})


def _ordered(parameters: DataFrame) -> list:
    return sorted(parameters.collect(), key=lambda p: p["position"])
