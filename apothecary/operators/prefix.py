"""Running totals over a whole order, cut into ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.operators.settle import settled


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with a column for each of ``sums`` (name of the result: numeric column): its total from the first row in ``order`` up to this one, within ``by``.

    Rows are parted by ranges of the order, as many as there are shuffle
    partitions, and the parted table is written once: where a row lies is then
    a column and no longer depends on a sample. Totals of ranges, a row each,
    are summed up before rows meet them; no task has more than one range of a
    ``by`` group. Rows equal in ``order`` must not differ in place, so sum them
    up first. Nulls in summed columns count as 0.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = settled(rows.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    ranges = parted.groupBy(*by, "_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_of_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), *[F.coalesce(F.sum(f"_of_{name}").over(earlier), F.lit(0)).alias(f"_of_{name}") for name in sums])
    on = F.col("_range") == F.col("_at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    up_to = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = parted.withColumns({name: F.coalesce(F.sum(c).over(up_to), F.lit(0)) for name, c in sums.items()})
    joined = inner.join(before, on)
    return joined.select(*rows.columns, *[(F.col(name) + F.col(f"_of_{name}")).alias(name) for name in sums])
