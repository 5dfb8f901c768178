"""Elements of sorted groups by counts, without a group's values in one array."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def picked(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): the element at index int(n * share) of each group's sorted values, at most the last; not interpolated.

    Equal values are counted before they are ranked, and a group's distinct values pass through a window in order, which spills; nulls do not count.
    A group of nulls has no row. Groups are told apart by ``by``, in which null is a value too.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = counted.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = lambda s: F.least(F.floor(F.col("_n") * s), F.col("_n") - 1)
    here = lambda s: (F.col("_to") - F.col("_c") <= at(s)) & (at(s) < F.col("_to"))
    return ranked.groupBy(*by).agg(*[F.max(F.when(here(s), F.col(value))).alias(n) for n, s in shares.items()])
