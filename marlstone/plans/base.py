"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"there are two queries {name}")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files make fewer splits than there are task slots is dealt out over all slots, larger ones are read as they lie.

    Filters and column choices still reach the scan.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots) if df._jdf.queryExecution().toRdd().getNumPartitions() < slots else df
