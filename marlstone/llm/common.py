"""Shared folder, materialised steps and small DataFrame helpers of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/marlstone/{tag}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone; another one may not
            continue


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t._written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(key: Column, parts: Column | int) -> Column:
    """An even number from 0 to parts - 1 for a key."""
    return F.pmod(F.xxhash64(key), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


#: Bits of the membership filter below: at most 2**23 / 64 = 131,072 rows of 16 bytes, whatever the input.
FILTER_BITS = 23


def filter_words(keys: DataFrame, key: str) -> DataFrame:
    """A one-hash membership filter over ``key`` as rows (word, bits); never more than 2**(FILTER_BITS - 6) rows."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    return (
        keys.select(h.alias("_h"))
        .groupBy(F.shiftright("_h", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_h & 63 as int))")).alias("_bits"))
    )


def fresh(n: int) -> list[str]:
    """Column names that no table has."""
    return [f"_{uuid.uuid4().hex}" for _ in range(n)]


def _filtered(df: DataFrame, key: str, words: DataFrame, how: str) -> DataFrame:
    h, w, word, bits = fresh(4)
    left = df.withColumn(h, F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))).withColumn(w, F.shiftright(h, 6))
    right = words.select(F.col("_word").alias(word), F.col("_bits").alias(bits))
    hit = (F.col(w) == F.col(word)) & (F.expr(f"shiftright({bits}, cast({h} & 63 as int)) & 1") == 1)
    return left.join(F.broadcast(right), hit, how).drop(h, w)


def maybe_in(df: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter. The filter's size is bounded, so it is sent to every task."""
    return _filtered(df, key, words, "left_semi")


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", **more: Column) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``dropped``; with ``more``, whose key and further columns together are not: each a column of ``dropped`` and its expression over docs.

    Rows that the bounded filter excludes stay where they are; only the others are moved for the exact test.
    Columns of docs may have any names.
    """
    dropped = written(dropped.select(key, *more), "dropped")
    words = written(filter_words(dropped, key), "filter")
    names = fresh(1 + len(more))
    gone = dropped.select(*[F.col(c).alias(n) for c, n in zip([key, *more], names)])
    unsure = maybe_in(docs, key, words).withColumn(names[0], F.col(key))
    for n, expr in zip(names[1:], more.values()):
        unsure = unsure.withColumn(n, expr)
    return _filtered(docs, key, words, "left_anti").unionByName(unsure.join(gone, names, "left_anti").select(*docs.columns))
