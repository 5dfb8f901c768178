"""Tables and files: scratch paths, index tables by configuration, quarantine, exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``); a local one only where none is set and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/marlstone/{tag}-{uuid.uuid4().hex}"


def index_name(*parts: str) -> str:
    return "icd_" + "_".join(re.sub(r"[^a-z0-9]+", "_", p.lower()).strip("_") for p in parts)


class Index:
    """A chunk table of one configuration under a folder, partitioned by document.

    Writing replaces the partitions of the documents written, so a document is indexed anew without a
    separate delete. Rows whose vector has not the index's dimension go to a quarantine table.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, dims: int):
        self.spark, self.path, self.bad, self.dims = spark, f"{root}/{name}", f"{root}/{name}__quarantine", dims

    def exists(self) -> bool:
        return _files(self.spark, self.path)[0].exists(_files(self.spark, self.path)[1])

    def create(self, schema: str) -> bool:
        """Make an empty index (doc, ..., embedding) where there is none; whether it was made."""
        if self.exists():
            return False
        self.spark.createDataFrame([], schema).write.parquet(self.path)
        return True

    def write(self, chunks: DataFrame) -> None:
        """Replace the partitions of the documents that ``chunks`` has; a document without chunks keeps its old ones, see ``delete_documents``."""
        good = F.size("embedding") == self.dims
        chunks.where(good).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(self.path)
        chunks.where(~good | good.isNull()).write.mode("append").parquet(self.bad)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def quarantined(self) -> DataFrame:
        return self.spark.read.parquet(self.bad)

    def delete_documents(self, docs: list) -> None:
        """Drop the partitions of the documents named by the caller."""
        for d in docs:
            self._delete(f"{self.path}/doc={d}")

    def drop(self) -> None:
        self._delete(self.path)
        self._delete(self.bad)

    def stats(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("n_chunks"), F.count_distinct("doc").alias("n_docs"))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_indices(spark: SparkSession, root: str) -> DataFrame:
    """(index, n_chunks, n_docs, bytes) of the indices under a folder, by name; quarantines and other folders are left out."""
    fs, p = _files(spark, root)
    found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
    rows = []
    for name in (n for n in found if n.startswith("icd_") and not n.endswith("__quarantine")):
        size = fs.getContentSummary(_files(spark, f"{root}/{name}")[1]).getLength()
        counted = spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("d")).head()
        rows.append((name, counted.n, counted.d, size))
    return spark.createDataFrame(rows, "index string, n_chunks long, n_docs long, bytes long").orderBy("index")


def run_folder(root: str, run: str, stem: str) -> str:
    """The folder of a document's output in a run; runs are told apart by their time, which sorts as text."""
    return f"{root.rstrip('/')}/run={run}/doc={re.sub(r'[^A-Za-z0-9._-]+', '_', stem)}"


def append_new(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Items that are not known yet."""
    return items.join(known.select(key).distinct(), key, "left_anti")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted CSV files with a header, every value quoted."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, quoteAll=True)
