"""A corpus pipeline over ``documents``: language, exact copies, near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its
result is written and read again as the next one's docs. All but the last return the columns of
documents; a document that the mix takes twice is two rows. Rows without a doc_id pass the first
stage like others and are dropped as no documents when the mix counts words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, language_id, mixing, near_dedup, packing
from marlstone.llm.common import fresh, table, without, written

#: Documents whose language is recognised with less confidence are rejected.
LEAST_SCORE = 0.5
#: Words of a shingle in the near-duplicate stage.
WIDTH = 5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those whose language is not recognised; all others stay, repeated rows as often as they come.

    Null and empty texts have no letter; very long texts are read whole. Rows without a doc_id are judged, but teach nothing.
    """
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    model = language_id.train(rows.where(language_id.remainder("doc_id", 5) != 0))
    return language_id.accept(rows, model, LEAST_SCORE)


def repeated(docs: DataFrame) -> DataFrame:
    """The doc_id of rows that share one."""
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that with the largest doc_id. Of rows that repeat, one stays."""
    found = exact_dedup.exact_duplicates(docs)
    out = without(docs, found.where(~F.col("kept")), "doc_id", text_sha256=F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    again = repeated(docs)
    if again.isEmpty():
        return out
    once = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return without(out, again, "doc_id").unionByName(once)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8) stays: that with the smallest doc_id.

    Of rows that share a doc_id only those go whose own text is a near copy of a smaller document. Null and
    empty texts have no near copies and stay; very long ones are compared whole. Rows without a doc_id stay.
    """
    dropped = written(near_dedup.near_duplicates(docs, width=WIDTH).where(~F.col("kept")), "near-copies")
    again = repeated(docs)
    if again.isEmpty():
        return without(docs, dropped)
    again = written(again, "repeated")
    names = fresh(3)
    several = near_dedup.with_fingerprint(docs.join(again, "doc_id", "left_semi").select(*docs.columns), names, width=WIDTH)
    gone = dropped.select(F.col("doc_id"), *[F.col(c).alias(n) for c, n in zip(("n_shingles", "h1", "h2"), names)])
    several = several.join(gone, ["doc_id", *names], "left_anti").select(*docs.columns)
    once = without(docs, again)
    return without(once, dropped).unionByName(several)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a document that it does not take goes.

    Rows that share a doc_id are told apart by text and source; those that repeat all three are taken alike. Rows
    without a doc_id and without words go, as the mix takes no word of them.
    """
    doc, text, source, times, copy = fresh(5)
    taken = mixing.mix(docs).where("copies > 0").groupBy("doc_id", "text_hash", "source").agg(F.max("copies").cast("int").alias(times))
    taken = taken.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("source").alias(source), times)
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(text)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    return docs.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a row per piece of every row that has a doc_id, repeated ones included. Longer texts are cut."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", languages),
    ("exact_dedup", copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("best_fit_packing", pack),
]

#: Language models and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
