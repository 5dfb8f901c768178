"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks; each chunk's polynomial hash is computed on its own and
shifted by the chunk's offset, so that H(A + B) = H(A) + base**len(A) * H(B). The
sum of the shifted parts is the fingerprint: chunks of one huge document can be
hashed by different tasks. Texts of equal fingerprint are then compared chunk by
chunk with the representative of their group, in a stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import filter_words, maybe_in, spread, table, written

#: Moduli (primes below 2**31) and bases of the two polynomials.
PRIMES = (2147483647, 2147483629)
BASES = (1103515269, 838172513)
CHUNK = 1 << 20
#: Documents above this many bytes have their chunks dealt to several tasks.
HUGE = 32 << 20
#: Members of a group that are compared with one copy of its representative.
SLOT = 256
#: Bytes of chunks that are hashed at once; the arithmetic takes some 24 times as much memory.
PIECES = 4 << 20


def _powers(k: int, n: int) -> np.ndarray:
    """BASES[k]**i modulo PRIMES[k] for i < n, by doubling."""
    out, have = np.ones(1, np.int64), 1
    while have < n:
        out = np.concatenate([out, out * pow(BASES[k], have, PRIMES[k]) % PRIMES[k]])
        have *= 2
    return out[:n]


def chunk_hashes(data: np.ndarray, offs: np.ndarray, at: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the chunks, each shifted by its offset ``at`` in its document."""
    sizes = np.diff(offs)
    out = []
    for k, p in enumerate(PRIMES):
        h = np.zeros(len(sizes), np.int64)
        if data.size:
            place = np.arange(data.size) - np.repeat(offs[:-1], sizes)
            product = (data.astype(np.int64) + 1) * tables[k][place]
            full = np.flatnonzero(sizes)
            h[full] = np.add.reduceat(product, offs[:-1][full]) % p
        for i in np.flatnonzero(at):
            h[i] = int(h[i]) * pow(BASES[k], int(at[i]), p) % p
        out.append(h)
    return out


def _hash_chunks(it):
    tables = [_powers(0, CHUNK), _powers(1, CHUNK)]
    for batch in it:
        for b in tk.pieces(batch, "piece", PIECES):
            col = b.column("piece").cast(pa.large_binary()).fill_null(b"")
            offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            raw = col.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
            at = np.asarray(b.column("chunk"), dtype=np.int64) * CHUNK
            f1, f2 = chunk_hashes(data, offs - offs[0], at, tables)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("sha"), b.column("n"), b.column("chunk"), pa.array(f1), pa.array(f2)],
                ["doc_id", "sha", "n", "chunk", "f1", "f2"],
            )


def _chunks(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., chunk, piece): the text's bytes in chunks; an empty text has one empty chunk."""
    last = F.greatest(F.floor((F.col("n") - 1) / CHUNK), F.lit(0)).cast("int")
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last))).select(
        *keep, "chunk", F.expr(f"substring(bytes, chunk * {CHUNK} + 1, {CHUNK})").alias("piece")
    )


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), raw.cast("binary").alias("bytes"), F.octet_length(raw).cast("long").alias("n")
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sha, n, f1, f2) for each document; a document's chunks may have been hashed by several tasks."""
    rows = _rows(docs, doc_id, text).withColumn("sha", F.sha2("bytes", 256))
    schema = "doc_id long, sha string, n long, chunk int, f1 long, f2 long"
    usual = _chunks(rows.where(F.col("n") <= HUGE), "doc_id", "sha", "n")
    huge = _chunks(rows.where(F.col("n") > HUGE), "doc_id", "sha", "n").repartition("doc_id", "chunk")
    parts = usual.mapInArrow(_hash_chunks, schema).unionByName(huge.mapInArrow(_hash_chunks, schema))
    key = ["doc_id", "sha", "n"]
    return (
        parts.repartition(*key)
        .groupBy(*key, "chunk")
        .agg(F.max("f1").alias("f1"), F.max("f2").alias("f2"))
        .groupBy(*key)
        .agg((F.sum("f1") % PRIMES[0]).alias("f1"), (F.sum("f2") % PRIMES[1]).alias("f2"))
    )


def _with_groups(rows: DataFrame, key: list[str], how: str) -> DataFrame:
    """Add (size, rep) of the row's group of two or more: counted before the shuffle and joined back; the plan splits the join's partition of a large group."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("size"), F.max("doc_id").alias("rep")).where("size > 1")
    return rows.join(groups, key, how)


def compare(docs: DataFrame, members: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of ``members`` (doc_id, sha, rep, size) those whose text differs from that of their group's representative.

    Only texts that stand in a group are moved. A group's members are dealt into slots of about
    SLOT, each with a copy of the representative; in a slot the chunks of one number follow the
    representative's in a stream, so neither a group nor a document is ever held whole.
    """
    slots = F.greatest(F.ceil(F.col("size") / SLOT), F.lit(1)).cast("int")
    need = members.withColumn("slots", slots).withColumn(
        "slot",
        F.when(F.col("doc_id") == F.col("rep"), F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(
            F.array(spread(F.col("doc_id"), F.col("slots")))
        ),
    )
    texts = maybe_in(_rows(docs, doc_id, text), "doc_id", filter_words(members, "doc_id"))
    held = texts.withColumn("sha", F.sha2("bytes", 256)).join(need.select("doc_id", "sha", "rep", "f1", "f2", "slot"), ["doc_id", "sha"])
    rows = _chunks(held.withColumn("slot", F.explode("slot")), "doc_id", "sha", "rep", "f1", "f2", "n", "slot")
    w = Window.partitionBy("rep", "f1", "f2", "n", "slot", "chunk").orderBy((F.col("doc_id") != F.col("rep")).cast("int"), "doc_id")
    seen = rows.withColumn("same", F.col("piece") == F.first("piece").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where(~F.col("same")).select("doc_id", "sha").distinct()


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; null counts as empty. Of equal texts the row with
    the largest doc_id stays. Rows that repeat both doc_id and text are one document; a doc_id with
    several texts has a row for each. Rows without a doc_id are no documents. Very long texts are hashed and
    compared by chunks of CHUNK bytes. An empty table gives an empty result. Other columns are ignored.
    """
    prints = written(fingerprints(docs, doc_id, text), "prints")
    key = ["f1", "f2", "n"]
    members = written(_with_groups(prints, key, "inner"), "members")
    odd = written(compare(docs, members, doc_id, text).withColumn("apart", F.col("sha")), "odd")
    classes = prints.join(odd, ["doc_id", "sha"], "left").withColumn("apart", F.coalesce("apart", F.lit("")))
    out = _with_groups(classes, [*key, "apart"], "left")
    keep = F.coalesce("rep", "doc_id")
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc_id") == keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
