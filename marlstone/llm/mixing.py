"""Mixing sources to target weights by entropy balancing.

Each word of the corpus has base weight one. Among all weightings that meet the token
constraints (one per source: its words must add up to its target) the one of least
relative entropy tilts exponentially: a document's rate is exp(lambda of its source).
Newton's method on the convex dual finds the multipliers; the state is a table with a
row per source, so no number of sources has to fit on the driver. Rates become copies
by error feedback from the longest document to the shortest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import release, spread, table, written

# Fixed values of the mix: weights in turn, share of all words, most repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents whose copies are decided together.
SHARE_ROWS = 2_000
TOLERANCE = 1e-9
#: Sources up to which the table of them is sent to all tasks.
FEW_SOURCES = 10_000


def _count_words(it):
    for batch in it:
        for b in tk.pieces(batch, "text"):
            data, offs = tk.buffers(b.column("text"))
            first = tk.words(data, offs)[2]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("text_hash"), pa.array(np.diff(first))], ["doc_id", "source", "text_hash", "size"])


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, text_hash, size): words of each whole text."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")
    )
    return rows.mapInArrow(_count_words, "doc_id long, source string, text_hash long, size long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target): sources by code point, null last, take the weights in turn.

    A target is min(most * size, weight * t): filling by weight, stopping at the cap and resharing
    the excess by weight ends at that t. It is found from the caps in order of cap / weight.
    """
    by_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source in that order whose cap is not reached at its level fixes t for it and all after it.
    rows = rows.withColumn("t", F.when(level <= F.col("ratio"), level))
    t = F.first("t", ignorenulls=True).over(everything)
    return rows.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * t), F.col("cap"))).select("source", "n", "source_size", "target")


def balance(cells: DataFrame, tolerance: float = TOLERANCE, most_steps: int = 50) -> DataFrame:
    """Add ``rate`` to (source, source_size, target, ...) by Newton steps on the dual sum(size * exp(l)) - l * target.

    Gradient and curvature of a source are both size * exp(l), so a step is target / (size * exp(l)) - 1;
    steps are kept within one, which makes them converge from any start. A source without words keeps rate 1;
    a target of nothing gives rate 0. As each constraint is on one source, the dual falls apart into one
    function a source, and one step moves all of them. Raises ArithmeticError if they do not all converge.
    """
    at = F.col("source_size") * F.exp("l")
    rows = cells.withColumn("l", F.lit(0.0))
    step = F.greatest(F.least(F.col("target") / at - 1, F.lit(1.0)), F.lit(-1.0))
    fixed = (F.col("source_size") <= 0) | (F.col("target") <= 0)
    for _ in range(most_steps):
        rows, old = written(rows.withColumn("l", F.when(fixed, F.col("l")).otherwise(F.col("l") + step)), "dual"), rows
        if old is not cells and hasattr(old, "_written_to"):
            release(old)
        worst = rows.where(~fixed).agg(F.max(F.abs(at / F.col("target") - 1))).first()[0]
        if worst is None or worst < tolerance:
            break
    else:
        raise ArithmeticError(f"the dual is off by {worst} after {most_steps} steps")
    return rows.withColumn("rate", F.when(F.col("source_size") <= 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(F.exp("l"))).drop("l")


def copies(sizes_down: np.ndarray, rate: float, most: int = int(MOST)) -> np.ndarray:
    """Copies of documents sorted from long to short: each takes the number that brings the running total nearest to rate times the words so far."""
    out = np.zeros(len(sizes_down), np.int64)
    owed = 0.0
    for i, s in enumerate(sizes_down.tolist()):
        owed += rate * s
        c = min(most, max(0, int(np.floor(owed / s + 0.5)))) if s else 0
        out[i] = c
        owed -= c * s
    return out


TAKEN = "doc_id long, source string, text_hash long, size long, source_size long, target double, copies long, taken long"


def _round(rows):
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    rows["copies"] = copies(rows["size"].to_numpy(np.int64), float(rows["rate"].iloc[0]))
    rows["taken"] = rows["copies"] * rows["size"]
    return rows[[c.split()[0] for c in TAKEN.split(", ")]]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies, taken), a row per row of ``docs``; text_hash is xxhash64 of the text.

    A source's documents are dealt into shares of about SHARE_ROWS by a hash of doc_id, and each
    share is rounded on its own, so a source of any size is never in one task; a share's error is
    half its shortest document. Null text has size 0, null is a source of its own, last in order.
    Rows that repeat a document count as often as they come. Rows without a doc_id are no documents.
    Documents of one size are taken in order of doc_id. Very long texts count whole. An empty table gives an
    empty result. No randomness: reruns agree. Other columns are ignored.
    """
    sized = written(sizes(docs, doc_id, text, source), "sizes")
    cells = balance(targets(sized, weights, share)).withColumn("shares", F.ceil(F.col("n") / SHARE_ROWS).cast("int")).drop("n")
    if cells.count() <= FEW_SOURCES:  # some 100 bytes each; with more sources Spark joins by source and splits hot ones
        cells = F.broadcast(cells)
    joined = sized.alias("a").join(cells.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    joined = joined.select("a.*", "b.source_size", "b.target", "b.rate", spread(F.col("a.doc_id"), F.col("b.shares")).alias("share"))
    return joined.groupBy("source", "share").applyInPandas(_round, TAKEN)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE: dict[str, str] = {}
