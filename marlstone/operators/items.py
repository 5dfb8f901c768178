"""Open items (TBD, TBR, TBC, TBS): scan, statistics, filters, correlation, lifecycle.

Blocks are rows (doc, page, ord, block_id, text); order is (page, ord) within doc.
"""

from __future__ import annotations

import math
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FULL = r"(?U)\b(?:TBD|TBR|TBC|TBS)-\w+-\d+\b"
BARE = r"(?U)\b(?:TBD|TBR|TBC|TBS)\b"
# Words of a definition, which is no open item.
DEFINITION = ("means that", "to be determined", "to be resolved")


def _context(start, end, around: int) -> Column:
    return T.context("text", start, end, around)


def scan(blocks: DataFrame, around: int = 40) -> DataFrame:
    """(doc, item_id, item_type, owner, page, block_id, context, in_shall).

    A full id counts once per document, where it stands first. Bare tokens are numbered through the
    document; one within reach of a full id (5 characters before to 10 after) is not counted, and a
    definition takes a number but is no item.
    """
    held = blocks.where(F.col("text").rlike(BARE))
    keep = ["doc", "page", "ord", "block_id", "text"]
    full = held.select(*keep, F.posexplode(T.spans("text", FULL)).alias("n", "s")).withColumn("item_id", F.col("s.match"))
    first = Window.partitionBy("doc", "item_id").orderBy("page", "ord", "n")
    full = full.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    full = full.withColumn("owner", F.regexp_extract("item_id", r"^\w+-(.*)-\d+$", 1)).withColumn("item_type", F.substring("item_id", 1, 3))

    bare = held.select(*keep, F.posexplode(T.spans("text", BARE)).alias("n", "s"))
    lo = F.greatest(F.col("s.start") - 5, F.lit(0))
    bare = bare.where(~F.substring("text", lo + 1, F.col("s.end") + 10 - lo).rlike(FULL))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord", "n"))
    bare = bare.withColumn("item_id", F.format_string("%s-%03d", F.col("s.match"), number)).withColumn("item_type", F.col("s.match")).withColumn("owner", F.lit(None).cast("string"))

    cols = ["doc", "item_id", "item_type", "owner", "page", "block_id"]
    out = [d.select(*cols, _context(F.col("s.start"), F.col("s.end"), around).alias("context")) for d in (full, bare)]
    defined = F.lit(False)
    for words in DEFINITION:
        defined = defined | F.contains(F.lower("context"), F.lit(words))
    return out[0].unionByName(out[1].where(~defined)).withColumn("in_shall", F.contains(F.lower("context"), F.lit("shall")))


def stats(items: DataFrame) -> DataFrame:
    """One row of counts; all zero for no items."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return items.agg(
        F.count("*").alias("total_items"), n("status", "open").alias("open_count"), n("status", "assigned").alias("assigned_count"), n("status", "resolved").alias("resolved_count"),
        n("status", "verified").alias("verified_count"), n("item_type", "TBD").alias("tbd_count"), n("item_type", "TBR").alias("tbr_count"), F.count_if("in_shall").alias("in_shall_statements"), F.count_distinct("doc").alias("documents_count"),
    )


def filter_items(items: DataFrame, status: str | None = None, item_type: str | None = None, title: str | None = None, owner: str | None = None, in_shall: bool | None = None) -> DataFrame:
    """Filters that are given must all hold; title and owner are found inside regardless of case."""
    if status is not None:
        items = items.where(F.col("status") == status)
    if item_type is not None:
        items = items.where(F.col("item_type") == item_type.upper())
    for name, value in (("title", title), ("owner", owner)):
        if value is not None:
            items = items.where(F.contains(F.lower(name), F.lit(value.lower())))
    return items if in_shall is None else items.where(F.col("in_shall") == in_shall)


#: Most pivots, items for which there is one, most items that stand in one task, and how many times as many may ask there.
PIVOTS, EACH, BLOCK, ASKING = 256, 512, 32_768, 2
#: Pairs that a task looks at, and may give out, at once.
PAIRS = 2_000_000


def _vectors(column) -> np.ndarray:
    """The rows of an Arrow column of lists as unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(centres: np.ndarray, counts: list[int], block: int) -> tuple[list[int], list[int]]:
    """The first block of each cell and its number of blocks: a large cell is cut, small ones that lie near one another share a block."""
    first, parts, left, used = [0] * len(counts), [1] * len(counts), set(range(len(counts))), 0
    at, room = 0, 0
    while left:
        at = max(left, key=lambda k: (centres[at] @ centres[k], -k))
        left.discard(at)
        if counts[at] > block:
            first[at], parts[at], room = used, -(-counts[at] // block), 0
            used += parts[at]
        else:
            if counts[at] > room:
                used, room = used + 1, block
            first[at] = used - 1
            room -= counts[at]
    return first, parts


def correlate(items: DataFrame, least: float = 0.75, high: float = 0.85, block: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """Pairs of items (item_id, doc, embedding, resolution) of different documents with cosine similarity above ``least``.

    Exact, and pairs that cannot be similar never meet: angles obey the triangle inequality, so an item visits the cell of a pivot only if its angle to the pivot,
    less the cell's radius, is within the angle of ``least``. Pivots are items of the smallest hashes, at most ``pivots``; each item stands in the cell of its nearest
    one. Near cells share a block of at most ``block`` items, a larger cell has several; without a number there are about four times the root of the task slots, of BLOCK items at
    most, since each item is sent to half of the blocks where nothing is too far apart. An item asks the later blocks with a cell that it visits. Those who ask are dealt into
    turns of ASKING times a block, and a task gives out its pairs as it finds them, so neither copies nor size add to its memory.
    Items without a vector or with one of zeros, and those without id or document, are similar to none; all vectors have one dimension. conflict: both are resolved, differently. ``least`` is not negative.
    """
    from ..sources.store import scratch

    if least < 0:
        raise ValueError("least must not be negative")
    spark, reach = items.sparkSession, float(np.arccos(min(1.0, least))) + 1e-6
    vector = F.col("embedding") if dict(items.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = items.select("item_id", "doc", vector.alias("embedding"), "resolution").where(F.exists("embedding", lambda x: x != 0) & F.col("item_id").isNotNull() & F.col("doc").isNotNull())
    total = rows.count()
    block = block or min(BLOCK, max(EACH, -(-total // math.ceil(4 * spark.sparkContext.defaultParallelism**0.5))))
    held = [r.embedding for r in rows.orderBy(F.xxhash64("item_id"), "item_id").limit(max(1, min(pivots, -(-total // min(EACH, block))))).select("embedding").collect()]
    centres = np.array(held, np.float64) if held else np.ones((1, 1))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def angles(batch):
        return np.arccos(np.clip(_vectors(batch.column("embedding")) @ centres.T, -1, 1))

    def placed(it):
        for batch in it:
            if len(batch):
                a = angles(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.argmin(1), pa.int32()), pa.array(a.min(1))], [*batch.schema.names, "cell", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    path = scratch(spark, "cells")
    rows.mapInArrow(placed, f"{kinds}, cell int, angle double").write.parquet(path)
    cells = spark.read.schema(f"{kinds}, cell int, angle double").parquet(path)
    known = {r.cell: (r.radius, r.n) for r in cells.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}  # a row a pivot
    radius = np.array([known.get(k, (-np.inf, 0))[0] for k in range(len(centres))])
    first, parts = _blocks(centres, [known.get(k, (0, 0))[1] for k in range(len(centres))], block)
    of = lambda numbers: F.element_at(F.array(*[F.lit(int(x)) for x in numbers]), F.col("cell") + 1)
    stand = cells.withColumn("block", (of(first) + F.pmod(F.xxhash64("item_id", F.lit(1)), of(parts))).cast("int")).drop("cell")

    def visits(it):
        for batch in it:
            if not len(batch):
                continue
            near, own = angles(batch) - radius <= reach, batch.column("block").to_numpy()
            asked: dict[int, np.ndarray] = {}
            for k in range(len(centres)):
                for b in range(first[k], first[k] + parts[k]):
                    asked[b] = asked[b] | near[:, k] if b in asked else near[:, k]
            rest = batch.drop_columns(["angle", "block"])
            for b, mask in asked.items():
                out = rest.filter(pa.array(mask & (own < b)))
                if len(out):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(out), b, np.int32))], [*out.schema.names, "block"])

    path = scratch(spark, "asks")
    stand.mapInArrow(visits, f"{kinds}, block int").write.parquet(path)
    asks = spark.read.schema(f"{kinds}, block int").parquet(path)
    turns = {r.block: -(-r.n // (ASKING * block)) for r in asks.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row a block
    n_turns = F.element_at(F.array(*[F.lit(max(1, turns.get(b, 1))) for b in range(max(x + y for x, y in zip(first, parts)))]), F.col("block") + 1)
    stand = stand.drop("angle").withColumn("asks", F.lit(False)).withColumn("turn", F.explode(F.sequence(F.lit(0), n_turns - 1)))
    asks = asks.withColumn("asks", F.lit(True)).withColumn("turn", F.pmod(F.xxhash64("item_id", F.lit(2)), n_turns).cast("int"))
    names = ["item_a", "item_b", "similarity", "conflict"]

    def pairs(group: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        guest = both.column("asks")
        both = pa.concat_tables([both.filter(pc.invert(guest)), both.filter(guest)]).combine_chunks()
        m = len(both) - pc.sum(guest).as_py()
        if not m:
            return
        x = _vectors(both.column("embedding"))
        code = lambda c: both.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        ids, doc, res = both.column("item_id").to_numpy(), code("doc"), code("resolution")
        solved = pc.fill_null(pc.not_equal(both.column("resolution"), ""), False).to_numpy()
        key, step = both.column("item_id").combine_chunks(), max(1, PAIRS // m)
        # Those that stand meet in the first turn, each pair once.
        for lo in range(0 if group[1].as_py() == 0 else m, len(both), step):
            s = x[lo:lo + step] @ x[:m].T
            i, j = np.nonzero(s > least)
            near, i = s[i, j], i + lo
            fits = (doc[i] != doc[j]) & (ids[i] != ids[j]) & ((i >= m) | (ids[i] < ids[j]))
            i, j, near = i[fits], j[fits], near[fits]
            if len(i):
                swap = ids[i] > ids[j]
                left, right = np.where(swap, j, i), np.where(swap, i, j)
                conflict = solved[left] & solved[right] & (res[left] != res[right])
                yield pa.RecordBatch.from_arrays([key.take(pa.array(left)), key.take(pa.array(right)), pa.array(near), pa.array(conflict)], names)

    kind = dict(items.dtypes)["item_id"]
    cols = [*rows.columns, "asks", "block", "turn"]
    found = stand.select(*cols).unionByName(asks.select(*cols)).groupBy("block", "turn").applyInArrow(pairs, f"item_a {kind}, item_b {kind}, similarity double, conflict boolean")
    return found.withColumn("confidence", F.when(F.col("similarity") > high, "high").otherwise("medium"))


def latest_status(updates: DataFrame) -> DataFrame:
    """State after all updates (item_id, seq, status, resolution): the last of each item, with the number of changes."""
    return updates.groupBy("item_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("resolution", "seq").alias("resolution"), F.count("*").alias("n_changes"))


def open_first(items: DataFrame, n: int = 10) -> DataFrame:
    """The first open items: those in shall statements before the others, by title."""
    return items.where(F.col("status") == "open").orderBy(F.desc("in_shall"), "title", "item_id").limit(n)
