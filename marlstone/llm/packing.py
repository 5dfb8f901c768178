"""Packing documents into sequences: best fit, then swap-based local search.

Pieces are dealt evenly into shares of bounded size. A share is packed by best fit
decreasing; then documents of the emptiest bin move, or are exchanged one for one or
one for two with documents of other underfull bins, whenever the sum of squared fills
grows, until the bin is empty. Underfull bins of all shares are packed together again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import spread, table, written
from .tokens import END_ID, VOCABULARY, encode_with_end

LENGTH = 4096
#: Pieces of a share.
SHARE = 20_000
#: Bins filled less than this take part in the next round.
OPEN = 0.98


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece by best fit decreasing; bins of one free space are kept together, and a bit mask finds the tightest."""
    bins = np.empty(len(sizes), np.int64)
    by_free: dict[int, list[int]] = {}
    mask = n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, b = capacity, n
            n += 1
        bins[i] = b
        free -= s
        if free:
            by_free.setdefault(free, []).append(b)
            mask |= 1 << free
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills.

    The emptiest bin gives. A document d of it goes to another underfull bin b if it fits, or
    in exchange for one document y < d or two documents y1 + y2 < d of b. Either way b ends
    fuller than before by what the giver loses; as b is at least as full as the giver, the sum
    of squares grows, so this ends. A bin that cannot be emptied is put aside, and the search goes on
    until each underfull bin has given once, or until there are no more bins than the sum of all sizes
    needs, when none can be emptied.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    active = np.flatnonzero(np.isin(bins, np.flatnonzero((fill > 0) & (fill < capacity)))).astype(np.int64)
    aside: set[int] = set()
    least, used = -(-int(sizes.sum()) // capacity), int((fill > 0).sum())
    while used > least:
        live = np.unique(bins[active])
        givers = [b for b in live.tolist() if b not in aside and fill[b] < capacity]
        if len(live) < 2 or not givers:
            break
        giver = min(givers, key=lambda b: fill[b])
        moved = True
        while moved and fill[giver]:
            moved = False
            mine = active[bins[active] == giver]
            others = active[(bins[active] != giver) & (fill[bins[active]] < capacity) & (fill[bins[active]] >= fill[giver])]
            if not len(others):
                break
            ob, os = bins[others], sizes[others]
            room = capacity - fill[ob]
            for d in mine[np.argsort(-sizes[mine], kind="stable")].tolist():
                size = int(sizes[d])
                if (room >= size).any():
                    k = int(np.argmin(np.where(room >= size, room, capacity + 1)))
                    out: list[int] = []
                else:
                    fits = (os < size) & (os + room >= size)
                    if fits.any():
                        k = int(np.argmin(np.where(fits, os, capacity + 1)))
                        out = [int(others[k])]
                    else:
                        k, out = _two_for_one(size, others, ob, os, room)
                        if k < 0:
                            continue
                to = int(ob[k])
                gain = size - int(sizes[out].sum())
                if (fill[to] + gain) ** 2 + (fill[giver] - gain) ** 2 <= fill[to] ** 2 + fill[giver] ** 2:
                    continue
                bins[d], bins[out] = to, giver
                fill[to] += gain
                fill[giver] -= gain
                moved = True
                break
        if fill[giver]:
            aside.add(giver)
        else:
            used -= 1
    return bins


def _two_for_one(size: int, others: np.ndarray, ob: np.ndarray, os: np.ndarray, room: np.ndarray) -> tuple[int, list[int]]:
    """Two documents of one bin that together are less than ``size`` and leave room for it: the smallest such sum."""
    order = np.lexsort((os, ob))
    best, found = size, (-1, [])
    starts = np.flatnonzero(np.r_[True, ob[order][1:] != ob[order][:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(order)]):
        s = os[order[lo:hi]]
        need = size - int(room[order[lo]])
        if hi - lo < 2 or int(s[0] + s[1]) >= best:
            continue
        partner = np.searchsorted(s, need - s)
        partner = np.maximum(partner, np.arange(len(s)) + 1)
        ok = partner < len(s)
        total = np.where(ok, s + s[np.minimum(partner, len(s) - 1)], size)
        j = int(np.argmin(total))
        if total[j] < best:
            best = int(total[j])
            found = (int(order[lo]), [int(others[order[lo + j]]), int(others[order[lo + int(partner[j])]])])
    return found


def pack(sizes: np.ndarray, capacity: int = LENGTH) -> np.ndarray:
    """Bin numbers from 0 without gaps."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.unique(local_search(sizes, best_fit(sizes, capacity), capacity), return_inverse=True)[1]


def _cut(length: int, vocabulary: str, end_id: int):
    def run(it):
        for batch in it:
            for b in tk.pieces(batch, "text"):
                data, offs = tk.buffers(b.column("text"))
                ids, first = encode_with_end(data, offs, vocabulary, end_id)
                doc = np.asarray(b.column("doc_id"))
                size = np.diff(first)
                count = -(-size // length)
                row = np.repeat(np.arange(len(doc)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * length
                n = np.minimum(length, size[row] - start)
                raw = memoryview(ids.view(np.uint8))
                at = ((first[row] + start) * 4).tolist()
                crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at, n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, fill long"


def _pack_share(level: int, capacity: int):
    def run(key, rows):
        rows = rows.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy(np.int64)
        bins = pack(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        rows["sequence_id"] = (level << 56) + (int(key[0]) << 24) + bins
        rows["offset"], rows["fill"] = offset, fill[bins]
        return rows[[c.split()[0] for c in PACKED.split(", ")]]

    return run


def pack_pieces(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), none longer than ``capacity``.

    Bins below OPEN of the capacity meet those of other shares in a further round, until all fit in one share or
    a round leaves nine tenths of the pieces in such bins, as when no two pieces fit together.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    whole = pieces.where(F.col("length") == capacity)
    # A full piece is a sequence of its own; negative numbers are used nowhere else.
    done = [whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    rest, level, left = pieces.where(F.col("length") < capacity), 0, None
    while True:
        n_rows = rest.count()
        shares = max(1, -(-n_rows // SHARE))
        packed = rest.withColumn("share", spread(F.struct("doc_id", "piece", "start"), shares)).groupBy("share").applyInPandas(_pack_share(level, capacity), PACKED)
        packed = written(packed, "packed")
        last = shares == 1 or (left is not None and n_rows > 0.9 * left)
        full = F.lit(True) if last else F.col("fill") >= int(OPEN * capacity)
        done.append(packed.where(full).drop("fill"))
        if last:
            break
        rest, level, left = packed.where(~full).select(*names), level + 1, n_rows
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encode documents and pack them; one row per piece.

    Null text counts as empty: the end id alone. Documents longer than ``capacity`` are cut, the last
    piece may be shorter. Of pieces of one length the smaller doc_id is placed first. Rows that repeat a document are packed as often as they come. Rows without
    a doc_id are no documents. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pack_pieces(written(rows.mapInArrow(_cut(capacity, vocabulary, end_id), PIECES), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
