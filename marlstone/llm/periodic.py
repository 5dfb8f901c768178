"""All runs of repeated word patterns in texts, and the texts without the repetitions.

A run is a stretch of words with smallest period q, at least ``exponent`` times as long, that neither
neighbour extends. The words of a batch of texts are numbered; prefix doubling gives the suffix array,
and its levels (equal numbers where the next 2**k words are equal) answer how far two places agree to
the right or left. Neighbours in the suffix array give each place its longest previous factor, and these
the Lempel-Ziv blocks. A run that touches a border of blocks is found there by extension to both sides,
for periods that the adjoining block bounds; a run inside a block is copied from the block's earlier
occurrence, whose runs are kept in order of their starts.

Places of several texts never agree, since a text's words have numbers of their own. Words are told apart
by 64-bit hashes: two words of one text are mixed up with probability 2**-64.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import table

EXPONENT, LEAST = 4, 6
#: Rounds of pointer jumps over all places; what needs more is finished place by place.
ROUNDS = 64


class Suffixes:
    """Suffix array of several sequences: ``order`` (places by suffix) and ``levels``.

    key: a hash for each word; seq: the number of its sequence, ascending.
    """

    def __init__(self, key: np.ndarray, seq: np.ndarray):
        n = len(key)
        key = tk.mix(key ^ tk.mix(seq.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        if n and ((key[order][1:] == key[order][:-1]) & (seq[order][1:] != seq[order][:-1])).any():
            order = np.lexsort((key, seq))  # words of two sequences share a number
        k, d = key[order], seq[order]
        new = np.ones(n, bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        #: apart[r]: the level at which the suffixes r - 1 and r differ first.
        self.order, self.apart = order.astype(np.int32), np.zeros(n, np.int8)
        self.end = np.append(np.searchsorted(seq, seq, "right"), n).astype(np.int32) if n else np.zeros(1, np.int32)
        self.start = np.searchsorted(seq, seq, "left").astype(np.int32)
        rank = np.full(n + 1, -1, np.int32)  # the place after the last agrees with none
        rank[self.order] = self._numbers(new, np.arange(n, dtype=np.int32))
        self.levels = [rank]
        slots = self._together(new, np.arange(n, dtype=np.int32))
        step = 1
        while len(slots):
            places = self.order[slots]
            after = places + np.int32(step)
            second = np.where(after < self.end[places], rank[np.minimum(after, n)], -1)
            pair = (rank[places].astype(np.int64) << 32) | (second.astype(np.int64) + 1)
            by = np.argsort(pair)
            places, pair = places[by], pair[by]
            self.order[slots] = places
            new = np.ones(len(slots), bool)
            new[1:] = pair[1:] != pair[:-1]
            inner = np.flatnonzero(new[1:] & (pair[1:] >> 32 == pair[:-1] >> 32)) + 1
            self.apart[slots[inner]] = len(self.levels)
            rank = rank.copy()
            rank[places] = self._numbers(new, slots)
            self.levels.append(rank)
            slots = self._together(new, slots)
            step *= 2

    @staticmethod
    def _numbers(new: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """For each slot the first slot of its group."""
        return slots[np.flatnonzero(new)][np.cumsum(new) - 1]

    @staticmethod
    def _together(new: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Slots of groups of two and more."""
        alone = new.copy()
        alone[:-1] &= new[1:]
        return slots[~alone]

    def forward(self, i: np.ndarray, j: np.ndarray, below: int | None = None) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ. ``below``: they differ within 2**below words."""
        far = np.zeros(len(i), np.int64)
        for k in range((len(self.levels) if below is None else below) - 1, -1, -1):
            far += (self.levels[k][i + far] == self.levels[k][j + far]).astype(np.int64) << k
        return far

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j; i < j in one sequence."""
        far = np.zeros(len(i), np.int64)
        first = self.start[j - 1]
        for k in range(len(self.levels) - 1, -1, -1):
            at = i - far - (1 << k)
            same = (at >= first) & (self.levels[k][np.maximum(at, 0)] == self.levels[k][np.maximum(j - far - (1 << k), 0)])
            far += same.astype(np.int64) << k
        return far

    def neighbours(self) -> np.ndarray:
        """lcp[r]: the common words of the suffixes r - 1 and r."""
        lcp = np.zeros(len(self.order), np.int32)
        for k in range(1, len(self.levels)):
            r = np.flatnonzero(self.apart == k)
            if len(r):
                done = 1 << (k - 1)
                lcp[r] = done + self.forward(self.order[r - 1].astype(np.int64) + done, self.order[r].astype(np.int64) + done, k - 1)
        return lcp


def _smaller_before(at: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slot the nearest slot before it with a smaller place, and the common words of both; (any, 0) where they have none."""
    left = np.arange(-1, len(at) - 1, dtype=np.int32)
    common = lcp.copy()
    todo = np.flatnonzero(common > 0)
    todo = todo[at[todo - 1] > at[todo]]
    rounds = 0
    while len(todo) and rounds < ROUNDS:
        # All slots between a slot and its pointer have greater places, so a pointer's pointer can be taken over.
        via = left[todo]
        common[todo], left[todo] = (m := np.minimum(common[todo], common[via])), (to := left[via])
        todo = todo[(m > 0) & (at[to] > at[todo])]
        rounds += 1
    for r in todo.tolist():  # in order, so that each slot is passed once
        to, m, mine = int(left[r]), int(common[r]), int(at[r])
        while m > 0 and at[to] > mine:
            m, to = min(m, int(common[to])), int(left[to])
        left[r], common[r] = to, m
    return left, common


def longest_previous(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """LPF: for each place the length of the longest factor that begins there and also earlier, and where earlier."""
    n = len(s.order)
    lcp = s.neighbours()
    left, a = _smaller_before(s.order, lcp)
    back = np.zeros(n, np.int32)
    back[1:] = lcp[1:][::-1]
    right, b = _smaller_before(s.order[::-1], back)
    right, b = n - 1 - right[::-1], b[::-1]
    lpf, source = np.zeros(n, np.int32), np.zeros(n, np.int32)
    lpf[s.order] = np.maximum(a, b)
    source[s.order] = s.order[np.where(a >= b, np.maximum(left, 0), np.minimum(right, n - 1))]
    return lpf, source


def blocks(lpf: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest previous factor, or one new word."""
    after = (np.arange(len(lpf)) + np.maximum(lpf, 1)).tolist()
    out, i, n = [], 0, len(lpf)
    put = out.append
    while i < n:
        put(i)
        i = after[i]
    return np.array(out, np.int64)


def _ranges(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and number 1..most[index] for each index."""
    index = np.repeat(np.arange(len(most)), most)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(most) - most, most) + 1


def _touching(s: Suffixes, begin: np.ndarray, size: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of stretches that touch a border of blocks, extended to both sides.

    A run with e times its period q has half of that on one side of a border. To the right, inside the block that
    holds its last word, so q is at most 2/e of that block. To the left, where the block before the border begins
    in the run's first q words (else it would reach the run's end), so (e/2 - 1) * q is less than that block.
    """
    words = s.levels[0]
    k, q = _ranges(2 * size // exponent)
    b = begin[k]
    hit = words[b] == words[b + q] if exponent > 2 else slice(None)
    b, q = b[hit], q[hit]
    right = s.forward(b, b + q)
    keep = 2 * (right + q) >= exponent * q
    b, q, right = b[keep], q[keep], right[keep]
    found = [(b - s.backward(b, b + q), b + q + right, q)]
    end = begin + size
    if exponent > 2:
        most = (2 * size - 1) // (exponent - 2)
    else:  # a run reaches at most two blocks' and the next one's length to the left
        most = 2 * size + np.where(end < len(words) - 1, np.append(size[1:], 0), 0)
    k, q = _ranges(np.minimum(most, end - s.start[begin] - 1))
    b = end[k]
    hit = words[b - 1] == words[b - 1 - q] if exponent > 2 else slice(None)
    b, q = b[hit], q[hit]
    left = s.backward(b - q, b)
    keep = 2 * (left + q) >= exponent * q
    b, q, left = b[keep], q[keep], left[keep]
    found.append((b - q - left, b + s.forward(b - q, b), q))
    return tuple(np.concatenate(x) for x in zip(*found))


def find_runs(key: np.ndarray, seq: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least ``least`` words and ``exponent`` (an integer from 2) periods, by start, then period.

    key: a hash of each word; seq: the number of its text, ascending. Starts and ends count over all texts.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    if not len(key):
        return np.zeros((0, 3), np.int64)
    s = Suffixes(key, seq)
    lpf, source = longest_previous(s)
    begin = blocks(lpf)
    size = np.diff(np.append(begin, len(key)))
    a, b, q = _touching(s, begin, size, exponent)
    keep = b - a >= np.maximum(least, exponent * q)
    order = np.lexsort((q[keep], b[keep], a[keep]))
    found = np.stack([a[keep][order], b[keep][order], q[keep][order]], 1)
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)  # multiples of the smallest period give the same stretch
    found = found[first]
    if not len(found):
        return found
    return _copied(found, begin, size, source, seq, exponent, least)


def _copied(found: np.ndarray, begin: np.ndarray, size: np.ndarray, source: np.ndarray, seq: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """With the runs that lie inside a block: those of its earlier occurrence, moved."""
    having = np.unique(seq[found[:, 0]])
    inside = np.flatnonzero((size >= max(least, exponent) + 2) & np.isin(seq[begin], having))
    runs = list(map(tuple, found.tolist()))
    for b, n, p in zip(begin[inside].tolist(), size[inside].tolist(), source[begin[inside]].tolist()):
        at = bisect.bisect_left(runs, (p + 1,))
        while at < len(runs) and runs[at][0] < p + n:  # may meet runs that this block has got
            a, e, q = runs[at]
            at += 1
            if e < p + n:
                bisect.insort(runs, (a + b - p, e + b - p, q))
    out = np.array(runs, np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts whose words, ``per`` of them each, are joined by one space."""
    last = np.zeros(len(s), bool)
    last[np.cumsum(per)[per > 0] - 1] = True
    size = e - s + ~last
    at = np.cumsum(size) - size
    total = int(size.sum())
    out = data[np.minimum(np.arange(total) + np.repeat(s - at, size), len(data) - 1)] if total else np.zeros(0, np.uint8)
    out[(at + size - 1)[~last]] = 0x20
    return out, np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(per)), per), weights=size, minlength=len(per)))).astype(np.int64)


def _column(starts: np.ndarray, length: np.ndarray, period: np.ndarray, per: np.ndarray) -> pa.Array:
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, length, period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), rows)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST, arrange=None) -> DataFrame:
    """(key, runs, collapsed): the runs of each whole text, by start, then period, and its words without those that repeat a period.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; of a run the first period stays. A null, empty or blank text has no
    run and an empty ``collapsed``. Every row counts by itself, repeated rows and rows without a key too; other columns are left
    out. ``arrange(keys, counts)`` may give another order of words: for each batch the number of the word that stands at each place.
    A task holds about 8 MB of texts or one longer text at a time, with some 150 bytes a word, and 4 more for each doubling that the text's repetitions need.
    """

    def run(batches):
        for batch in batches:
            for piece in tk.pieces(batch, "_text"):
                data, offs = tk.buffers(piece.column("_text"))
                s, e, first = tk.words(data, offs)
                per = np.diff(first)
                seq = np.repeat(np.arange(len(per)), per)
                hashes = tk.span_hashes(data, s, e, tk.BYTE)
                if arrange is not None:
                    place = arrange(piece.column(key), per)
                    s, e, hashes = s[place], e[place], hashes[place]
                runs = find_runs(hashes, seq, exponent, least)
                gone = np.zeros(len(s) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 1], -1)
                keep = np.cumsum(gone[:-1]) == 0
                of = seq[runs[:, 0]]
                joined, bounds = _joined(data, s[keep], e[keep], np.bincount(seq[keep], minlength=len(per)))
                found = _column(runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2], np.bincount(of, minlength=len(per)))
                texts = pa.StringArray.from_buffers(len(per), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined))
                yield pa.RecordBatch.from_arrays([piece.column(key), found, texts], names=[key, "runs", "collapsed"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = rows.select(key, F.lit(None).cast(RUNS).alias("runs"), F.lit(None).cast("string").alias("collapsed")).schema
    return rows.mapInArrow(run, schema)


def rearranged(ids: pa.Array, per: np.ndarray) -> np.ndarray:
    """The words of the query: where crc32 of the decimal id ends in 0, the words from place a on repeat p of them. Texts without an id stay as they are."""
    place = np.arange(int(per.sum()))
    at = 0
    for doc, n in zip(ids.to_pylist(), per.tolist()):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place[at + a : at + n] = at + a + np.arange(n - a) % p
        at += n
    return place


def longest(runs: Column) -> Column:
    """(length, start, period) of the longest run; ties go to the smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("q"))))
    return F.struct(best["length"].alias("length"), (-best["before"]).alias("start"), (-best["q"]).alias("period"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse(table(spark, sf_dir, "documents"), arrange=rearranged)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = found.withColumn("top", longest(F.col("runs")))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(F.expr("1000 * top.length div top.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Suffix arrays are beyond SQL; tests hold the query against runs found by comparing all periods.
ORACLE: dict[str, str] = {}
