"""Near duplicates: b-bit MinHash signatures joined under a Hamming threshold by multi-index.

A document's set of word shingles has SYMBOLS minimum hashes, each cut to BITS bits. The
signature is split into chunks of CHUNK symbols. By pigeonhole two signatures that differ in
at most NEAR = chunks * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS = 1 errors, so
each chunk is indexed once for every place that may be wrong, under its other symbols: all
pairs under the threshold NEAR meet in a bucket, and no pair above it is followed.

Pairs are never written. A task holds a bucket, or a block of a large one, and returns a spanning
forest of the pairs under the threshold: fewer links than it has documents. The connected
components of these links are clusters, which hold every candidate pair inside them. Full sets
then travel once, to their cluster, where pairs under the threshold are compared on the sets, and
again a spanning forest comes back; its components are the result.

Groups of more than BLOCK documents (or BLOCK_SHINGLES shingles) are cut into blocks. After the
blocks have been searched on their own, the documents nearest to a block's most frequent symbols
(which an original is to its copies) are compared with all blocks of the group. What is still
outside the group's largest component then meets every block, so that no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textkit as tk
from .common import filter_words, maybe_in, release, spread, table, written
from .components import components

SYMBOLS, BITS, CHUNK, ERRORS = 100, 16, 5, 1
#: Differing symbols up to which pairs are followed, all of them. A pair at similarity 0.8 has 20 on average, more than 39 with probability 4e-6.
NEAR = SYMBOLS // CHUNK * (ERRORS + 1) - 1
#: Documents and shingles of a block, and central documents of a large group that meet all its blocks.
BLOCK, BLOCK_SHINGLES, HUBS = 4096, 2_000_000, 4
_RNG = np.random.default_rng(41)
_A = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**64, (SYMBOLS // CHUNK, CHUNK), dtype=np.uint64)
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's begin (one more at the end)."""
    s, e, first = tk.words(data, offs)
    h = tk.span_hashes(data, s, e)
    count = np.diff(first)
    rolled = h.copy()
    for k in range(1, width):
        rolled[: len(h) - k] = rolled[: len(h) - k] * _NEXT + h[k:]
    rolled = tk.mix(rolled + np.uint64(width))
    out, sizes = [], np.zeros(len(count), np.int64)
    for i, n in enumerate(count.tolist()):
        if n:
            a = int(first[i])
            if n >= width:
                u = np.unique(rolled[a : a + n - width + 1])
            else:
                whole = h[a]
                for k in range(1, n):
                    whole = whole * _NEXT + h[a + k]
                u = tk.mix(np.array([whole + np.uint64(n)], np.uint64))
            out.append(u)
            sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """b-bit MinHash signatures, a row for each set; an empty set has zeros."""
    n = len(at) - 1
    out = np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(at))
    k = 0
    while k < len(full):  # about 64 Ki values at a time stay in the processor's cache
        lo = int(at[full[k]])
        to = max(k + 1, int(np.searchsorted(at[full + 1], lo + 65536, "right")))
        part = sets[lo : int(at[full[to - 1] + 1])]
        cut = at[full[k:to]] - lo
        for j in range(SYMBOLS):
            out[full[k:to], j] = tk.mix(np.minimum.reduceat(part * _A[j] + _B[j], cut)) & np.uint64(0xFFFF)
        k = to
    return out


def _fingerprints(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets, where they begin, their sizes and two 64-bit sums over each, which identify it."""
    sets, at = shingle_sets(data, offs, width)
    zero = np.zeros(1, np.uint64)
    sums = [np.concatenate([zero, np.cumsum(x, dtype=np.uint64)]) for x in (sets, tk.mix(sets ^ _NEXT))]
    h1, h2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
    return sets, at, np.diff(at), h1, h2


def _set_rows(with_sets: bool, width: int):
    def run(it):
        for batch in it:
            for b in tk.pieces(batch, "text"):
                sets, at, n, h1, h2 = _fingerprints(*tk.buffers(b.column("text")), width)
                if with_sets:
                    raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at * 8), pa.py_buffer(sets)])
                else:
                    sig = np.ascontiguousarray(signatures(sets, at).astype("<u2"))
                    raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.arange(len(n) + 1) * SYMBOLS * 2), pa.py_buffer(sig)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), raw.cast(pa.binary())], ["doc_id", "n", "h1", "h2", "raw"])

    return run


SETS = "doc_id long, n long, h1 long, h2 long, raw binary"


def with_fingerprint(docs: DataFrame, names: tuple[str, str, str], text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with the size and the two sums of each text's set, under the given names."""

    def run(it):
        for batch in it:
            for b in tk.pieces(batch, text):
                n, h1, h2 = _fingerprints(*tk.buffers(b.column(text)), width)[2:]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(h1), pa.array(h2)], [*b.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(name, LongType()) for name in names]]))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """A row of keys for each signature: every chunk under its symbols but one, which fill 64 bits, for every place that may be wrong."""
    s = sig.astype(np.uint64).reshape(len(sig), SYMBOLS // CHUNK, CHUNK)
    out = np.empty_like(s)
    for j in range(CHUNK):
        packed = np.zeros(s.shape[:2], np.uint64)
        for k in range(CHUNK):
            if k != j:
                packed = (packed << np.uint64(BITS)) | s[:, :, k]
        out[:, :, j] = tk.mix(packed ^ _PLACE[:, j])
    return out.reshape(len(sig), SYMBOLS)


def _key_rows(it):
    for batch in it:
        sig = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("sig")), "<u2").reshape(-1, SYMBOLS)
        keys = chunk_keys(sig)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("node")), SYMBOLS)), pa.array(keys.ravel().view(np.int64))], ["node", "key"])


def forest(count: int, fits: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) numbers of the components of a graph; ``fits(i, others)`` tells which others i is linked with.

    Each document is compared only with those that no component has yet, so a group that hangs together costs few comparisons.
    """
    left, roots, members = np.arange(count), [], []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = fits(queue.pop(), left)
            if near.any():
                got = left[near]
                left = left[~near]
                queue += got.tolist()
                roots += [root] * len(got)
                members += got.tolist()
    return np.array(roots, np.int64), np.array(members, np.int64)


def _tester(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, asks: np.ndarray | None, raw: list | None, threshold: int):
    """Tells what a document of a task is linked with: what is in its component already; what is under the signature threshold and, with sets, similar enough."""
    if raw is not None:
        values = np.concatenate(raw) if raw else np.zeros(0, np.uint64)
        at = np.r_[0, np.cumsum(n)]
        ids = np.unique(values, return_inverse=True)[1]
        mark = np.zeros(int(ids.max(initial=-1)) + 1, np.uint8)

    def fits(i: int, left: np.ndarray) -> np.ndarray:
        ok = comp[left] == comp[i]
        may = ~ok & (100 * np.minimum(n[left], n[i]) >= threshold * np.maximum(n[left], n[i]))
        if asks is not None:
            may &= asks[left] != asks[i]
        c = np.flatnonzero(may)
        c = c[(sig[left[c]] != sig[i]).sum(1) <= NEAR]
        if raw is not None and len(c):
            d = left[c]
            own = ids[at[i] : at[i + 1]]
            mark[own] = 1
            ends = np.cumsum(n[d])
            place = np.repeat(at[d] - (ends - n[d]), n[d]) + np.arange(int(ends[-1]))
            both = np.add.reduceat(mark[ids[place]], ends - n[d], dtype=np.int64)
            mark[own] = 0
            c = c[100 * both >= threshold * (n[d] + n[i] - both)]
        ok[c] = True
        return ok

    return fits


def _central(sig: np.ndarray) -> tuple[int, int]:
    """The document that differs least from the most frequent symbols of all, and in how many."""
    most = np.empty(sig.shape[1], sig.dtype)
    for j in range(sig.shape[1]):
        values, times = np.unique(sig[:, j], return_counts=True)
        most[j] = values[times.argmax()]
    off = (sig != most).sum(1)
    return int(off.argmin()), int(off.min())


FOUND = "a long, b long, off long"


def _tasks(threshold: int, exact: bool, cross: bool):
    """Over rows sorted by (group, part): links (a, b) of a spanning forest of each part; for parts of large groups also (central document, group, off)."""

    def links(t: pa.Table):
        group, part, node, n, comp, blocks = (np.asarray(t.column(c)) for c in ("group", "part", "node", "n", "component", "blocks"))
        asks = np.asarray(t.column("asks"), dtype=bool) if cross else None
        sig = np.frombuffer(b"".join(x.as_buffer() for x in t.column("sig").combine_chunks()), "<u2").reshape(-1, SYMBOLS)
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("raw").combine_chunks()] if exact else None
        cut = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1])) + 1
        lows, highs = np.r_[0, cut], np.r_[cut, len(group)]
        a, b, off = [], [], []
        if not exact and not cross:  # most buckets hold two documents: these are compared all at once
            two = lows[(highs - lows == 2) & (blocks[lows] == 1)]
            fit = ((sig[two] != sig[two + 1]).sum(1) <= NEAR) & (100 * np.minimum(n[two], n[two + 1]) >= threshold * np.maximum(n[two], n[two + 1]))
            a, b = [node[two[fit]]], [node[two[fit] + 1]]
            off = [np.full(int(fit.sum()), -1)]
        for lo, hi in zip(lows.tolist(), highs.tolist()):
            if hi - lo > 2 or exact or cross or blocks[lo] > 1:
                if hi - lo > 1:
                    s = slice(lo, hi)
                    r, m = forest(hi - lo, _tester(sig[s], n[s], comp[s], None if asks is None else asks[s], raw[s] if exact else None, threshold))
                    known = comp[lo + r] == comp[lo + m]
                    r, m = r[~known], m[~known]
                    a.append(node[lo + r])
                    b.append(node[lo + m])
                    off.append(np.full(len(r), -1))
                if blocks[lo] > 1 and not cross:
                    k, least = _central(sig[lo:hi])
                    a.append(node[[lo + k]])
                    b.append(group[[lo]])
                    off.append(np.array([least]))
        if a and (a := np.concatenate(a)).size:
            rows = np.unique(np.stack([a, np.concatenate(b), np.concatenate(off)], 1), axis=0)
            yield from pa.table({"a": rows[:, 0], "b": rows[:, 1], "off": rows[:, 2]}).to_batches()

    def run(it):
        held: list[pa.RecordBatch] = []
        for batch in it:  # what may go on in the next batch is held back
            if not batch.num_rows:
                continue
            held.append(batch)
            ends = [(int(np.asarray(x.column(c))[k])) for x, k in ((held[0], 0), (batch, -1)) for c in ("group", "part")]
            if ends[:2] == ends[2:]:
                continue
            t = pa.Table.from_batches(held)
            same = (np.asarray(t.column("group")) == ends[2]) & (np.asarray(t.column("part")) == ends[3])
            k = int(same.argmax())
            yield from links(t.slice(0, k))
            held = t.slice(k).to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def _search(need: DataFrame, rows_of: Callable[[DataFrame], DataFrame], threshold: int, exact: bool, cross: bool) -> DataFrame:
    """Links found in the tasks of ``need`` (group, blocks, part, node, component, asks)."""
    dealt = rows_of(need).repartition("group", "part").sortWithinPartitions("group", "part")
    return written(dealt.mapInArrow(_tasks(threshold, exact, cross), FOUND), "found")


def linked(members: DataFrame, rows_of: Callable[[DataFrame], DataFrame], threshold: int, exact: bool) -> DataFrame:
    """(node, component) of the graph within the groups of ``members`` (group, node, blocks); nodes without a link have no row.

    ``rows_of`` adds to the rows of a task what it compares.
    """
    alone = members.withColumn("part", spread(F.col("node"), F.col("blocks"))).withColumn("asks", F.lit(False)).withColumn("component", F.col("node"))
    found = _search(alone, rows_of, threshold, exact, False)
    links = found.where("off < 0").select("a", "b").distinct()
    named = components(links, "a", "b")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return named
    large = written(large, "large")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(named.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").withColumn("component", F.coalesce("component", "node")).drop("n_")

    central = found.where("off >= 0").select(F.col("a").alias("node"), F.col("b").alias("group"), "off")
    rank = F.row_number().over(Window.partitionBy("group").orderBy("off", "node"))
    central = central.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("group", "node")
    here = spread(F.col("node"), F.col("blocks"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    stands = large.withColumn("part", here).withColumn("asks", F.lit(False))
    asks = large.join(central, ["group", "node"], "left_semi").withColumn("part", everywhere).withColumn("asks", F.lit(True))
    more = _search(placed(stands.unionByName(asks)), rows_of, threshold, exact, True)
    links = written(links.unionByName(more.select("a", "b")).distinct(), "links")
    named = components(links, "a", "b")

    rest = written(placed(large), "rest")
    each = rest.groupBy("group", "component").agg(F.count("*").alias("c"))
    mixed = each.groupBy("group").agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("l")).where("k > 1")
    # What asks is dealt into turns of about a block, so that a task has two blocks at most.
    mixed = mixed.select("group", F.col("l.component").alias("largest"), (1 - F.col("l.c") / F.col("m")).alias("share"))
    rest = rest.join(mixed, "group").withColumn("turns", F.ceil(F.col("blocks") * F.col("share")).cast("long"))
    turn = lambda c: F.col("place").cast("long") * F.col("turns") + c
    stands = rest.withColumn("place", here).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).withColumn("part", turn(F.col("turn"))).withColumn("asks", F.lit(False))
    asks = rest.where(F.col("component") != F.col("largest")).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), "turns")).withColumn("place", everywhere).withColumn("part", turn(F.col("turn"))).withColumn("asks", F.lit(True))
    names = ["group", "node", "blocks", "component", "part", "asks"]
    more = _search(stands.select(*names).unionByName(asks.select(*names)), rows_of, threshold, exact, True)
    if more.isEmpty():
        return named
    return components(links.unionByName(more.select("a", "b")).distinct(), "a", "b")


def _once(texts: DataFrame, again: DataFrame, width: int) -> DataFrame:
    """Full sets, one for each doc_id and set. ``again``: those that several rows have; each task keeps one of its own before they are moved."""
    key = ["doc_id", "n", "h1", "h2"]
    each = texts.mapInArrow(_set_rows(True, width), SETS)
    if again.isEmpty():
        return each
    some = maybe_in(texts, "doc_id", filter_words(again, "doc_id")).mapInArrow(_set_rows(True, width), SETS)
    several = some.groupBy(*key).agg(F.first("raw").alias("raw")).join(again, key, "left_semi")
    return each.join(again, key, "left_anti").unionByName(several.select(*each.columns))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 80, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, h1, h2) for each document.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; the set is that of the distinct
    shingles of ``width`` words, or the whole sequence if there are fewer. Documents are linked when
    100 * intersection >= threshold * union; component_id is the smallest doc_id reachable; h1 and h2 with
    n_shingles identify the set. Null and empty texts are linked with nothing. Very long texts count whole.
    Rows that repeat both doc_id and set are one document; rows that repeat a doc_id with other sets are
    documents of their own; a set that many rows of one doc_id have is compared once. Rows without a doc_id are no documents. An empty table gives an empty result.
    Other columns are ignored.
    """
    rows = _rows(docs, doc_id, text)
    sets = written(rows.mapInArrow(_set_rows(False, width), SETS), "sets")
    # Copies have one set: they are linked at once, and their smallest document stands for them.
    classes = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("raw").alias("sig"), F.count("*").alias("copies"))
    reps = written(classes.withColumn("node", F.monotonically_increasing_id()), "reps")

    keys = reps.select("node", "sig").mapInArrow(_key_rows, "node long, key long")
    buckets = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = maybe_in(keys, "key", filter_words(buckets, "key")).join(buckets, "key")
    met = written(met.select(F.col("key").alias("group"), "node", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "members")
    clusters = linked(met, lambda need: need.join(reps.select("node", "n", "sig"), "node"), threshold, False)
    release(met)

    held = written(clusters.join(reps, "node").select(F.col("component").alias("group"), "node", F.col("rep").alias("doc_id"), "n", "h1", "h2", "sig"), "held")
    sizes = held.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    texts = maybe_in(rows, "doc_id", filter_words(held, "doc_id"))
    key = ["doc_id", "n", "h1", "h2"]
    again = written(sets.where("n > 0").groupBy(*key).agg(F.count("*").alias("times")).where("times > 1").select(*key), "repeated")

    def full(need: DataFrame) -> DataFrame:
        return need.join(held.drop("group"), "node").join(_once(texts, again, width), key).drop("doc_id", "h1", "h2")

    named = linked(held.select("group", "node").join(sizes, "group"), full, threshold, True)
    # Only sets of several documents or with links have a row here; any other document is its own component.
    placed = reps.join(named, "node", "left").where("copies > 1 or component is not null").select("n", "h1", "h2", "rep", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = placed.join(least, "component").select("n", "h1", "h2", "component_id")
    out = sets.select("doc_id", "n", "h1", "h2").distinct().join(final, ["n", "h1", "h2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "h1", "h2")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "h1", "h2")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("h1", "h2")


ORACLE = {
    "op4_minhash_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
                   ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
            FROM w),
        x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
        y AS (SELECT x.* FROM x JOIN f USING (g)),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM y a JOIN y b ON a.g = b.g AND a.doc_id < b.doc_id
             AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u WHERE r.c < e.v),
        m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
        FROM s JOIN m USING (doc_id)
    """
}
