"""Hard negatives of anchors: rows of other labels whose inner product lies in a window below a positive's.

Rows are dealt into ball trees, groups of labels to a tree and large groups to several. A node knows the
centre c and radius r of its vectors, so every inner product with an anchor a lies between <a, c> - |a| r and
<a, c> + |a| r. A search goes down the tree with all anchors of a block at once; an anchor leaves a node whose
bounds lie outside its window, strictly beneath its k-th best so far, or whose rows all have a label that does
not count. First each anchor's positives are found in the trees of its own label, then for each positive the
negatives of its window in all trees.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, table, written
from .mtree import exact_type, slack

#: Rows of a leaf, of a tree, and anchors of a block.
LEAF, TREE, BLOCK = 256, 8192, 2048
#: Asks whose scores in a leaf are held at a time.
CHUNK = 4096
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def build(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree over integer vectors: ``order`` (rows by leaf) and per node centre, radius, first and last place, and children (-1: leaf).

    A node is cut in the middle along the line between two rows that lie far apart, so copies are cut evenly and leaves stay bounded.
    """
    x = vectors.astype(np.float64)
    order = np.arange(len(x))
    nodes: list[list] = []

    def node(lo: int, hi: int) -> int:
        rows = order[lo:hi]
        centre = x[rows].mean(0)
        far = np.sqrt(((x[rows] - centre) ** 2).sum(1))
        number = len(nodes)
        nodes.append([centre, float(far.max()), lo, hi, -1, -1])
        if hi - lo > LEAF:
            a = x[rows[far.argmax()]]
            line = x[rows[((x[rows] - a) ** 2).sum(1).argmax()]] - a
            half = (hi - lo) // 2
            order[lo:hi] = rows[np.argpartition(x[rows] @ line, half)]
            nodes[number][4] = node(lo, lo + half)
            nodes[number][5] = node(lo + half, hi)
        return number

    if len(x):
        node(0, len(x))
    centre, radius, lo, hi, left, right = zip(*nodes) if nodes else ([],) * 6
    return {"order": order, "centre": np.array(centre), "radius": np.array(radius), "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left), "right": np.array(right)}


class BallTree:
    """Rows (id, row key, label, vector) in a ball tree."""

    def __init__(self, tree: dict[str, np.ndarray], ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        o = tree["order"]
        self.tree, self.ids, self.rows, self.labels, self.vectors = tree, ids[o], rows[o], labels[o], vectors[o]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
        self.computed = 0
        bounds = [(self.labels[a:b].min(), self.labels[a:b].max()) for a, b in zip(tree["lo"], tree["hi"])]
        self.least, self.most = np.array(bounds, np.int64).reshape(-1, 2).T

    def search(self, anchors: np.ndarray, label: np.ndarray, row: np.ndarray, ask: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """For each ask the k highest scores from lo to hi, both included, among rows of the anchor's label (``same``) or of others, without the anchor's own row.

        anchors, label, row: one of each anchor; ask: the anchor of each ask, ascending. Gives (ask, score, id, row), ties to the smaller id, then row.
        """
        kind = exact_type(self.largest, int(np.abs(anchors).max(initial=0)), anchors.shape[1])
        real, whole = anchors.astype(np.float64), anchors.astype(kind)
        length = np.sqrt((real**2).sum(1))
        eps = slack(float(length.max(initial=0.0)) * self.norm)
        kth = np.full(len(ask), LOWEST)
        best = np.full((len(ask), k), LOWEST), np.zeros((len(ask), k), np.int64), np.zeros((len(ask), k), np.int64)
        held = np.zeros(len(ask), np.int64)
        t = self.tree
        typed = self.vectors.astype(kind)
        stack = [(0, np.arange(len(ask)))] if len(t["lo"]) else []
        while stack:
            node, alive = stack.pop()
            mine = label[ask[alive]]
            if same:
                alive = alive[(self.least[node] <= mine) & (mine <= self.most[node])]
            else:
                alive = alive[(self.least[node] != mine) | (self.most[node] != mine)]
            if not len(alive):
                continue
            who, inverse = np.unique(ask[alive], return_inverse=True)
            near = real[who] @ t["centre"][node]
            reach = length[who] * t["radius"][node] + eps
            keep = ((near + reach)[inverse] >= np.maximum(lo[alive], kth[alive])) & ((near - reach)[inverse] <= hi[alive])
            alive = alive[keep]
            if not len(alive):
                continue
            if t["left"][node] >= 0:
                children = [int(t["left"][node]), int(t["right"][node])]
                if (real[who] @ (t["centre"][children[0]] - t["centre"][children[1]])).sum() > 0:
                    children.reverse()  # the nearer one is taken from the stack first
                stack += [(c, alive) for c in children]
                continue
            a, b = int(t["lo"][node]), int(t["hi"][node])
            for part in np.array_split(alive, -(-len(alive) // CHUNK)):
                self._leaf(typed[a:b], a, b, whole, label, row, ask, part, lo, hi, same, k, kth, best, held)
        filled = np.arange(k) < held[:, None]
        return (np.nonzero(filled)[0], *(x[filled] for x in best))

    def _leaf(self, vectors, a, b, anchors, label, row, ask, part, lo, hi, same, k, kth, best, held) -> None:
        who, inverse = np.unique(ask[part], return_inverse=True)
        score = (anchors[who] @ vectors.T).astype(np.int64)
        self.computed += score.size
        fits = (label[who][:, None] == self.labels[None, a:b]) == same
        fits &= row[who][:, None] != self.rows[None, a:b]
        score, fits = score[inverse], fits[inverse]
        fits &= (score >= np.maximum(lo[part], kth[part])[:, None]) & (score <= hi[part][:, None])
        many = np.flatnonzero(fits.sum(1) > 2 * k)
        if len(many):  # only scores from this leaf's own k-th on can count
            kept = np.where(fits[many], score[many], LOWEST)
            fits[many] &= kept >= np.partition(kept, -k, axis=1)[:, -k][:, None]
        at, col = np.nonzero(fits)
        if not len(at):
            return
        touched = np.unique(at)
        asks = part[touched]
        old = np.arange(k) < held[asks][:, None]
        of = np.concatenate([np.searchsorted(touched, at), np.nonzero(old)[0]])
        s, i, r = (np.concatenate([new, x[asks][old]]) for new, x in zip((score[at, col], self.ids[a:b][col], self.rows[a:b][col]), best))
        order = np.lexsort((r, i, -s, of))
        of = of[order]
        first = np.searchsorted(of, np.arange(len(asks)))
        place = np.arange(len(of)) - first[of]
        keep = place < k
        of, place, order = of[keep], place[keep], order[keep]
        for x, new in zip(best, (s, i, r)):
            x[asks[of], place] = new[order]
        held[asks] = np.bincount(of, minlength=len(asks))
        full = asks[held[asks] == k]
        kth[full] = best[0][full, k - 1]


def _vectors(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten(), dtype=np.int64).reshape(len(rows), -1)


def _build(key, rows):
    out = []
    if rows.num_rows:
        ids, row, labels = (np.asarray(rows.column(c)) for c in ("id", "row", "label"))
        by = np.lexsort((row, ids))
        vectors = _vectors(rows.column("v"))[by]
        raw = io.BytesIO()
        small = np.int32 if np.abs(vectors).max(initial=0) < 2**31 else np.int64
        np.savez(raw, **build(vectors), ids=ids[by], rows=row[by], labels=labels[by], vectors=vectors.astype(small))
        out = [raw.getvalue()]
    return pa.table({"dim": pa.array([key[0].as_py()] * len(out), pa.int32()), "tree": pa.array([key[1].as_py()] * len(out), pa.int64()), "raw": pa.array(out, pa.binary())})


def _open(raw: bytes) -> BallTree:
    with np.load(io.BytesIO(raw)) as got:
        held = {k: got[k] for k in got.files}
    rows = [held.pop(c) for c in ("ids", "rows", "labels", "vectors")]
    return BallTree(held, *rows[:3], rows[3].astype(np.int64))


FOUND = "anchor_id bigint, anchor_row bigint, window int, id bigint, row bigint, score bigint"


def _search(same: bool, k: int):
    def run(key, trees, asks):
        cols: list = [np.zeros(0, np.int64)] * 6
        if trees.num_rows and asks.num_rows:
            tree = _open(trees.column("raw")[0].as_py())
            ids, row, label = (np.asarray(asks.column(c)) for c in ("id", "row", "label"))
            windows = asks.column("windows").combine_chunks()
            flat = windows.flatten()
            ask = np.repeat(np.arange(len(ids)), np.asarray(windows.value_lengths()))
            window, lo, hi = (np.asarray(flat.field(c)) for c in ("window", "lo", "hi"))
            of, score, found, found_row = tree.search(_vectors(asks.column("v")), label, row, ask, lo, hi, same, k)
            cols = [ids[ask[of]], row[ask[of]], window[of], found, found_row, score]
        names = ("anchor_id", "anchor_row", "window", "id", "row", "score")
        return pa.table({n: pa.array(c, pa.int32() if n == "window" else pa.int64()) for n, c in zip(names, cols)})

    return run


def _met(trees: DataFrame, asks: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """The k best of each window. asks: (id, row, label, v, dim, windows, tree); each block of asks meets each of its trees in a task of its own."""
    key = ["dim", "tree", "block"]
    copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = copies.groupBy(*key).cogroup(asks.withColumn("block", spread(F.col("row"), blocks)).groupBy(*key)).applyInArrow(_search(same, k), FOUND)
    best = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives for each anchor and each of its positives.

    vectors: (id, label, v array of long), anchors: rows of it. Positives of an anchor are the ``positives`` other rows of its label
    with the highest inner products; negatives of a positive are the ``negatives`` highest rows of other labels whose score is from least
    to most percent of the positive's. Ties go to the smaller id. Rows that repeat id, label and vector count once; rows that share an id
    but differ are rows of their own, as anchors, positives and negatives. Vectors compare with those of their length only. An anchor without
    other rows of its label, and a positive whose window holds no row (each positive with a score below 0), has no row; empty tables give none.
    OverflowError if products may not fit in 64 bits.
    """
    size = F.size("v").alias("dim")
    row = F.xxhash64("id", "label", "v").alias("row")
    vectors, anchors = (d.select(F.col("id").cast("long"), F.col("label").cast("long"), "v", size, row).dropDuplicates(["row"]) for d in (vectors, anchors))
    anchors = written(anchors, "anchors")
    groups = max(1, -(-vectors.count() // TREE))
    blocks = max(1, -(-anchors.count() // BLOCK))
    group = spread(F.col("label"), groups).cast("long")
    dealt = vectors.withColumn("group", group)
    # A group above TREE rows, such as that of a hot label, is several trees.
    slots = written(dealt.groupBy("dim", "group").agg(F.ceil(F.count("*") / TREE).cast("int").alias("slots")), "slots")
    place = F.col("group") * (1 << 32) + spread(F.struct("row"), F.col("slots"))
    trees = written(dealt.join(slots, ["dim", "group"]).withColumn("tree", place).groupBy("dim", "tree").applyInArrow(_build, "dim int, tree long, raw binary"), "balls")

    whole = F.array(F.struct(F.lit(0).alias("window"), F.lit(LOWEST).cast("long").alias("lo"), F.lit(HIGHEST).cast("long").alias("hi")))
    every = slots.select("dim", "group", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).select("dim", "group", (F.col("group") * (1 << 32) + F.col("slot")).alias("tree"))
    own = anchors.withColumn("group", group).join(every, ["dim", "group"]).drop("group").withColumn("windows", whole)
    best = _met(trees, own, blocks, True, positives).select("anchor_row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = written(best, "positives")

    window = F.struct(F.col("rank").alias("window"), F.ceil(F.expr(f"{least} * cast(positive_score as decimal(20)) / 100")).cast("long").alias("lo"), F.floor(F.expr(f"{most} * cast(positive_score as decimal(20)) / 100")).cast("long").alias("hi"))
    open_ = best.where("positive_score >= 0").groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(window)).alias("windows"))  # at most ``positives`` of them
    asks = written(anchors.join(open_, "row"), "asks").join(every.drop("group"), "dim")
    found = _met(trees, asks, blocks, False, negatives)
    named = best.select("anchor_row", F.col("rank").alias("window"), "positive_id", "positive_score")
    return found.join(named, ["anchor_row", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def digest(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, v): floor(scale * x) of each component. Rows without an id or label, and vectors that are null or hold null or non-finite components, are left out; other columns are ignored."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest(table(spark, sf_dir, "embeddings")).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("id") % 50 == 0))


ORACLE = {
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM v a JOIN v c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % 50 = 0),
        p AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
                s.id AS negative_id, positive_score, s.score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT * FROM n WHERE rank <= 3
    """
}
