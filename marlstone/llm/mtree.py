"""Exact top-k search by inner product in M-trees.

Vectors x of a tree get one more coordinate sqrt(M - |x|^2), M the largest squared norm, so that
all lie on a sphere; then |q - x|^2 = |q|^2 + M - 2 <q, x>, the nearest vectors are those of the
largest inner product, and Euclidean distance obeys the triangle inequality. A tree consists of
pages: leaf pages hold vectors with their distances to the page's routing object, inner pages hold
routing objects with covering radii and distances to their own parent. Search takes pages best
first; an entry whose stored parent distance already rules it out is never computed.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, table, written

PAGE = 512
FAN = 16
#: Vectors of a tree and queries of a block.
TREE, BLOCK = 8192, 2048
#: Least slack for distances; see ``slack``.
EPS = 1e-6


def _largest(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


def exact_type(a: int, b: int, dims: int) -> type:
    """A type in which inner products of vectors with components up to a and b are exact."""
    most = a * b * max(1, dims)
    if most >= 2**63:
        raise OverflowError(f"inner products of components up to {a} and {b} may not fit in 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def slack(base: float) -> float:
    """Bound for the error of a distance that is the root of a difference of numbers up to ``base`` in double precision."""
    return EPS + 1e-7 * float(np.sqrt(base))


def build(ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray | None = None) -> list[dict]:
    """Pages of a tree over integer vectors; page 0 is the root. ``keys`` tell rows of one id apart; without them ids do.

    A set above PAGE vectors is split around up to FAN routing objects taken farthest first; a set that
    distance cannot split (copies) is cut evenly, so pages stay bounded.
    """
    keys = ids if keys is None else keys
    x = vectors.astype(np.float64)
    norm = np.einsum("ij,ij->i", x, x)
    top = float(norm.max(initial=0.0))
    extra = np.sqrt(top - norm)
    pages: list[dict] = []

    def distances(rows: np.ndarray, o: int) -> np.ndarray:
        d2 = norm[rows] + norm[o] - 2 * (x[rows] @ x[o]) + (extra[rows] - extra[o]) ** 2
        return np.sqrt(np.maximum(d2, 0.0))

    def page(rows: np.ndarray, parent: int) -> tuple[int, float]:
        """Page number and covering radius of the rows around their routing object."""
        number = len(pages)
        pages.append({})
        far = distances(rows, parent)
        if len(rows) <= PAGE:
            order = np.argsort(far, kind="stable")
            rows = rows[order]
            pages[number] = {"leaf": True, "ids": ids[rows], "keys": keys[rows], "vectors": vectors[rows], "parent": far[order]}
            return number, float(far.max(initial=0.0))
        pivots, nearest, near = [], np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
        nxt = int(rows[0])
        while len(pivots) < FAN:
            d = distances(rows, nxt)
            closer = d < near
            nearest[closer], near[closer] = len(pivots), d[closer]
            pivots.append(nxt)
            k = int(near.argmax())
            if near[k] <= EPS:
                break
            nxt = int(rows[k])
        groups = [rows[nearest == g] for g in range(len(pivots))]
        groups = [(p, g) for p, g in zip(pivots, groups) if len(g)]
        if max(len(g) for _, g in groups) > 0.9 * len(rows):  # distance hardly splits these
            cut = np.array_split(rows[np.argsort(near, kind="stable")], -(-len(rows) // PAGE) if len(rows) <= PAGE * FAN else FAN)
            groups = [(int(g[0]), g) for g in cut]
        made = [(p, *page(g, p)) for p, g in groups]
        at = np.array([p for p, _, _ in made])
        pages[number] = {
            "leaf": False, "objects": vectors[at], "parent": distances(at, parent),
            "pages": np.array([n for _, n, _ in made]), "radii": np.array([r for _, _, r in made]),
        }
        return number, float(far.max())

    if len(ids):
        page(np.arange(len(ids)), 0)
        pages[0]["root"], pages[0]["top"] = vectors[:1], top
    return pages


def to_bytes(page: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **page)
    return out.getvalue()


def from_bytes(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw)) as got:
        return {k: got[k] for k in got.files}


class Tree:
    """Searches pages; a page's vectors are turned into the type that a query needs once, and kept."""

    def __init__(self, pages: list[dict]):
        self.pages, self.top, self.computed = pages, float(pages[0]["top"]), 0
        self.names = ["vectors" if p["leaf"] else "objects" for p in pages]
        self.largest = max(_largest(p[n]) for p, n in zip(pages, self.names))
        self.typed: dict[tuple[int, type], np.ndarray] = {}

    def of(self, number: int, kind: type) -> np.ndarray:
        if (number, kind) not in self.typed:
            self.typed[number, kind] = self.pages[number][self.names[number]].astype(kind)
        return self.typed[number, kind]

    def search(self, q: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k largest inner products with q, ties to the smaller id; the row with the key ``skip`` is left out."""
        kind = exact_type(self.largest, _largest(q), len(q))
        x = q.astype(np.float64)
        q = q.astype(kind)
        base = float(x @ x) + self.top
        eps = slack(base)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = np.inf  # distance of the k-th best so far
        first = np.sqrt(max(base - 2 * float(self.pages[0]["root"][0].astype(np.float64) @ x), 0.0))
        queue = [(0.0, 0, first)]
        while queue:
            least, number, own = heapq.heappop(queue)
            if least > reach + eps:
                break
            page = self.pages[number]
            if page["leaf"]:
                lo = np.searchsorted(page["parent"], own - reach - eps) if reach < np.inf else 0
                hi = np.searchsorted(page["parent"], own + reach + eps, "right") if reach < np.inf else len(page["parent"])
                if lo >= hi:
                    continue
                s = (self.of(number, kind)[lo:hi] @ q).astype(np.int64)
                self.computed += hi - lo
                got, keys = page["ids"][lo:hi], page["keys"][lo:hi]
                if len(scores) >= k:
                    keep = s >= scores[-1]
                    s, got, keys = s[keep], got[keep], keys[keep]
                if skip is not None and len(got):
                    keep = keys != skip
                    s, got = s[keep], got[keep]
                if len(s):
                    s, got = np.concatenate([scores, s]), np.concatenate([ids, got])
                    best = np.lexsort((got, -s))[:k]
                    ids, scores = got[best], s[best]
                    if len(scores) >= k:
                        reach = np.sqrt(max(base - 2.0 * float(scores[-1]), 0.0))
            else:
                open_ = np.flatnonzero(np.abs(own - page["parent"]) - page["radii"] <= reach + eps)
                if len(open_):
                    d = np.sqrt(np.maximum(base - 2 * (self.of(number, kind)[open_] @ q).astype(np.float64), 0.0))
                    self.computed += len(open_)
                    for j, far in zip(open_.tolist(), d.tolist()):
                        bound = max(far - float(page["radii"][j]), 0.0)
                        if bound <= reach + eps:
                            heapq.heappush(queue, (bound, int(page["pages"][j]), far))
        return ids, scores


def _vectors(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten(), dtype=np.int64).reshape(len(rows), -1)


def _build(key, rows):
    if rows.num_rows:
        order = np.argsort(np.asarray(rows.column("id")), kind="stable")
        pages = build(np.asarray(rows.column("id"))[order], _vectors(rows.column("v"))[order], np.asarray(rows.column("key"))[order])
    else:
        pages = []
    return pa.table(
        {"dim": pa.array([key[0].as_py()] * len(pages), pa.int32()), "tree": pa.array([key[1].as_py()] * len(pages), pa.int32()),
         "page": pa.array(range(len(pages)), pa.int32()), "raw": pa.array([to_bytes(p) for p in pages], pa.binary())}
    )


def _search(k: int):
    def run(key, pages, queries):
        out: list[tuple] = []
        if pages.num_rows and queries.num_rows:
            order = np.argsort(np.asarray(pages.column("page")))
            raw = pages.column("raw").to_pylist()
            tree = Tree([from_bytes(raw[i]) for i in order])
            for q, row, v in zip(queries.column("id").to_pylist(), queries.column("key").to_pylist(), _vectors(queries.column("v"))):
                ids, scores = tree.search(v, k, skip=row)
                out += [(q, row, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query_key", "vec_id", "score"), cols)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with the other vectors.

    ``vectors`` and ``queries`` have (id long, v array of long). Vectors are dealt evenly into trees of about
    TREE, queries into blocks of about BLOCK; each block meets each tree once, and a query's candidates are
    merged at the end. Products are computed in a type in which they are exact, chosen for each query and tree;
    OverflowError if they may not fit in 64 bits. Without vectors or queries there is no row. Vectors compare with queries of their own length only. A vector that a query repeats
    under another id is a candidate like any other; rows that repeat an id and a vector count once. Rows that share an id but not
    the vector are rows of their own: as queries each has its ranks from 1, and each is a candidate, the other's too.
    """
    size = F.size("v").alias("dim")
    vectors, queries = (d.select("id", "v", size, F.xxhash64("id", "v").alias("key")).dropDuplicates(["id", "v"]) for d in (vectors, queries))
    trees = max(1, -(-vectors.count() // TREE))
    blocks = max(1, -(-queries.count() // BLOCK))
    built = vectors.withColumn("tree", spread(F.col("id"), trees)).groupBy("dim", "tree").applyInArrow(_build, "dim int, tree int, page int, raw binary")
    pages = written(built, "pages").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", spread(F.struct("id"), blocks)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    key = ["dim", "tree", "block"]
    found = pages.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k), "query_id long, query_key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): floor(64 * x) of each component; vectors that are null or hold null or non-finite components, and rows without an id, are left out. Other columns are ignored; an empty table gives no row."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    whole = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = embeddings.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & whole)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 64).cast("long")).alias("v"))


def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = digest(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("id") % 20 == 0), 20)


ORACLE = {
    "op1_mtree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """
}
