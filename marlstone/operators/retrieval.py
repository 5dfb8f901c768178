"""Retrieval: BM25, exact kNN, boosted hybrid and reciprocal-rank fusion, with filters.

Chunks are (chunk_id, text, ...), queries (query_id, query), vectors (chunk_id, embedding). Results
are (query_id, rank, chunk_id, score); ties go to the smaller chunk_id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import scratch

K1, B, RRF = 1.2, 0.75, 60


def filters(by: dict | None) -> Column:
    """A scalar means equality, a list membership; all must hold."""
    terms = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in (by or {}).items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


#: Queries that are scored together, and rows of which all scores are held at a time.
QUERY_BLOCK, ROWS = 512, 2048


def _hashes(text: Column | str) -> Column:
    return F.transform(T.tokens(text), lambda t: F.xxhash64(t))


class KeywordScorer:
    """BM25 of rows of terms for a block of queries; holds the block's terms with their weights and the queries of each."""

    def __init__(self, query: np.ndarray, term: np.ndarray, idf: dict[int, float], avgdl: float):
        order = np.argsort(term, kind="stable")
        self.terms, first = np.unique(term[order], return_index=True)
        self.queries, self.first = query[order], np.append(first, len(order))
        self.idf, self.avgdl = np.array([idf.get(int(t), 0.0) for t in self.terms]), avgdl

    def scores(self, batch: pa.RecordBatch, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores (queries, rows) of rows (dl, terms, tf), and which rows hold a term of the query."""
        rows = batch.num_rows
        out, met = np.zeros((n_queries, rows)), np.zeros((n_queries, rows), bool)
        lists = [batch.column(c) for c in ("terms", "tf")]
        at = np.asarray(lists[0].offsets, dtype=np.int64)
        values, tf = (np.asarray(x.flatten(), dtype=np.int64) for x in lists)
        length = np.asarray(batch.column("dl"), dtype=np.float64)
        row = np.repeat(np.arange(rows), np.diff(at))
        if not len(self.terms) or not len(values):
            return out, met
        k = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
        held = self.terms[k] == values
        row, k, tf = row[held], k[held], tf[held]
        part = self.idf[k] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / self.avgdl))
        n = self.first[k + 1] - self.first[k]
        ends = np.cumsum(n)
        place = np.repeat(self.first[k] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        flat = self.queries[place] * rows + np.repeat(row, n)
        out = np.bincount(flat, weights=np.repeat(part, n), minlength=n_queries * rows).reshape(n_queries, rows)
        met.ravel()[flat] = True
        return out, met


def _best(ids: np.ndarray, queries: np.ndarray, scores: np.ndarray, met: np.ndarray, k: int):
    """(query, id, score) of the k best rows of each query, ties to the smaller id."""
    by_id = np.argsort(ids, kind="stable")
    ids, scores, met = ids[by_id], scores[:, by_id], met[:, by_id]
    q, c, s = [], [], []
    for j in range(len(queries)):
        at = np.flatnonzero(met[j])
        if len(at) > k:  # ids ascend, so a stable order keeps the smaller of equal scores
            at = at[np.argsort(-scores[j, at], kind="stable")[:k]]
        q += [queries[j]] * len(at)
        c.append(ids[at])
        s.append(scores[j, at])
    return q, np.concatenate(c) if c else ids[:0], np.concatenate(s) if s else np.zeros(0)


def _scan(rows: DataFrame, blocks: list, k: int, query_type: str) -> DataFrame:
    """Best k of each batch of rows (chunk_id, ...) for each query, of which ``top`` takes the best; only these are shuffled.

    blocks: query_ids and what scores a batch for them; all blocks are asked in the one scan of the rows.
    """
    id_type = dict(rows.dtypes)["chunk_id"]
    kind, arrow = ("string", pa.string()) if query_type == "string" else ("long", pa.int64())

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                ids = np.array(b.column("chunk_id").to_pylist(), dtype=object if id_type == "string" else None)
                for queries, score in blocks:
                    q, c, s = _best(ids, queries, *score(b), k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, arrow), pa.array(list(c), b.column("chunk_id").type), pa.array(s, pa.float64())], ["query_id", "chunk_id", "score"])

    found = rows.mapInArrow(run, f"query_id {kind}, chunk_id {id_type}, score double")
    return found.withColumn("query_id", F.col("query_id").cast(query_type))


def _blocks(rows: list, size: int = QUERY_BLOCK):
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def _asked(queries: DataFrame) -> list:
    """The stated queries with their term hashes."""
    return queries.select("query_id", F.array_distinct(_hashes("query")).alias("terms")).orderBy("query_id").collect()


def _reduced(chunks: DataFrame, asked: list, *keep: str) -> DataFrame:
    """Chunks with their length ``dl`` and, of the stated queries' terms only, ``terms`` and how often each stands there (``tf``): each text is tokenised once, and nothing else of it is kept.

    Written, since statistics over all chunks and then the scores are taken from it.
    """
    wanted = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in asked] or [np.zeros(0, np.int64)]))
    rows = chunks.select("chunk_id", *keep, _hashes("text").alias("_t"))

    def run(it):
        for b in it:
            tokens = b.column("_t")
            at = np.asarray(tokens.offsets, dtype=np.int64)
            values = np.asarray(tokens.values, dtype=np.int64)[at[0] : at[-1]]
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            if len(wanted):
                k = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
                held = wanted[k] == values
                cell, tf = np.unique(row[held] * len(wanted) + k[held], return_counts=True)
            else:
                cell = tf = np.zeros(0, np.int64)
            ends = pa.array(np.searchsorted(cell, np.arange(b.num_rows + 1) * max(1, len(wanted))), pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array(wanted[cell % max(1, len(wanted))] if len(cell) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("chunk_id", *keep)], pa.array(np.diff(at)), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], ["chunk_id", *keep, "dl", "terms", "tf"])

    schema = rows.drop("_t").withColumns({"dl": F.lit(0).cast("long"), "terms": F.array().cast("array<bigint>"), "tf": F.array().cast("array<bigint>")}).schema
    out = rows.mapInArrow(run, schema)
    path = scratch(chunks.sparkSession, "terms")
    out.write.parquet(path)
    return chunks.sparkSession.read.schema(schema).parquet(path)


def _weights(reduced: DataFrame) -> tuple[dict[int, float], float]:
    """Weights of the stated terms and the mean length, over all chunks whatever is filtered. A null term stands for each chunk itself."""
    terms = reduced.select("dl", F.explode(F.concat("terms", F.array(F.lit(None).cast("long")))).alias("term"))
    found = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total")).collect()  # as many rows as the queries have terms
    n, total = next(((r.df, r.total) for r in found if r.term is None), (0, 0))
    return {r.term: float(np.log(1 + (n - r.df + 0.5) / (r.df + 0.5))) for r in found if r.term is not None}, total / n if total else 1.0


def _scorer(block: list, idf: dict, mean: float) -> KeywordScorer:
    q = np.concatenate([np.full(len(r.terms), j) for j, r in enumerate(block)]).astype(np.int64)
    t = np.concatenate([np.array(r.terms, dtype=np.int64) for r in block])
    return KeywordScorer(q, t, idf, mean)


def keyword(chunks: DataFrame, queries: DataFrame, k: int = 10, by: dict | None = None) -> DataFrame:
    """BM25 top k for a stated query set. Each text is tokenised once; a task scores its chunks against the queries, a block at a time, and hands on k a query, so nothing else is shuffled. Statistics are those of all chunks."""
    asked = _asked(queries)
    names = [c for c in (by or {}) if c != "chunk_id"]
    reduced = _reduced(chunks, asked, *names)
    idf, mean = _weights(reduced)
    rows = reduced.where(filters(by)).select("chunk_id", "dl", "terms", "tf")
    blocks = [([r.query_id for r in block], _scorer(block, idf, mean)) for block in _blocks(asked)]

    def score(scorer, n):
        def run(b):
            s, met = scorer.scores(b, n)
            return np.round(s, 6), met

        return run

    return top(_scan(rows, [(ids, score(scorer, len(ids))) for ids, scorer in blocks], k, dict(queries.dtypes)["query_id"]), k)


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dims`` components as rows, others as zeros, and which rows have them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.array([-1 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()])
    ok = n == dims
    out = np.zeros((len(n), dims))
    if ok.any():
        out[ok] = np.asarray(column.filter(pa.array(ok)).flatten().fill_null(0), dtype=np.float64).reshape(-1, dims)
    return out, ok


def _by_size(queries: DataFrame) -> dict[int, list]:
    """The stated query vectors by their dimension."""
    out: dict[int, list] = {}
    for r in queries.where("embedding is not null").select("query_id", "embedding").orderBy("query_id").collect():
        out.setdefault(len(r.embedding), []).append(r)
    return out


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    def score(q, dims):
        def run(b):
            x, ok = _matrix(b.column("embedding"), dims)
            return np.round(q @ x.T, 6), np.broadcast_to(ok, (len(q), len(x)))

        return run

    blocks = []
    for dims, asked in _by_size(queries).items():
        for block in _blocks(asked):
            blocks.append(([r.query_id for r in block], score(np.array([r.embedding for r in block], np.float64).reshape(len(block), dims), dims)))
    return top(_scan(vectors.select("chunk_id", "embedding"), blocks, k, dict(queries.dtypes)["query_id"]), k)


def vector(vectors: DataFrame, queries: DataFrame, k: int = 10, by: dict | None = None, placement: str = "pre") -> DataFrame:
    """kNN for a stated query set, by blocks of queries against batches of vectors. Filters choose before the k are taken; ``placement="post"`` takes k first and may return fewer."""
    if placement == "pre":
        return _nearest(vectors.where(filters(by)), queries, k)
    kept = vectors.where(filters(by)).select("chunk_id")
    return _nearest(vectors, queries, k).join(kept, "chunk_id", "left_semi").select("query_id", "rank", "chunk_id", "score")


def hybrid(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = 10, keyword_boost: float = 0.3, vector_boost: float = 0.7) -> DataFrame:
    """Boosted sum of BM25 and inner product; a chunk that one of them alone finds has that part. Text and vector of a chunk meet once, and each task hands on k a query."""
    asked = _asked(queries)
    reduced = _reduced(chunks, asked)
    idf, mean = _weights(reduced)
    rows = reduced.join(vectors.select("chunk_id", "embedding"), "chunk_id", "full_outer")
    none = F.array().cast("array<bigint>")
    rows = rows.select("chunk_id", F.coalesce("dl", F.lit(0).cast("long")).alias("dl"), F.coalesce("terms", none).alias("terms"), F.coalesce("tf", none).alias("tf"), "embedding")
    known = {r.query_id: r.embedding for r in query_vectors.where("embedding is not null").select("query_id", "embedding").collect()}
    have = {r.query_id for r in asked}
    asked = [(r.query_id, list(r.terms)) for r in asked] + [(q, []) for q in sorted(known) if q not in have]

    def score(scorer, sides, n):
        def run(b):
            s, met = scorer.scores(b, n)
            s = np.round(s, 6) * keyword_boost
            for dims, js, q in sides:
                x, ok = _matrix(b.column("embedding"), dims)
                s[js] += np.round(q @ x.T, 6) * ok * vector_boost
                met[js] |= ok
            return np.round(s, 9), met

        return run

    blocks = []
    for block in _blocks(asked):
        scorer = KeywordScorer(np.concatenate([np.full(len(t), j) for j, (_, t) in enumerate(block)] or [np.zeros(0)]).astype(np.int64), np.concatenate([np.array(t, np.int64) for _, t in block] or [np.zeros(0, np.int64)]), idf, mean)
        sized: dict[int, list] = {}
        for j, (q, _) in enumerate(block):
            if q in known:
                sized.setdefault(len(known[q]), []).append(j)
        sides = [(d, js, np.array([known[block[j][0]] for j in js], np.float64)) for d, js in sized.items()]
        blocks.append(([q for q, _ in block], score(scorer, sides, len(block))))
    return top(_scan(rows, blocks, k, dict(queries.dtypes)["query_id"]), k)


def rrf(keyword_top: DataFrame, vector_top: DataFrame, k: int = 10) -> DataFrame:
    """Sum of 1 / (rank from 0 + 60) over both lists; ties in order of first sight, keyword list first."""
    rows = keyword_top.select("query_id", "chunk_id", F.col("rank"), F.lit(0).alias("list")).unionByName(vector_top.select("query_id", "chunk_id", F.col("rank"), F.lit(1).alias("list")))
    merged = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.col("rank") - 1 + RRF)), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "chunk_id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def fetch_size(k: int) -> int:
    return min(3 * k, 100)


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, mode: str = "hybrid", k: int = 10, by: dict | None = None) -> DataFrame:
    """Results of a mode: keyword, vector, hybrid or rrf. Filters hold in the first two, which are the ones that take them before the k."""
    modes = {
        "keyword": lambda: keyword(chunks, queries, k, by), "vector": lambda: vector(vectors, query_vectors, k, by), "hybrid": lambda: hybrid(chunks, vectors, queries, query_vectors, k),
        "rrf": lambda: rrf(keyword(chunks, queries, fetch_size(k)), vector(vectors, query_vectors, fetch_size(k)), k),
    }
    if mode not in modes:
        raise ValueError(f"no search mode {mode}; there are {', '.join(modes)}")
    return modes[mode]()


def context(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Numbered passages and citations of each query's results, in order of rank."""
    rows = results.join(chunks, "chunk_id")
    label = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("chunk_id"), F.lit(": "), F.substring("text", 1, 200))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("l")))), lambda x: x["l"]), "\n\n").alias("context"), F.count("*").alias("n_passages"), F.max("score").alias("top_score"))


# Phrases of an answer that is not sure.
HEDGES = ["could not find", "no information", "unclear", "not specified"]


def hedged(answer: Column | str) -> Column:
    """Whether an answer holds one of HEDGES; a missing answer does not."""
    low = F.lower(T.col(answer))
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in HEDGES]), F.lit(False))


def confidence(results: DataFrame, answers: DataFrame, high: float = 0.03, medium: float = 0.02) -> DataFrame:
    """high, medium or low for each answer (query_id, answer): from the best score and how many results have more than half of it; low if the answer hedges or has no results."""
    best = results.groupBy("query_id").agg(F.max("score").alias("top_score"))
    near = results.join(best, "query_id").groupBy("query_id", "top_score").agg(F.count_if(F.col("score") > F.col("top_score") * 0.5).alias("strong"))
    rows = answers.join(near, "query_id", "left").withColumn("strong", F.coalesce("strong", F.lit(0).cast("long")))
    level = (
        F.when(hedged("answer") | F.col("top_score").isNull(), "low").when((F.col("top_score") > high) & (F.col("strong") >= 3), "high")
        .when((F.col("top_score") > medium) & (F.col("strong") >= 2), "medium").otherwise("low")
    )
    return rows.select("query_id", "top_score", "strong", level.alias("confidence"))


def warnings(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, open_items, contractual) of answers (query_id, answer): whether a result's text holds an open item, and whether the answer speaks of what shall be."""
    source = results.groupBy("query_id").agg(F.bool_or(F.contains(F.lower("text"), F.lit("tbd"))).alias("open_items"))
    rows = answers.join(source, "query_id", "left")
    return rows.select("query_id", F.coalesce("open_items", F.lit(False)).alias("open_items"), F.coalesce(F.contains(F.lower("answer"), F.lit("shall")), F.lit(False)).alias("contractual"))
