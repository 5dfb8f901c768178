"""Queries over documents, embeddings, benchmark: chunking, retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranks import picked
from ..operators import chunking, collection, evaluate, providers, retrieval
from ..sources.store import scratch
from ..sources.tables import Tables
from .base import query, table

SIZE, STEP = chunking.window_size(512, 64)


def doc_words(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.words("text").alias("words"))


def elements(spark, sf_dir) -> DataFrame:
    """Lines of documents as elements; a line that ends without a full stop and has at most four words counts as a heading."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    head = (F.size(T.words("text")) <= 4) & ~F.endswith("text", F.lit("."))
    return rows.select("doc", F.lit(1).alias("page"), F.col("ord").cast("double").alias("y"), F.when(head, "heading").otherwise("text").alias("kind"), "ord", "text")


def _windows_sql(size: int, step: int) -> str:
    return f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents),
        c AS (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 1, {step})) AS i0 FROM w WHERE len(ws) > 0)
        SELECT doc_id AS doc, CAST(i0 // {step} AS INTEGER) AS chunk, array_to_string(ws[i0 + 1:i0 + {size}], ' ') AS text FROM c"""


@query("chunk_sliding_window", _windows_sql(SIZE, STEP))
def chunk_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(doc_words(spark, sf_dir), SIZE, STEP)


@query("chunk_fixed_words", _windows_sql(SIZE, SIZE))
def chunk_fixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.windows(doc_words(spark, sf_dir), SIZE, SIZE)


_ELEMENTS = """
    l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
    e AS (SELECT *, len(regexp_extract_all(text, '\\S+')) <= 4 AND NOT ends_with(text, '.') AS head FROM l)"""


@query("chunk_paragraph", f"""
    WITH {_ELEMENTS},
    h AS (SELECT *, last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord) AS section_heading FROM e),
    k AS (SELECT * FROM h WHERE head OR trim(text) <> '')
    SELECT doc, 1 AS page, CAST(row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS INTEGER) AS chunk,
           CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS content_type, section_heading, text FROM k""")
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_document(elements(spark, sf_dir), "paragraph", max_tokens=100_000)


@query("chunk_section", f"""
    WITH {_ELEMENTS},
    s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS seg FROM e),
    g AS (SELECT doc, seg, max(CASE WHEN head THEN text END) AS section_heading,
                 string_agg(text, chr(10) ORDER BY ord) FILTER (NOT head AND trim(text) <> '') AS body FROM s GROUP BY doc, seg)
    SELECT doc, 1 AS page, CAST(row_number() OVER (PARTITION BY doc ORDER BY seg) - 1 AS INTEGER) AS chunk, 'section' AS content_type, section_heading,
           CASE WHEN section_heading IS NULL THEN body ELSE section_heading || chr(10) || chr(10) || body END AS text
    FROM g WHERE body IS NOT NULL AND trim(body) <> ''""")
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_document(elements(spark, sf_dir), "section", max_tokens=100_000)


@query("chunk_paragraph_sentences")
def chunk_paragraph_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_document(elements(spark, sf_dir), "paragraph", max_tokens=60)


@query("chunk_sliding_elements", _windows_sql(SIZE, STEP).replace("AS chunk, array", "AS chunk, 1 AS page, 'window' AS content_type, NULL::VARCHAR AS section_heading, array"))
def chunk_sliding_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_document(elements(spark, sf_dir), "sliding_window")


@query("token_estimate", """
    WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
    SELECT doc_id AS doc, CAST(n * 13 // 10 AS BIGINT) AS n_tokens FROM w""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.token_estimate("text").alias("n_tokens"))


def chunks(spark, sf_dir) -> DataFrame:
    """Sliding windows with their source's filter columns."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.words("text").alias("words"), "lang", "source")
    return chunking.windows(docs, SIZE, STEP, "lang", "source").select(F.concat("doc", F.lit("_"), "chunk").alias("chunk_id"), "doc", "text", "lang", "source")


def queries_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_TOKEN = "'[\\p{L}\\p{N}]+'"
_BM25 = f"""
    w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '\\S+') AS ws FROM documents),
    c AS (SELECT *, unnest(generate_series(0, len(ws) - 1, {STEP})) AS i0 FROM w WHERE len(ws) > 0),
    d AS (SELECT doc_id || '_' || CAST(i0 // {STEP} AS INTEGER) AS chunk_id, lang, source, array_to_string(ws[i0 + 1:i0 + {SIZE}], ' ') AS text FROM c),
    k AS (SELECT *, regexp_extract_all(lower(text), {_TOKEN}) AS ts FROM d),
    t AS (SELECT chunk_id, lang, source, len(ts) AS dl, unnest(ts) AS term FROM k),
    p AS (SELECT chunk_id, lang, source, dl, term, count(*) AS tf FROM t GROUP BY ALL),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), {_TOKEN})) AS term FROM benchmark),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM k),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_PART = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _bm25_sql(where: str = "TRUE", k: int = 10) -> str:
    return f"""WITH {_BM25},
        s AS (SELECT query_id, chunk_id, round(sum({_PART}), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term), st WHERE {where} GROUP BY query_id, chunk_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= {k}"""


@query("bm25_topk", _bm25_sql())
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword(chunks(spark, sf_dir), queries_of(spark, sf_dir))


@query("bm25_filtered", _bm25_sql("lang = 'en' AND source IN ('src1', 'src2', 'src3')"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword(chunks(spark, sf_dir), queries_of(spark, sf_dir), by={"lang": "en", "source": ["src1", "src2", "src3"]})


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, sf_dir) -> DataFrame:
    """The stated query set: vectors of item numbers, one for each benchmark item."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return q.join(vectors(spark, sf_dir).withColumnRenamed("chunk_id", "query_id"), "query_id").select("query_id", "embedding")


_DOT = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
_KNN = f"s AS (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, e.label, {_DOT} AS score FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id, embeddings e)"


@query("knn_topk", f"WITH {_KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector(vectors(spark, sf_dir), vector_queries(spark, sf_dir))


@query("knn_filtered", f"WITH {_KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE label IN (1, 2)) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector(vectors(spark, sf_dir), vector_queries(spark, sf_dir), by={"label": [1, 2]})


@query("knn_post_filtered", f"WITH {_KNN}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10 AND label IN (1, 2)")
def knn_post_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector(vectors(spark, sf_dir), vector_queries(spark, sf_dir), by={"label": [1, 2]}, placement="post")


def _whole_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


_WHOLE = f"""
    k AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), {_TOKEN}) AS ts FROM documents),
    t AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM k),
    p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), {_TOKEN})) AS term FROM benchmark),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM k),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    ks AS (SELECT query_id, chunk_id, round(sum({_PART}), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY query_id, chunk_id)"""


@query("hybrid_topk", f"""
    WITH {_WHOLE}, {_KNN},
    u AS (SELECT query_id, chunk_id, score * 0.3 AS score FROM ks UNION ALL SELECT query_id, chunk_id, score * 0.7 FROM s),
    m AS (SELECT query_id, chunk_id, round(sum(score), 9) AS score FROM u GROUP BY query_id, chunk_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM m)
    SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and vectors are paired by equal numbers: a choice of this query, the tables do not say so."""
    return retrieval.search(_whole_docs(spark, sf_dir), vectors(spark, sf_dir), queries_of(spark, sf_dir), vector_queries(spark, sf_dir), "hybrid")


_RRF = f"""
    WITH {_WHOLE}, {_KNN},
    a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 0 AS l FROM ks),
    b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 1 AS l FROM s),
    u AS (SELECT * FROM a WHERE rank <= 30 UNION ALL SELECT * FROM b WHERE rank <= 30),
    m AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (rank - 1 + 60)), 9) AS score, min(l * 1000 + rank) AS seen FROM u GROUP BY query_id, chunk_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS INTEGER) AS rank FROM m)"""


def _rrf(spark, sf_dir, k: int = 10) -> DataFrame:
    n = retrieval.fetch_size(k)
    return retrieval.rrf(retrieval.keyword(_whole_docs(spark, sf_dir), queries_of(spark, sf_dir), n), retrieval.vector(vectors(spark, sf_dir), vector_queries(spark, sf_dir), n), k)


@query("rrf_topk", _RRF + " SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10")
def rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rrf(spark, sf_dir)


_ANSWER = """, f AS (SELECT query_id, rank, chunk_id, score, text FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
    x AS (SELECT query_id, string_agg('[' || rank || '] ' || chunk_id || ': ' || substr(text, 1, 200), chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY query_id),
    an AS (SELECT query_id, array_to_string(string_split(context, chr(10) || chr(10))[1:3], chr(10) || chr(10)) AS answer FROM x)"""


def _answers(spark, sf_dir, results: DataFrame) -> DataFrame:
    c = retrieval.context(results, _whole_docs(spark, sf_dir))
    return c.select("query_id", providers.ExtractiveGenerator().answer(F.lit(""), F.col("context")).alias("answer"))


@query("rag_confidence", _RRF + _ANSWER + """, z AS (SELECT * FROM r WHERE rank <= 10), g AS (SELECT query_id, max(score) AS top_score FROM z GROUP BY query_id),
    h AS (SELECT query_id, top_score, count(*) FILTER (score > top_score * 0.5) AS strong FROM z JOIN g USING (query_id) GROUP BY query_id, top_score)
    SELECT query_id, top_score, strong, CASE WHEN contains(lower(answer), 'could not find') OR contains(lower(answer), 'no information') OR contains(lower(answer), 'unclear') OR contains(lower(answer), 'not specified') THEN 'low'
        WHEN top_score > 0.03 AND strong >= 3 THEN 'high' WHEN top_score > 0.02 AND strong >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM an JOIN h USING (query_id)""")
def rag_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _rrf(spark, sf_dir)
    return retrieval.confidence(results, _answers(spark, sf_dir, results))


@query("rag_warnings", _RRF + _ANSWER + " SELECT query_id, bool_or(contains(lower(text), 'tbd')) AS open_items, bool_or(contains(lower(answer), 'shall')) AS contractual FROM f JOIN an USING (query_id) GROUP BY query_id")
def rag_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _rrf(spark, sf_dir)
    return retrieval.warnings(results.join(_whole_docs(spark, sf_dir), "chunk_id"), _answers(spark, sf_dir, results))


class Unsteady(providers.ExtractiveGenerator):
    """Fails on questions whose length is divisible by 3."""

    def answer(self, question, context):
        return F.when(F.length(question) % 3 != 0, super().answer(question, context))


@query("ask", _RRF + """, f AS (SELECT query_id, rank, chunk_id, score, text FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
    x AS (SELECT query_id, string_agg('[' || rank || '] ' || chunk_id || ': ' || substr(text, 1, 200), chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_passages, bool_or(contains(lower(text), 'tbd')) AS open_items, max(score) AS top_score FROM f GROUP BY query_id),
    an AS (SELECT x.*, length(b.text) % 3 <> 0 AS generated, array_to_string(string_split(context, chr(10) || chr(10))[1:3], chr(10) || chr(10)) AS first FROM x JOIN benchmark b ON item_id = query_id),
    y AS (SELECT *, CASE WHEN generated THEN first ELSE 'I encountered an error generating a synthesized answer. Here are the most relevant passages:' || chr(10) || chr(10) || first || chr(10) || chr(10) END AS answer FROM an),
    h AS (SELECT f.query_id, count(*) FILTER (f.score > top_score * 0.5) AS strong FROM f JOIN x USING (query_id) GROUP BY f.query_id)
    SELECT query_id, answer, generated, CASE WHEN contains(lower(answer), 'could not find') OR contains(lower(answer), 'no information') OR contains(lower(answer), 'unclear') OR contains(lower(answer), 'not specified') THEN 'low'
        WHEN top_score > 0.03 AND strong >= 3 THEN 'high' WHEN top_score > 0.02 AND strong >= 2 THEN 'medium' ELSE 'low' END AS confidence, n_passages, open_items, contains(lower(answer), 'shall') AS contractual, NULL::VARCHAR AS warning FROM y JOIN h USING (query_id)""")
def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all benchmark texts by a generator that fails on some of them."""
    return collection.answer(_rrf(spark, sf_dir), _whole_docs(spark, sf_dir), queries_of(spark, sf_dir), Unsteady())


def indexed(spark: SparkSession, sf_dir: str) -> collection.Collection:
    """The documents under three configurations; those of even number are ingested a second time."""
    made = collection.Collection(Tables(spark, scratch(spark, "collection")), [
        collection.Configuration("paragraph 64", "paragraph", {"max_tokens": 100_000}), collection.Configuration("section 64", "section", {"max_tokens": 100_000}), collection.Configuration("window 32", "sliding_window", {}, providers.HashingEmbedder(32)),
    ])
    rows = elements(spark, sf_dir).withColumn("title", F.concat(F.lit("Document "), "doc"))
    made.ingest(rows)
    made.ingest(rows.where("doc % 2 = 0"))
    return made


@query("ingest_configurations", f"""WITH {_ELEMENTS},
    s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS seg FROM e),
    g AS (SELECT doc, seg, string_agg(text, chr(10) ORDER BY ord) FILTER (NOT head AND trim(text) <> '') AS body FROM s GROUP BY doc, seg),
    w AS (SELECT doc_id AS doc, unnest(generate_series(0, len(regexp_extract_all(text, '\\S+')) - 1, {STEP})) AS i0 FROM documents),
    a AS (SELECT 'icd_paragraph_64' AS "index", doc FROM e WHERE head OR trim(text) <> '' UNION ALL SELECT 'icd_section_64', doc FROM g WHERE body IS NOT NULL AND trim(body) <> '' UNION ALL SELECT 'icd_window_32', doc FROM w)
    SELECT "index", count(*) AS n_chunks, count(DISTINCT doc) AS n_docs, 64 - 32 * CAST("index" = 'icd_window_32' AS INTEGER) AS dims FROM a GROUP BY "index" """)
def ingest_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and documents of each configuration's index after the second ingest has replaced a part of the first."""
    made = indexed(spark, sf_dir)
    parts = [made.chunks(c).agg(F.count("*").alias("n_chunks"), F.count_distinct("document_hash").alias("n_docs"), F.max(F.size("embedding")).alias("dims")).withColumn("index", F.lit(c.index)) for c in made.configurations]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("rag_context", _RRF + """, f AS (SELECT query_id, rank, chunk_id, score, substr(text, 1, 200) AS t FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 10)
    SELECT query_id, string_agg('[' || rank || '] ' || chunk_id || ': ' || t, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_passages, max(score) AS top_score FROM f GROUP BY query_id""")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.context(_rrf(spark, sf_dir), _whole_docs(spark, sf_dir))


_JUDGE = """, f AS (SELECT r.query_id, rank, lower(d.text) AS t, lower(substr(b.text, 1, CAST(length(b.text) // 2 AS BIGINT))) AS w1, lower(substr(b.text, CAST(length(b.text) // 2 + 1 AS BIGINT))) AS w2
             FROM r JOIN documents d ON d.doc_id = r.chunk_id JOIN benchmark b ON b.item_id = r.query_id WHERE rank <= 10),
    g AS (SELECT *, contains(t, w1) AS h1, contains(t, w2) AS h2 FROM f),
    m1 AS (SELECT query_id, CAST(max(h1::INT) + max(h2::INT) AS DOUBLE) / 2 AS recall, coalesce(1.0::DOUBLE / min(CASE WHEN h1 OR h2 THEN rank END), 0) AS reciprocal_rank,
                 sum(CASE WHEN h1 OR h2 THEN 1 / log2(rank + 1.0) ELSE 0 END) / (1 + 1 / log2(3.0)) AS n, bool_or(h1 OR h2) AS hit FROM g GROUP BY query_id),
    mm AS (SELECT item_id AS query_id, coalesce(recall, 0) AS recall, coalesce(reciprocal_rank, 0) AS reciprocal_rank, coalesce(n, 0) AS n, coalesce(hit, false) AS hit FROM benchmark LEFT JOIN m1 ON query_id = item_id)"""


def _judged(spark, sf_dir) -> DataFrame:
    """Both halves of a benchmark text are wanted; a query without hits counts with zeros."""
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))).alias("relevant_texts"))


def _metrics(spark, sf_dir) -> DataFrame:
    return evaluate.score_queries(_rrf(spark, sf_dir).join(_whole_docs(spark, sf_dir), "chunk_id"), _judged(spark, sf_dir))


@query("retrieval_metrics", _RRF + _JUDGE + " SELECT query_id, recall, reciprocal_rank, round(n, 9) AS ndcg_raw, round(least(n, 1.0), 9) AS ndcg_capped, hit FROM mm")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query("retrieval_summary", _RRF + _JUDGE + " SELECT 'rrf' AS mode, round(avg(recall), 9) AS mean_recall, round(avg(reciprocal_rank), 9) AS mean_mrr, round(avg(round(n, 9)), 9) AS mean_ndcg_raw, round(avg(hit::INT), 9) AS hit_rate, count(*) AS n_queries FROM mm")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.aggregate(_metrics(spark, sf_dir).withColumn("mode", F.lit("rrf")), "mode")


@query("latency_percentiles", """
    SELECT event_type AS mode, list_sort(list(value))[count(*) // 2 + 1] AS p50_ms, list_sort(list(value))[least(CAST(trunc(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95_ms FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picked(table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), "value"), ["mode"], "value", {"p50_ms": 0.5, "p95_ms": 0.95})
