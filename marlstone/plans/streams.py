"""Queries on sources, streams, providers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, providers, report
from ..sources import ir, shapes
from ..streaming import events
from .base import query, table
from .documents import scanned, _items_cte
from .fixture import CTE, icd_documents
from .pages import actions


#: Events with the batch they arrive in, and for each row the latest time that earlier batches have brought, in SQL.
_ARRIVED = """
    q AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) + (event_id * 7919) % 7200 AS came FROM events),
    b AS (SELECT * EXCLUDE (came), (4 * (came - (SELECT min(came) FROM q))) // ((SELECT max(came) FROM q) - (SELECT min(came) FROM q) + 1) AS batch FROM q),
    m AS (SELECT x.batch, max(y.ts) AS mark FROM (SELECT DISTINCT batch FROM b) x LEFT JOIN (SELECT batch, max(ts) AS ts FROM b GROUP BY batch) y ON y.batch < x.batch GROUP BY x.batch),
    a AS (SELECT b.*, m.mark FROM b JOIN m USING (batch))"""


def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.arrivals(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("stream_tumbling", f"""WITH {_ARRIVED}
    SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n, round(sum(value), 4) AS v FROM a
    WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark - INTERVAL 30 MINUTE
    GROUP BY w, event_type HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed after four batches out of order, without rows that came too late."""
    return events.run_batches(arrived(spark, sf_dir), lambda s: events.tumbling(s, late="30 minutes"), "tumbling")


@query("stream_late", f"""WITH {_ARRIVED} SELECT event_id, ts, user_id FROM a WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark - INTERVAL 30 MINUTE""")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stream_tumbling has to leave out."""
    return events.late_rows(arrived(spark, sf_dir), F.date_trunc("hour", "ts") + F.expr("interval 1 hour"), "30 minutes").select("event_id", "ts", "user_id")


@query("stream_sliding", f"""WITH {_ARRIVED}, s AS (SELECT *, date_trunc('hour', ts) AS w FROM a UNION ALL SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR FROM a)
    SELECT w, count(*) AS n FROM s WHERE mark IS NULL OR w + INTERVAL 2 HOUR > mark - INTERVAL 30 MINUTE
    GROUP BY w HAVING w + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.run_batches(arrived(spark, sf_dir), lambda s: events.sliding(s, late="30 minutes"), "sliding")


@query("stream_sessions", """WITH l AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR AS n FROM events), s AS (SELECT *, sum(coalesce(n, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
    SELECT user_id, min(ts) AS w_start, max(ts) + INTERVAL 6 HOUR AS w_end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of six hours' gap that the watermark has closed; three hours' delay lets nothing be late."""
    return events.run_batches(arrived(spark, sf_dir), lambda s: events.sessions(s, "6 hours", "3 hours"), "sessions")


@query("stream_interval_join", """SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, b.event_id AS b_id, b.ts AS b_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR
    WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the purchases of the same user within twelve hours, as a join of two streams that come out of order."""
    return events.run_batches(arrived(spark, sf_dir), lambda s: events.followed(s.where("event_type = 'click'"), s.where("event_type = 'purchase'"), "user_id", "12 hours", "3 hours"), "followed")


@query("stream_journal")
def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equals journal_state; a test holds one against the other."""
    e = events.stream(spark, sf_dir)
    a = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit").alias("action"))
    out = events.run_to_table(events.journal(a), "journal", "update")
    return out.groupBy("session").agg(F.max_by("applied", "last_seq").alias("applied"), F.max_by("undone", "last_seq").alias("undone"))


_TAGS = " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, unnest(regexp_extract_all(h, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1)) AS x FROM b" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td"))


@query("html_elements", f"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g') AS h FROM pages), t AS ({_TAGS}),
    c AS (SELECT page_id, tag, trim(regexp_replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS x FROM t)
    SELECT page_id AS doc, tag, count(*) AS n FROM c WHERE x <> '' GROUP BY ALL""")
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each page by their tag."""
    return ir.html_elements(table(spark, sf_dir, "pages")).groupBy("doc", "tag").agg(F.count("*").alias("n"))


@query("html_section_chunks")
def html_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ir.html_elements(table(spark, sf_dir, "pages"))
    return chunking.chunk_document(e.select("doc", F.lit(1).alias("page"), F.col("ord").cast("double").alias("y"), "kind", "ord", "text"), "section")


@query("hash_embeddings")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", providers.HashingEmbedder().embed(F.col("text")).alias("embedding"))


@query("report_requirements_markdown", f"WITH {CTE}, {_items_cte('t')}, c AS (SELECT item_type, count(*) AS n FROM t GROUP BY item_type) SELECT '# Open items' || chr(10) || chr(10) || '| item_type | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || item_type || ' | ' || n || ' |', chr(10) ORDER BY item_type) AS report FROM c")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown(scanned(spark, sf_dir).groupBy("item_type").agg(F.count("*").alias("n")), ["item_type", "n"], ["item_type"], "Open items")


@query("export_items_csv", f"WITH {CTE}, {_items_cte('t')}, c AS (SELECT item_type, owner, count(*) AS n FROM t GROUP BY ALL) SELECT 'item_type,owner,n' || chr(10) || string_agg('\"' || item_type || '\",\"' || coalesce(owner, '') || '\",\"' || n || '\"', chr(10) ORDER BY item_type) AS csv FROM c")
def export_items_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.csv_text(scanned(spark, sf_dir).groupBy("item_type", "owner").agg(F.count("*").alias("n")), ["item_type", "owner", "n"], ["item_type"])


@query("journal_actions", "SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS action FROM events")
def journal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).select("session", "seq", "action")


def _page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the fixture as JSON: documents of even number in the form with typed blocks, odd ones with headings apart, and page 9 broken off."""
    b = icd_documents(spark, sf_dir).withColumn("heading", F.col("k").isin(4, 11))
    real = F.struct(F.when(F.col("heading"), "heading").otherwise("paragraph").alias("block_type"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text_verbatim"), F.struct(F.col("y0").alias("y0")).alias("bbox"))
    test = F.struct("text", F.col("y0").alias("y"), F.when(F.col("heading"), F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\s", 1)).alias("section_number"))
    ordered = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", c.alias("b"))))), lambda x: x["b"])
    odd = F.col("doc") % 2 == 1
    g = b.groupBy("doc", "page").agg(ordered(real, ~odd).alias("real"), ordered(test, odd & F.col("heading")).alias("headings"), ordered(test, odd & ~F.col("heading")).alias("texts"))
    body = F.when(odd, F.to_json(F.struct(F.col("page").alias("page_number"), "headings", F.col("texts").alias("text_blocks")))).otherwise(F.to_json(F.struct(F.col("page").alias("page_number"), F.col("real").alias("text_blocks"))))
    return g.select("doc", "page", F.when(F.col("page") == 9, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body).alias("text"))


@query("page_shapes", f"""WITH {CTE} SELECT doc, page, CASE WHEN k IN (4, 11) THEN 'heading' ELSE 'text' END AS kind, row_number() OVER (PARTITION BY doc, page, k IN (4, 11) ORDER BY ord) - 1 AS ord, y0 AS y, text,
    CASE WHEN k IN (4, 11) THEN nullif(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\s', 1), '') END AS section_number FROM icdr WHERE page <> 9""")
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and texts of pages in two forms, alike; an odd document's page without headings and with headings only are both plain."""
    good, _ = shapes.parse(_page_json(spark, sf_dir))
    return shapes.elements(good.select("doc", "v"), "v", "doc").withColumn("ord", F.col("ord").cast("long"))


@query("page_shapes_rejected", f"WITH {CTE} SELECT DISTINCT doc, page FROM icdr WHERE page = 9")
def page_shapes_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.parse(_page_json(spark, sf_dir))[1].select("doc", "page")


@query("vector_shapes", "SELECT vec_id, vec_id % 8 AS shape, CASE WHEN vec_id % 8 < 7 THEN CAST(embedding AS DOUBLE[]) END AS embedding FROM embeddings")
def vector_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of answers of seven shapes; the eighth has none."""
    e, shape = F.col("embedding"), F.col("vec_id") % 8
    forms = [
        F.struct(e.alias("embedding")), F.struct(F.array(e).alias("embeddings")), F.struct(e.alias("embeddings")), F.struct(F.struct(F.array(e).alias("float")).alias("embeddings")),
        F.struct(F.lit("x").alias("embedding"), e.alias("vector")), F.struct(F.struct(F.array(e).alias("int8")).alias("embeddings")), F.struct(F.array().cast("array<float>").alias("embeddings"), e.alias("output")), F.struct(F.array(F.lit("a")).alias("data")),
    ]
    text = F.coalesce(*[F.when(shape == k, F.to_json(f)) for k, f in enumerate(forms)])
    good, _ = shapes.parse(table(spark, sf_dir, "embeddings").select("vec_id", shape.alias("shape"), text.alias("text")))
    return good.select("vec_id", "shape", F.transform(shapes.vector(F.col("v")), lambda x: x.cast("float").cast("double")).alias("embedding"))


@query("search_answers", """SELECT l_orderkey AS query_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_linestatus) AS INTEGER) AS rank, CASE WHEN l_linenumber % 2 = 0 THEN 'c' || l_partkey ELSE 'h' || l_linenumber END AS chunk_id,
    CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS text, CAST(l_quantity AS DOUBLE) AS score, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_linenumber END AS page_number, CASE WHEN l_linenumber % 5 = 0 THEN 'table' ELSE 'paragraph' END AS content_type,
    l_orderkey % 100 AS took_ms, count(*) OVER (PARTITION BY l_orderkey) AS total_hits FROM lineitem""")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer of a search service for each order, its lines as hits with fields missing here and there, read back as rows."""
    n = F.col("l_linenumber")
    source = F.struct(F.when(n % 2 == 0, F.concat(F.lit("c"), "l_partkey")).alias("chunk_id"), F.when(n % 3 != 0, F.col("l_linestatus")).alias("text"), F.when(n % 4 != 0, n).alias("page_number"), F.when(n % 5 == 0, "table").alias("content_type"))
    hit = F.struct(F.concat(F.lit("h"), n).alias("_id"), F.col("l_quantity").cast("double").alias("_score"), source.alias("_source"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_linestatus", hit.alias("h")))), lambda x: x["h"]).alias("hits"))
    answer = F.to_json(F.struct((F.col("l_orderkey") % 100).alias("took"), F.struct(F.struct(F.col("n").alias("value")).alias("total"), "hits").alias("hits")))
    good, _ = shapes.parse(g.select(F.col("l_orderkey").alias("query_id"), answer.alias("text")))
    good = good.select("query_id", "v", shapes.search_totals(F.col("v")).alias("t"))
    hits = shapes.search_hits(good.select("query_id", "v", "t.took_ms", "t.total_hits"), "v", "query_id", "took_ms", "total_hits")
    return hits.select("query_id", "rank", "chunk_id", "text", "score", "page_number", "content_type", "took_ms", "total_hits")
