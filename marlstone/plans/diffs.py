"""Queries on sections from lines, summaries, lists and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diffs, evaluate, listing, requirements, versions
from .base import ORACLES, query, table
from .documents import _FILES, _FIRST, _SEC, _items_cte, files, scanned, sections
from .fixture import CTE, icd_documents
from .search import _JUDGE, _RRF, _judged, _rrf, _whole_docs

_NO = " OR ".join(f"regexp_matches(line, '{p}')" for p in diffs.NO_HEADING)
_LIST = lambda v: ", ".join(f"'{x}'" for x in v)


@query("line_sections", f"""WITH {CTE}, l AS (SELECT *, trim(text) AS line FROM icdr WHERE trim(text) <> ''),
    h AS (SELECT *, CASE WHEN {_NO} THEN false WHEN regexp_matches(line, '{diffs.NUMBERED}') AND length(line) < 80 THEN true WHEN regexp_matches(line, '{diffs.CAPITALS}') AND length(line) < 60 THEN line NOT IN ({_LIST(diffs.COLUMN_LABELS)})
        WHEN line IN ({_LIST(diffs.HEADING_WORDS)}) THEN true ELSE font_size > 14 AND length(line) < 80 AND regexp_matches(line, '[A-Za-z]{{3,}}') AND NOT regexp_matches(line, '^(NUMBER|CROSS|RETRO|HEMI)') END AS h FROM l),
    s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc ORDER BY page, ord) AS seg FROM h)
    SELECT doc, CAST(seg AS BIGINT) AS seg, coalesce(max(CASE WHEN h THEN line END), 'Preamble') AS heading, coalesce(max(CASE WHEN h THEN page END), 1) AS page, string_agg(line, chr(10) ORDER BY page, ord) FILTER (NOT h) AS text FROM s GROUP BY doc, seg HAVING count(*) FILTER (NOT h) > 0""")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.line_sections(icd_documents(spark, sf_dir))


@query("paragraph_changes")
def paragraph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of two revisions, a block a line. Python's difflib has no counterpart in SQL; a test holds it against another way."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda x: x["text"]), "\n")
    docs = icd_documents(spark, sf_dir).withColumn("d", F.floor(F.col("doc") / 32))
    side = lambda r, c: docs.where(F.col("rev") == r).groupBy("d", "section").agg(lines.alias(c))
    rows = side("A", "old").join(side("N", "new"), ["d", "section"]).withColumn("x", diffs.paragraph_changes("old", "new"))
    return rows.select(F.col("d").alias("doc"), "section", "x.added", "x.removed", "x.modified", F.array_join("x.snippets", " | ").alias("snippets"))


def _plain(p: str) -> str:
    return f"CASE WHEN {p} = 1 THEN '' ELSE 's' END"


@query("summary_lines", f"""WITH {CTE}, {_SEC}, d AS (SELECT doc, classification, count(*) FILTER (classification = 'technical' AND has_requirement_change) AS v, count(*) FILTER (change_type = 'removed' AND contains(lower(old_text), 'tbd')) AS r, count(*) FILTER (has_tbd_change) AS i, count(*) FILTER (change_type = 'modified') AS m FROM s GROUP BY doc, classification)
    SELECT doc, classification, CASE WHEN v + r + i > 0 THEN concat_ws(', ', CASE WHEN v > 0 THEN v || ' value' || {_plain('v')} || ' changed' END, CASE WHEN r > 0 THEN r || ' TBD' || {_plain('r')} || ' resolved' END, CASE WHEN i > 0 THEN i || ' TBD' || {_plain('i')} || ' introduced' END)
        WHEN m > 0 THEN m || ' paragraph' || {_plain('m')} || ' modified' ELSE classification || ' changes' END AS line FROM d""")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = versions.compare_sections(sections(spark, sf_dir, "A"), sections(spark, sf_dir, "N"), "doc")
    n = s.groupBy("doc", "classification").agg(
        F.count_if((F.col("classification") == "technical") & F.col("has_requirement_change")).alias("v"), F.count_if((F.col("change_type") == "removed") & F.contains(F.lower("old_text"), F.lit("tbd"))).alias("r"),
        F.count_if("has_tbd_change").alias("i"), F.count_if(F.col("change_type") == "modified").alias("m"),
    )
    return n.select("doc", "classification", diffs.summary_line(*map(F.col, ("v", "r", "i", "m", "classification"))).alias("line"))


@query("section_items")
def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the sections that lines make; the tests hold the operator against a plain scan of each text."""
    return diffs.section_items(diffs.line_sections(icd_documents(spark, sf_dir)).withColumnRenamed("seg", "section"))


_HEAD = """, fp AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY page) AS pg, row_number() OVER (PARTITION BY doc ORDER BY page, ord) AS nth FROM icdr)"""


@query("document_summary", f"""WITH {CTE}, {_items_cte('t')}{_HEAD}, h AS (SELECT doc, string_agg(text, ' ' ORDER BY ord) AS text FROM fp WHERE pg = 1 AND nth <= 10 GROUP BY doc),
    n AS (SELECT doc, count(*) FILTER (item_type = 'TBD') AS tbd, count(*) FILTER (item_type <> 'TBD') AS tbr FROM t GROUP BY doc), c AS (SELECT doc, count(DISTINCT page) AS page_count FROM icdr GROUP BY doc)
    SELECT doc, {_FIRST('[Rr]ev(?:ision)?[\\s.:]*([A-Z])\\b', '[Rr]ev(?:ision)?[\\s.:]*(\\d+)', '[Vv]ersion[\\s.:]*(\\d+(?:\\.\\d+)*)')} AS revision, {_FIRST('(\\w+ \\d{4})', '(\\d{4}-\\d{2}-\\d{2})', '(\\d{2}/\\d{2}/\\d{4})')} AS date,
    page_count, coalesce(tbd, 0) AS tbd_count, coalesce(tbr, 0) AS tbr_count, 'digital' AS doc_type FROM c JOIN h USING (doc) LEFT JOIN n USING (doc)""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.document_summary(icd_documents(spark, sf_dir), scanned(spark, sf_dir))


@query("briefing_totals", f"""WITH {CTE}, {_items_cte('t')}, c AS (SELECT doc, count(DISTINCT page) AS page_count FROM icdr GROUP BY doc)
    SELECT (SELECT count(*) FROM c) AS documents, (SELECT CAST(sum(page_count) AS BIGINT) FROM c) AS pages, count(*) FILTER (item_type = 'TBD') AS tbds, count(*) FILTER (item_type <> 'TBD') AS tbrs, 0 AS flattened FROM t""")
def briefing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.briefing(document_summary(spark, sf_dir))


@query("document_titles", f"""WITH {CTE}{_HEAD}, c AS (SELECT doc, trim(text) AS t, nth FROM fp WHERE pg = 1 AND nth <= 8), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY length(t) DESC, nth) AS n FROM c WHERE length(t) > 5 AND length(t) < 200)
    SELECT d.doc, coalesce(t, '') AS title FROM (SELECT DISTINCT doc FROM icdr) d LEFT JOIN r ON r.doc = d.doc AND n = 1""")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.document_title(icd_documents(spark, sf_dir))


@query("search_terms", f"""WITH {_FILES}, n AS (SELECT p_partkey, st, replace(regexp_replace(st, '_?rev[a-z]$', '', 'i'), '_', ' ') AS num, CASE WHEN p_partkey % 3 = 0 THEN upper(st) ELSE 'Title of ' || st END AS title FROM g),
    t AS (SELECT p_partkey, list_filter([nullif(num, ''), nullif(replace(num, '_', ' '), ''), nullif(replace(num, '_', '-'), ''), CASE WHEN length(st) > 3 THEN replace(replace(st, '_', ' '), '-', ' ') END, CASE WHEN length(title) > 10 THEN substr(title, 1, 80) END], lambda x: x IS NOT NULL) AS a FROM n),
    u AS (SELECT p_partkey, unnest(a) AS term, unnest(range(len(a))) AS i FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(trim(term)) ORDER BY i) AS k FROM u)
    SELECT p_partkey, string_agg(term, '|' ORDER BY i) AS terms FROM r WHERE k = 1 AND length(trim(term)) >= 3 GROUP BY p_partkey""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = T.stem("filename")
    title = F.when(F.col("p_partkey") % 3 == 0, F.upper(st)).otherwise(F.concat(F.lit("Title of "), st))
    return files(spark, sf_dir).select("p_partkey", F.array_join(diffs.search_terms(st, title, T.document_number("filename")), "|").alias("terms"))


_PAGE = "SELECT doc, page, string_agg(text, chr(10) ORDER BY ord) AS text FROM icdr GROUP BY doc, page"


def _pages(spark, sf_dir) -> DataFrame:
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return icd_documents(spark, sf_dir).groupBy("doc", "page").agg(t.alias("text"))


@query("split_blocks", f"""WITH {CTE}, p AS ({_PAGE}), l AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM p),
    s AS (SELECT *, sum((i > 0 AND regexp_matches(line, '^[A-Z0-9]+(\\.[0-9]+)+\\.?\\s+\\S'))::INT) OVER (PARTITION BY doc, page ORDER BY i) AS part FROM l)
    SELECT doc, page, CAST(part AS INTEGER) AS part, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY doc, page, part""")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc", "page", F.posexplode(diffs.split_on_headings(F.col("text"))).alias("part", "text"))


@query("reference_pages", f"WITH {CTE}, p AS ({_PAGE}) SELECT doc, page FROM p WHERE regexp_matches(lower(text), '(applicable|reference|referenced)\\s+documents?') OR regexp_matches(lower(text), 'documents?\\s+(applicable|referenced)') OR regexp_matches(lower(text), 'refer to section')")
def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return diffs.reference_pages(p.withColumn("text", F.regexp_replace("text", "Refer to Section", "Reference documents of"))).select("doc", "page")


@query("pages_with_text", f"WITH {CTE}, p AS ({_PAGE}) SELECT doc, length(trim(arg_min(text, page))) > 10 AS has_text FROM p GROUP BY doc")
def pages_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.has_text(_pages(spark, sf_dir))


@query("table_cells", """WITH b AS (SELECT p_partkey AS block_id, list_filter(string_split(p_name, ' '), lambda x: trim(x) <> '')[1:CAST(p_size % 5 + 1 AS BIGINT)] AS l, (p_size % 3) * 10.0::DOUBLE AS x0, 100.0::DOUBLE AS y0, 200.0::DOUBLE AS x1, 160.0::DOUBLE AS y1 FROM part),
    c AS (SELECT *, len(l) AS k, len(l) >= 4 AND len(l) % 2 = 0 AS two FROM b), u AS (SELECT *, unnest(l) AS text, CAST(unnest(range(len(l))) AS INTEGER) AS n FROM c WHERE k >= 2),
    y AS (SELECT *, y0 + CASE WHEN two THEN n // 2 * (60.0::DOUBLE / (k / 2)) ELSE n * (60.0::DOUBLE / k) END + 2 AS ty FROM u)
    SELECT block_id, n, text, CASE WHEN two AND n % 2 = 1 THEN (x0 + x1) / 2 + 3 ELSE x0 + 3 END AS x0, ty AS y0, CASE WHEN two AND n % 2 = 0 THEN (x0 + x1) / 2 - 3 ELSE x1 - 3 END AS x1, ty + 12 AS y1 FROM y
    UNION ALL SELECT block_id, 0, coalesce(array_to_string(l, chr(10)), ''), x0, y0, x1, y1 FROM c WHERE k < 2""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_join(F.slice(F.split("p_name", " "), F.lit(1), (F.col("p_size") % 5 + 1).cast("int")), "\n")
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("block_id"), lines.alias("text"), ((F.col("p_size") % 3) * 10.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(160.0).alias("y1"))
    return diffs.table_cells(b)


@query("index_configurations", """SELECT name, model_id, dims, strategy, max_tokens, overlap, cost_per_1k_tokens, index_name FROM (VALUES
    ('titan-v2-paragraph', 'amazon.titan-embed-text-v2:0', 1024, 'paragraph', 512, 0, 0.0001::DOUBLE, 'icd-titan-embed-text-v2-paragraph-1024d'), ('titan-v2-section', 'amazon.titan-embed-text-v2:0', 1024, 'section', 1024, 0, 0.0001, 'icd-titan-embed-text-v2-section-1024d'),
    ('titan-v2-sliding', 'amazon.titan-embed-text-v2:0', 1024, 'sliding_window', 256, 64, 0.0001, 'icd-titan-embed-text-v2-sliding_window-1024d'), ('cohere-en-paragraph', 'cohere.embed-english-v3', 1024, 'paragraph', 512, 0, 0.0001, 'icd-embed-english-v3-paragraph-1024d'))
    t(name, model_id, dims, strategy, max_tokens, overlap, cost_per_1k_tokens, index_name)""")
def index_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.configurations(spark)


@query("model_configurations", """SELECT lower(r_name) || '-' || s AS name, 'vendor.' || lower(r_name) || ':0' AS model_id, CASE WHEN r_regionkey = 0 THEN 1024 ELSE CAST(r_regionkey * 256 AS INTEGER) END AS dims, s AS strategy,
    least(CASE WHEN r_regionkey = 2 THEN 512 ELSE CAST(r_regionkey * 400 + 100 AS INTEGER) END, 1024) AS max_tokens, 0.0001::DOUBLE AS cost_per_1k_tokens FROM region, (VALUES ('paragraph'), ('section'), ('sliding_window')) v(s)""")
def model_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey").cast("int")
    m = table(spark, sf_dir, "region").select(F.concat(F.lit("vendor."), F.lower("r_name"), F.lit(":0")).alias("model_id"), (k * 256).alias("dims"), F.when(k != 2, k * 400 + 100).alias("max_tokens"), F.lit(None).cast("double").alias("cost_per_1k_tokens"))
    return listing.model_configurations(m)


@query("page_ranges", """WITH s AS (SELECT s_suppkey, s_suppkey % 7 + 1 AS a, s_suppkey % 7 + 1 + s_suppkey % 4 AS b, s_suppkey % 30 AS c FROM supplier)
    SELECT s_suppkey, array_to_string(CASE WHEN s_suppkey % 5 = 0 THEN range(1, 13) ELSE list_filter(list_concat(range(a, b + 1), [c]), lambda p: p BETWEEN 1 AND 12) END, ',') AS pages FROM s""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    spec = F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 1 + k % 4).cast("string"), F.lit(", "), (k % 30).cast("string"))
    pages = listing.page_range(F.when(k % 5 != 0, spec), F.lit(12))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query("cost_estimate", """WITH c AS (SELECT p_partkey AS doc, p_size * 0.0015::DOUBLE AS textract_text, p_size % 4 * 0.015::DOUBLE AS textract_tables, p_size % 3 * 0.001::DOUBLE AS rekognition, p_size * 0.000085::DOUBLE AS bedrock_classify, greatest(1, floor(p_size * 0.05::DOUBLE)) * 0.00525::DOUBLE AS bedrock_disambiguate FROM part)
    SELECT *, textract_text + textract_tables + rekognition + bedrock_classify + bedrock_disambiguate AS total FROM c""".replace("SELECT *,", "SELECT doc, round(textract_text, 9) AS textract_text, round(textract_tables, 9) AS textract_tables, round(rekognition, 9) AS rekognition, round(bedrock_classify, 9) AS bedrock_classify, round(bedrock_disambiguate, 9) AS bedrock_disambiguate,").replace("+ bedrock_disambiguate AS total", "+ bedrock_disambiguate AS t0").replace("SELECT doc, round", "SELECT * REPLACE (round(total, 6) AS total) FROM (SELECT doc, round").replace("AS t0 FROM c", "AS total FROM c)"))
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.col("p_size").alias("pages"), (F.col("p_size") % 4).alias("tables"), (F.col("p_size") % 3).alias("diagrams"))
    out = listing.cost_estimate(p)
    return out.select("doc", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("doc", "total")], F.round("total", 6).alias("total"))


@query("evaluation_suite", "SELECT CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'buildings' WHEN contains(c_mktsegment, 'I') THEN 'others with an I' ELSE '_other' END AS document, count(*) AS n FROM customer GROUP BY 1")
def evaluation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("query_id"))
    return listing.suite(q, {"BUILD": "buildings", "I": "others with an I"}).groupBy("document").agg(F.count("*").alias("n"))


@query("document_list", f"WITH {_FILES} SELECT filename, pages FROM g WHERE contains(lower(filename), 'rev')")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.document_list(files(spark, sf_dir), "Rev", ascending=False).select("filename", "pages")


@query("related_versions", f"WITH {_FILES} SELECT CAST(a.p_partkey AS VARCHAR) AS path, a.family, CAST(b.p_partkey AS VARCHAR) AS other, b.filename AS other_filename FROM g a JOIN g b ON a.family = b.family AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 100 = 0")
def related_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked about: every hundredth file, against all."""
    f = files(spark, sf_dir).withColumn("path", F.col("p_partkey").cast("string"))
    return listing.related_versions(f, f.where("p_partkey % 100 = 0"))


@query("newer_versions", f"WITH {_FILES}, v AS (SELECT family, filename, row_number() OVER (PARTITION BY family ORDER BY revision, filename, p_partkey) AS ord, row_number() OVER (PARTITION BY family ORDER BY revision, filename, p_partkey) = 2 AS chosen FROM g) SELECT family, filename, ord FROM v WHERE ord > 2")
def newer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("family").orderBy("revision", "filename", "p_partkey")
    v = files(spark, sf_dir).withColumn("family", T.normalized_stem("filename")).withColumn("ord", F.row_number().over(w)).withColumn("chosen", F.col("ord") == 2)
    return listing.newer(v).select("family", "filename", "ord")


@query("diff_order", f"WITH {CTE}, {_SEC} SELECT doc, heading, change_type, CAST(row_number() OVER (PARTITION BY doc ORDER BY change_type = 'unchanged', lower(heading), heading) AS INTEGER) AS place FROM s")
def diff_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = versions.compare_sections(sections(spark, sf_dir, "A"), sections(spark, sf_dir, "N"), "doc")
    return listing.diff_order(s, "doc").select("doc", "heading", "change_type", "place")


@query("severity_counts", f"WITH u AS ({ORACLES['unresolved_references']}) SELECT 0 AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) AS findings FROM u")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.severity_counts(requirements.unresolved_references(icd_documents(spark, sf_dir)))


@query("thin_rectangles", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity % 11 < 3 OR l_quantity % 7 < 3) AND (l_quantity % 11 > 5 OR l_quantity % 7 > 5)")
def thin_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").where(listing.thin(q % 11, q % 7)).select("l_orderkey", "l_linenumber")


@query("grid_pages", "SELECT l_orderkey, count(*) FILTER (l_quantity % 2 = 0 AND l_extendedprice > 20) >= 3 AND count(*) FILTER (l_quantity % 2 <> 0 AND l_extendedprice > 20) >= 3 AS grid FROM lineitem GROUP BY l_orderkey")
def grid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, long = F.col("l_quantity") % 2 == 0, F.col("l_extendedprice").cast("double")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(even, long).otherwise(0.0).alias("x1"), F.when(even, 0.0).otherwise(long).alias("y1"))
    return listing.has_grid(lines, "l_orderkey")


@query("smallest_file", "SELECT arg_min(filename, (size, filename)) AS path, CAST(sum(size) AS BIGINT) AS total_size FROM (SELECT p_name AS filename, p_size AS size FROM part)")
def smallest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.smallest(table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_size").alias("size")))


@query("evaluation_grid", _RRF + _JUDGE + """ SELECT 'whole/rrf' AS config, query_id, recall, reciprocal_rank, round(n, 9) AS ndcg_raw, round(least(n, 1.0), 9) AS ndcg_capped, hit, 0 AS ord FROM mm
    UNION ALL SELECT 'broken/rrf', item_id, 0.0, 0.0, 0.0, 0.0, false, 1 FROM benchmark""")
def evaluation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations, of which one cannot be searched and counts with zeros."""
    return evaluate.grid(_judged(spark, sf_dir), {"whole/rrf": _rrf(spark, sf_dir).join(_whole_docs(spark, sf_dir), "chunk_id"), "broken/rrf": None})


@query("recommendation", """WITH m AS (SELECT p_brand AS model_id, avg(p_size) / 100 AS best_recall, CAST(count(*) AS DOUBLE) / 1000 AS cost_usd FROM part GROUP BY p_brand), b AS (SELECT * FROM m ORDER BY best_recall DESC, model_id LIMIT 1)
    SELECT CASE WHEN best_recall - 0.2::DOUBLE > 0.05 THEN 'upgrade' WHEN best_recall - 0.2::DOUBLE > 0.02 THEN 'test_further' WHEN best_recall - 0.2::DOUBLE > -0.01 AND cost_usd < 0.2::DOUBLE * 0.7 THEN 'cost_savings' ELSE 'stay' END AS action, model_id, best_recall AS recall, cost_usd / 40 AS cost_per_query, 'high' AS confidence FROM b""")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model_id")).agg((F.avg("p_size") / 100).alias("best_recall"), (F.count("*").cast("double") / 1000).alias("cost_usd"))
    return evaluate.recommend(m, "now", 0.2, 40)
