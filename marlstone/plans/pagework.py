"""Queries on page contents, block splitting, hidden text, OCR answers, undo and change reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pagework
from .base import query, table
from .fixture import CTE, icd_documents

KEYS = ("doc", "page")


def _b(spark, sf_dir) -> DataFrame:
    return icd_documents(spark, sf_dir)



@query("page_content", f"""WITH {CTE}, s AS (SELECT *, CASE WHEN y0 < 60 THEN 'header' WHEN y0 > 720 THEN 'footer' ELSE 'body' END AS zone, CASE WHEN x0 < 612 * 0.33 THEN 'left' WHEN x0 > 612 * 0.66 THEN 'right' ELSE 'center' END AS third FROM icdr),
    g AS (SELECT doc, page, {', '.join(f"arg_min(text, ord) FILTER (zone = '{z}' AND third = '{t}') AS {z}_{t}" for z in ('header', 'footer') for t in ('left', 'center', 'right'))},
        count(*) FILTER (zone = 'header') AS heads, coalesce(string_agg(text, '|' ORDER BY ord) FILTER (zone = 'body' AND font_size > 13), '') AS titles, count(*) FILTER (zone = 'body' AND font_size <= 13) AS paragraphs,
        min(y0) FILTER (zone = 'body') AS top, max(y0) FILTER (zone = 'body' AND y0 < 500) AS low FROM s GROUP BY doc, page)
    SELECT doc, page, CASE WHEN doc % 30 > 20 THEN 'table' WHEN titles <> '' AND paragraphs < 15 AND heads = 0 THEN 'title_page' ELSE 'text' END AS page_type, header_left, header_center, header_right, footer_left, footer_center, footer_right,
        titles, paragraphs, '' AS list_items, false AS has_toc, doc % 30 > 20 AS has_table, CAST(CASE WHEN doc % 30 > 20 THEN doc % 30 ELSE 0 END AS INT) AS table_grid_elements,
        CASE WHEN doc % 30 > 20 THEN coalesce(top, 0) ELSE 0 END::DOUBLE AS table_y_min, CASE WHEN doc % 30 > 20 THEN coalesce(low, 0) + 20 ELSE 0 END::DOUBLE AS table_y_max FROM g""")
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _b(spark, sf_dir).withColumn("size", F.col("font_size"))
    pages = b.select(*KEYS).distinct().select(*KEYS, F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), (F.col("doc") % 30).cast("int").alias("drawings"))
    return pagework.page_content(b, pages, *KEYS).withColumns({c: F.array_join(c, "|") for c in ("titles", "list_items")})


@query("blocks_by_style", f"""WITH RECURSIVE {CTE}, n AS (SELECT doc, page, ord, text, font_size AS size, bold, regexp_matches(text, '^[A-Z0-9]+(\\.[0-9]+)+\\.?\\s+\\S') AS head, row_number() OVER (PARTITION BY doc, page ORDER BY ord) AS i FROM icdr),
    r AS (SELECT doc, page, ord, size, bold, head, i, 0 AS part, 1 AS held FROM n WHERE i = 1 UNION ALL
        SELECT doc, page, ord, size, bold, head, i, part + new::INT, CASE WHEN new THEN 1 ELSE held + 1 END FROM (
            SELECT n.*, r.part, r.held, (n.head AND NOT r.head) OR n.size >= r.size + 2 OR (r.size >= n.size + 2 AND r.held <= 3 AND r.size >= 13) OR (n.bold AND NOT r.bold AND r.held >= 2) AS new
            FROM r JOIN n ON n.doc = r.doc AND n.page = r.page AND n.i = r.i + 1) z)
    SELECT doc, page, ord, part FROM r""")
def blocks_by_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _b(spark, sf_dir).select(*KEYS, F.col("ord").alias("line"), "text", F.col("font_size").alias("size"), "bold")
    return pagework.split_by_style(lines, *KEYS).select(*KEYS, F.col("line").alias("ord"), "part")


@query("heading_lines", f"""WITH {CTE}, f AS (SELECT doc, page, ord, bold OR k % 4 = 0 OR (k % 4 = 1 AND bool_or(k % 4 = 2) OVER (PARTITION BY doc, page)) AS head FROM icdr)
    SELECT doc, page, ord, CASE WHEN bool_and(head) OVER (PARTITION BY doc, page ORDER BY ord) THEN 'heading' ELSE 'paragraph' END AS part FROM f""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    font = F.element_at(F.array(F.lit("Courier-Bold"), F.lit("Arial"), F.lit("TimesNewRoman"), F.lit("Courier")), (F.col("k") % 4 + 1).cast("int"))
    spans = _b(spark, sf_dir).select(*KEYS, F.col("ord").alias("line"), "text", font.alias("font"), F.when(F.col("bold"), 16).otherwise(0).alias("flags"))
    return pagework.split_heading(spans, *KEYS).select(*KEYS, F.col("line").alias("ord"), "part")


@query("page_paragraphs", f"""WITH {CTE}, l AS (SELECT doc, page, y0, arg_min(font_size, (x0, ord)) AS size, arg_min(text, (x0, ord)) AS first, string_agg(text, ' ' ORDER BY x0, ord) AS text FROM icdr GROUP BY doc, page, y0),
    b AS (SELECT *, lag(y0) OVER w IS NOT NULL AND (y0 - lag(y0) OVER w > 18 OR size > 13 OR lag(size) OVER w > 13 OR regexp_matches(first, '^\\d+[.)]\\s') OR regexp_matches(first, '^[1-9]\\d*\\.\\d+')) AS new FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY y0)),
    p AS (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY doc, page ORDER BY y0) AS paragraph FROM b)
    SELECT doc, page, CAST(paragraph AS BIGINT) AS paragraph, min(y0) AS y0, count(*) AS lines, string_agg(text, chr(10) ORDER BY y0) AS text FROM p GROUP BY doc, page, paragraph""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagework.paragraphs(_b(spark, sf_dir).withColumn("size", F.col("font_size")), *KEYS)


@query("page_overflow", f"""WITH {CTE}, o AS (SELECT doc, page, arg_min(y1 - 592, ord) FILTER (y0 >= 60 AND y0 <= 742 AND y1 > 592) AS overflow FROM icdr GROUP BY doc, page) SELECT doc, page, coalesce(overflow, 0)::DOUBLE AS overflow FROM o""")
def page_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagework.page_overflow(_b(spark, sf_dir), bottom=200.0)


_SPLIT = """m AS (SELECT doc, page, ord, block_id, y0, y1, y0 >= 60 AND NOT (y0 > 742 AND y0 < 792) AND k <> 9 AND y1 > 592 AS moved FROM {rows}),
    p AS (SELECT doc, page, bool_or(moved) AS split FROM m GROUP BY doc, page), n AS (SELECT doc, page, coalesce(sum(split::INT) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
    t AS (SELECT m.*, before, page + before + moved::INT AS target, 72 + coalesce(sum(y1 - y0 + 6) OVER (PARTITION BY doc, page, moved ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM m JOIN n USING (doc, page)),
    z AS (SELECT *, row_number() OVER (PARTITION BY doc, target ORDER BY CASE WHEN moved THEN y0 ELSE 0 END, ord) - 1 AS place FROM t)
    SELECT doc, CAST(target AS INT) AS page, ord, CASE WHEN moved OR before > 0 THEN printf('block-p%02d-b%02d', CAST(target AS BIGINT), place) ELSE block_id END AS block_id, CASE WHEN moved THEN y ELSE y0 END AS y0, CASE WHEN moved THEN y + y1 - y0 ELSE y1 END AS y1, moved FROM z"""


def _typed(spark, sf_dir) -> DataFrame:
    return _b(spark, sf_dir).withColumn("block_type", F.when(F.col("k") == 9, "table").otherwise("paragraph"))


@query("page_split", f"WITH {CTE}, {_SPLIT.format(rows='icdr')}")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagework.split_pages(_typed(spark, sf_dir), bottom=200.0).select("doc", "page", "ord", "block_id", "y0", "y1", "moved")


@query("reflow_and_split", f"""WITH {CTE}, e AS (SELECT *, CASE WHEN ord % 5 = 0 THEN 24.0::DOUBLE - (y1 - y0) ELSE 0 END AS delta FROM icdr),
    s AS (SELECT *, CASE WHEN y0 < 60 OR y0 > 742 THEN 0 ELSE coalesce(sum(delta) OVER (PARTITION BY doc, page ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS shift FROM e),
    f AS (SELECT doc, page, ord, block_id, k, y0 + shift AS y0, y1 + shift + delta AS y1 FROM s), {_SPLIT.format(rows='f')}""")
def reflow_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _typed(spark, sf_dir)
    grown = b.where("ord % 5 = 0").select("block_id", F.lit(24.0).alias("new_height"))
    return pagework.reflow_and_split(b, grown, bottom=200.0).select("doc", "page", "ord", "block_id", "y0", "y1", "moved")


@query("rogue_text", f"""WITH {CTE}, s AS (SELECT doc, page, ord, substr(text, 1, 12) AS text, CASE WHEN k % 3 = 0 THEN 255 ELSE 200 END AS bright, x0 + k * 2 AS x0, y0 + k AS y0, x0 + k * 2 + 40 AS x1, y0 + k + 10 AS y1 FROM icdr),
    d AS (SELECT doc, page, x0, y0, x1, y0 + 20 AS y1 FROM icdr WHERE k = 8), v AS (SELECT * REPLACE (trim(text) AS text) FROM s),
    h AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc = v.doc AND d.page = v.page AND (v.x0 + v.x1) / 2 BETWEEN d.x0 AND d.x1 AND (v.y0 + v.y1) / 2 BETWEEN d.y0 AND d.y1)),
    f AS (SELECT h.*, t.block_id, row_number() OVER (PARTITION BY h.doc, h.page, h.ord ORDER BY NOT (abs(t.x0 - h.x0) < 20 AND abs(t.y0 - h.y0) < 20), t.ord) AS k FROM h JOIN icdr t ON t.doc = h.doc AND t.page = h.page AND ((abs(t.x0 - h.x0) < 20 AND abs(t.y0 - h.y0) < 20) OR contains(t.text, h.text))),
    g AS (SELECT *, row_number() OVER (PARTITION BY block_id, text ORDER BY page, ord) AS twice FROM f WHERE k = 1)
    SELECT doc, page, ord, block_id, text, x0, y0, x1, y1, 'white_no_background' AS reason, 0.95::DOUBLE AS confidence FROM g WHERE twice = 1""")
def rogue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light words over the page, some on dark fills."""
    b = _b(spark, sf_dir)
    shade = F.when(F.col("k") % 3 == 0, 0xFFFFFF).otherwise(0xC8C8C8)
    x, y = F.col("x0") + F.col("k") * 2, F.col("y0") + F.col("k")
    spans = b.select(*KEYS, "ord", F.substring("text", 1, 12).alias("text"), shade.alias("color"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 10).alias("y1"))
    dark = b.where("k = 8").select(*KEYS, "x0", "y0", "x1", (F.col("y0") + 20).alias("y1"))
    return pagework.rogue_text(spans, dark, b)


@query("document_lines", """WITH w AS (SELECT p_partkey // 8 AS doc, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) - 1 AS i FROM part)
    SELECT doc, 1 AS page, CAST(i // 4 AS INT) AS line, string_agg(p_name, ' ' ORDER BY i DESC) AS text, CAST(count(*) AS INT) AS words, 90.0::DOUBLE AS confidence FROM w GROUP BY doc, i // 4""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with lines of four words each; a line lists its words from the last to the first."""
    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 8").alias("doc"), F.struct("p_partkey", "p_name").alias("w"))
    p = p.groupBy("doc").agg(F.array_sort(F.collect_list("w")).alias("w"))
    box = F.struct(F.struct(F.lit(0.1).alias("Left"), F.lit(0.2).alias("Top"), F.lit(0.3).alias("Width"), F.lit(0.01).alias("Height")).alias("BoundingBox"))
    ids = lambda i: F.transform(F.reverse(F.slice("w", i * 4 + 1, 4)), lambda x: x["p_partkey"].cast("string"))
    child = lambda i: F.array(F.struct(F.lit("CHILD").alias("Type"), ids(i).alias("Ids")))
    lines = F.transform(F.sequence(F.lit(0), F.expr("(size(w) - 1) div 4").cast("int")), lambda i: F.struct(F.concat(F.lit("line"), i.cast("string")).alias("Id"), F.lit("LINE").alias("BlockType"), F.lit(None).cast("string").alias("Text"), child(i).alias("Relationships"), box.alias("Geometry"), F.lit(90.0).alias("Confidence")))
    none = F.lit(None).cast("array<struct<Type:string,Ids:array<string>>>")
    words = F.transform("w", lambda x: F.struct(x["p_partkey"].cast("string").alias("Id"), F.lit("WORD").alias("BlockType"), x["p_name"].alias("Text"), none.alias("Relationships"), box.alias("Geometry"), F.lit(80.0).alias("Confidence")))
    answers = p.select("doc", F.lit(1).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.to_json(F.struct(F.concat(lines, words).alias("Blocks"))).alias("answer"))
    return pagework.document_lines(answers)


@query("undo_applied", f"""WITH {CTE} SELECT block_id, CASE WHEN ord % 3 = 0 THEN replace(text, 'the', 'THE') WHEN ord % 3 = 1 THEN 'whole' ELSE text END AS text FROM icdr WHERE contains(text, 'the') OR ord % 3 > 0
    UNION ALL SELECT block_id, 'THE' FROM icdr WHERE NOT contains(text, 'the') AND ord % 3 = 0""")
def undo_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _b(spark, sf_dir)
    a = b.where("ord % 3 < 2").select("block_id", F.when(F.col("ord") % 3 == 0, "THE").otherwise("whole").alias("old_text"), F.when(F.col("ord") % 3 == 0, "the").otherwise("").alias("new_text"))
    return pagework.apply_undo(b.select("block_id", "text"), a)


@query("change_report", f"""WITH {CTE}, c AS (SELECT page, block_id, text, CASE ord % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'removed' ELSE 'added' END AS t FROM icdr),
    h AS (SELECT ['# Change Report (' || count(*) || ' changes)', '', '| Type | Count |', '|------|-------|', '| Modified | ' || count(*) FILTER (t = 'modified') || ' |', '| Added | ' || count(*) FILTER (t = 'added') || ' |', '| Removed | ' || count(*) FILTER (t = 'removed') || ' |', ''] AS s FROM c),
    m AS (SELECT page, block_id, ['**Page ' || page || '** (' || block_id || ')', '- Old: `' || substr(text, 1, 50) || '`', '- New: `' || substr(upper(text), 1, 50) || '`', ''] AS s FROM c WHERE t = 'modified')
    SELECT 0 AS section, NULL::BIGINT AS page, NULL AS block_id, CAST(unnest(range(8)) AS INT) AS line, unnest(s) AS text FROM h
    UNION ALL SELECT section, NULL, NULL, line, text FROM (VALUES (1, 0, '## Modified Blocks'), (1, 1, ''), (2, 0, '## Removed Blocks'), (2, 1, ''), (3, 0, '## Added Blocks'), (3, 1, '')) AS x(section, line, text)
    UNION ALL SELECT 1, CAST(page AS BIGINT), block_id, CAST(unnest(range(4)) AS INT), unnest(s) FROM m
    UNION ALL SELECT CASE t WHEN 'removed' THEN 2 ELSE 3 END, CAST(page AS BIGINT), block_id, 0, '- Page ' || page || ': `' || substr(CASE t WHEN 'removed' THEN text ELSE upper(text) END, 1, 50) || '`' FROM c WHERE t <> 'modified'""")
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("ord") % 3 == 0, "modified").when(F.col("ord") % 3 == 1, "removed").otherwise("added")
    changes = _b(spark, sf_dir).select("page", "block_id", kind.alias("change_type"), F.col("text").alias("old_text"), F.upper("text").alias("new_text"))
    return pagework.change_report(changes)
