"""Queries on tables of contents, validation, page comparisons and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contents, items, layout, requirements, versions
from .base import query, table
from .documents import _SEC, rev, section_compare
from .fixture import CTE, icd_documents

#: Spans of invented contents pages, which both engines derive: leader dots, numbers alone, section numbers in a row, plain lines.
SPANS = """
    SELECT l_suppkey AS doc, CAST(l_orderkey % 60 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 60 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS ord,
        90.0D0 + (l_partkey % 3) * 18 AS x0, 40.0D0 + (l_partkey % 45) * 15 AS y0,
        CASE (l_partkey + l_linenumber) % 9
            WHEN 0 THEN concat('Interface ', CAST(l_partkey AS STRING), ' ........ ', CAST(l_linenumber AS STRING)) WHEN 1 THEN concat('  Scope of part ', CAST(l_partkey AS STRING), '..........') WHEN 2 THEN CAST(l_partkey % 90 AS STRING)
            WHEN 3 THEN concat(CAST(l_linenumber AS STRING), '.') WHEN 4 THEN concat(CAST(l_linenumber AS STRING), '.', CAST(l_partkey % 5 AS STRING)) WHEN 5 THEN 'Table of Contents' WHEN 6 THEN 'Power ....... see xiv' WHEN 7 THEN 'Annex.......xiv' ELSE 'abc' END AS text
    FROM lineitem"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPANS.replace("D0", "D").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


@query("table_of_contents", "WITH p AS (" + SPANS.replace("D0", "::DOUBLE") + r"""),
    s AS (SELECT *, trim(text) AS t, length(text) - length(replace(text, '.', '')) > 5 AS dots FROM p WHERE y0 BETWEEN 60 AND 700 AND NOT contains(lower(text), 'table of contents')),
    k AS (SELECT *, regexp_extract(t, '^(.+?)\.{3,}\s*([ivxlcdmIVXLCDM\d]+)?\s*$', ['a', 'b']) AS m, regexp_matches(t, '^(.+?)\.{3,}\s*([ivxlcdmIVXLCDM\d]+)?\s*$') AS led FROM s),
    c AS (SELECT *, CASE WHEN dots THEN 'entry' WHEN regexp_matches(t, '^\d+$') THEN 'number' WHEN regexp_matches(t, '^\d+\.') THEN 'prefix' WHEN length(t) > 3 THEN 'entry' END AS kind,
        CASE WHEN dots AND led THEN trim(m.a) WHEN dots THEN trim(regexp_replace(t, '\.{3,}.*$', '')) ELSE t END AS title, CASE WHEN dots AND led THEN m.b ELSE '' END AS ref FROM k),
    n AS (SELECT *, count(*) FILTER (kind <> 'number') OVER w AS n FROM c WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc, page ORDER BY ord)),
    e AS (SELECT * REPLACE (coalesce(arg_max(CASE WHEN kind = 'number' THEN t END, CASE WHEN kind = 'number' THEN ord END) OVER (PARTITION BY doc, page, n), ref) AS ref) FROM n WHERE n > 0),
    r AS (SELECT *, count(*) FILTER (kind <> 'prefix') OVER (PARTITION BY doc, page ORDER BY ord) AS run FROM e WHERE kind <> 'number'),
    a AS (SELECT *, CASE WHEN kind = 'prefix' THEN count(*) FILTER (kind = 'prefix') OVER (PARTITION BY doc, page, run ORDER BY ord) END AS at_ FROM r),
    t AS (SELECT *, coalesce(at_ % 2 = 1, false) AS takes FROM a),
    x AS (SELECT *, coalesce(lag(takes) OVER w, false) AS taken, lead(title) OVER w AS nt, lead(ref) OVER w AS nr FROM t WINDOW w AS (PARTITION BY doc, page ORDER BY ord)),
    o AS (SELECT doc, page, ord, CASE WHEN takes AND nt IS NOT NULL THEN title || ' ' || nt ELSE title END AS title, CASE WHEN takes AND nt IS NOT NULL AND nr <> '' THEN nr ELSE ref END AS page_ref, y0 AS y, x0 - 90 AS indent FROM x WHERE NOT taken),
    f AS (SELECT *, count(*) FILTER (page_ref <> '') OVER (PARTITION BY doc, page) AS refs FROM o)
    SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY ord) - 1 AS INTEGER) AS place, title, page_ref, y, indent FROM f WHERE refs >= 3""")
def table_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents.table_of_contents(spans(spark, sf_dir))


@query("validation", f"""WITH {CTE}, b AS (SELECT *, trim(text) AS t FROM icdr),
    d AS (SELECT DISTINCT doc, rtrim(regexp_extract(t, '^(\\d+[.\\d]*\\.?)\\s+\\S', 1), '.') AS target FROM b WHERE regexp_matches(t, '^(\\d+[.\\d]*\\.?)\\s+\\S')),
    y AS (SELECT DISTINCT doc, regexp_extract(t, '^[Tt]able\\s+([\\d.]+[-\\d]*)', 1) AS target FROM b WHERE starts_with(t, 'Table ')),
    r AS (SELECT doc, page, ord, block_id, 0 AS n, rtrim(unnest(regexp_extract_all(text, '[Ss]ection\\s+(\\d+[.\\d]*)', 1)), '.') AS target FROM b),
    q AS (SELECT doc, page, ord, block_id, 0 AS n, unnest(regexp_extract_all(text, '[Tt]able\\s+([\\d.]+[-\\d]*)', 1)) AS target FROM b WHERE NOT starts_with(t, 'Table ')),
    g AS (SELECT *, lag(target) OVER (PARTITION BY doc ORDER BY CAST(target AS INT)) AS prev FROM d WHERE NOT contains(target, '.')),
    i AS (SELECT doc, 'warning' AS severity, 'cross_ref' AS category, 'Section ' || target || ' referenced but not found as a heading' AS message, page, block_id, 0 AS turn, ord AS at_ FROM r ANTI JOIN d USING (doc, target)
        UNION ALL SELECT doc, 'info', 'cross_ref', 'Table ' || target || ' referenced — verify it exists', page, block_id, 0, ord FROM q ANTI JOIN y USING (doc, target)
        UNION ALL SELECT doc, 'warning', 'structure', 'Gap in section numbering: ' || prev || ' → ' || target, 0, '', 1, CAST(target AS INT) FROM g WHERE CAST(target AS INT) - CAST(prev AS INT) > 1)
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY severity DESC, turn, page, at_) - 1 AS INTEGER) AS place, severity, category, message, page, block_id FROM i""")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved references and gaps of every document as one ordered list; warnings come before infos."""
    return requirements.validate(icd_documents(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str, r: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return rev(spark, sf_dir, r).groupBy("doc", "page").agg(text.alias("text"))


_REPORT = f"""{CTE}, t AS (SELECT doc, rev, page, string_agg(text, ' ' ORDER BY ord) AS text FROM icd WHERE rev IN ('A', 'N') GROUP BY ALL),
    v AS (SELECT a.doc, a.page, a.text AS ta, b.text AS tb, list_distinct(string_split(a.text, ' ')) AS x, list_distinct(string_split(b.text, ' ')) AS y FROM t a JOIN t b ON a.doc = b.doc AND a.page = b.page AND a.rev = 'A' AND b.rev = 'N'),
    w AS (SELECT doc, page, len(x) AS n_words, list_sort(list_filter(x, lambda i: NOT list_contains(y, i))) AS missing, list_sort(list_filter(y, lambda i: NOT list_contains(x, i))) AS extra, ta, tb FROM v),
    p AS (SELECT doc, page, CAST(n_words AS INTEGER) AS n_words, missing, extra, CASE WHEN ta = tb THEN 'exact' WHEN len(missing) = 0 AND len(extra) = 0 THEN 'whitespace' ELSE 'differs' END AS state FROM w),
    k AS (SELECT *, CASE WHEN n_words > 0 THEN (n_words - len(missing)) / n_words * 100 ELSE 100 END AS kept FROM p),
    g AS (SELECT doc, count(*) AS pages, count(*) FILTER (state = 'exact') AS exact, count(*) FILTER (state = 'whitespace') AS whitespace, count(*) FILTER (state = 'differs') AS differs, CAST(sum(n_words) AS BIGINT) AS words, CAST(sum(len(missing)) AS BIGINT) AS missing_words, CAST(sum(len(extra)) AS BIGINT) AS extra_words,
        avg(kept) AS mean_, (SELECT z.page FROM k z WHERE z.doc = k.doc ORDER BY z.kept DESC, z.page LIMIT 1) AS best_page, (SELECT z.page FROM k z WHERE z.doc = k.doc ORDER BY z.kept, z.page LIMIT 1) AS worst_page FROM k GROUP BY doc),
    s AS (SELECT doc, pages, exact, whitespace, differs, words, missing_words, extra_words, round((words - missing_words) / words * 100, 6) AS word_retention, round(mean_, 6) AS mean_retention, best_page, worst_page FROM g)"""


@query("page_text_report", f"WITH {_REPORT} SELECT * FROM p")
def page_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.page_report(_pages(spark, sf_dir, "A"), _pages(spark, sf_dir, "N"), "doc")


@query("text_accuracy", f"WITH {_REPORT} SELECT * FROM s")
def text_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each document's pages, with the pages that keep most and least."""
    return versions.text_totals(page_text_report(spark, sf_dir), "doc")


@query("text_accuracy_report", f"""WITH {_REPORT}, n AS (SELECT *, CASE state WHEN 'exact' THEN 'Exact' WHEN 'whitespace' THEN 'Whitespace' ELSE 'Differs' END AS status,
        concat_ws('; ', CASE WHEN len(missing) > 0 THEN 'Missing: ' || array_to_string(missing[1:3], ', ') END, CASE WHEN len(extra) > 0 THEN 'Extra: ' || array_to_string(extra[1:3], ', ') END) AS notes FROM p),
    l AS (SELECT doc, string_agg('| ' || page || ' | ' || status || ' | ' || n_words || ' | ' || len(missing) || ' | ' || len(extra) || ' | ' || notes || ' |', chr(10) ORDER BY page) AS lines FROM n GROUP BY doc)
    SELECT doc, '## Per-Page Results' || chr(10) || chr(10) || '| Page | Status | Words Orig | Missing | Extra | Notes |' || chr(10) || '|------|--------|-----------|---------|-------|-------|' || chr(10) || lines || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
        || '| Metric | Value |' || chr(10) || '|--------|-------|' || chr(10) || '| Pages with exact text match | ' || exact || '/' || pages || ' |' || chr(10) || '| Word retention | ' || printf('%.1f', word_retention) || '% |' || chr(10)
        || '| Total unique words in original | ' || words || ' |' || chr(10) || '| Total missing words | ' || missing_words || ' |' || chr(10) || '| Total extra words | ' || extra_words || ' |' AS report FROM l JOIN s USING (doc)""")
def text_accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_text_report(spark, sf_dir)
    return versions.text_report(pages, versions.text_totals(pages, "doc"), "doc")


@query("similarity_conflicts", """WITH v AS (SELECT vec_id, label, CASE vec_id % 3 WHEN 0 THEN 'R' || (vec_id % 2) WHEN 1 THEN '' END AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.vec_id AS item_a, b.vec_id AS item_b, a.r AS ra, b.r AS rb, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.label <> b.label)
    SELECT item_a, item_b, round(s, 6) AS similarity FROM p WHERE s > 0.3 AND ra <> '' AND rb <> '' AND ra <> rb""")
def similarity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar items of different documents that are both resolved, but differently; an empty resolution is none."""
    value = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("R"), F.col("vec_id") % 2)).when(F.col("vec_id") % 3 == 1, F.lit(""))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("doc"), "embedding", value.alias("resolution"))
    resolved = v.where("resolution <> ''")  # one of two that is not resolved makes no conflict
    return items.correlate(resolved, 0.3, 0.45).where("conflict").select("item_a", "item_b", F.round("similarity", 6).alias("similarity"))


@query("page_table_cells", "WITH p AS (" + SPANS.replace("D0", "::DOUBLE") + """), s AS (SELECT doc, page, trim(text) AS text, x0, y0, x0 + 50 AS x1, y0 + 10 AS y1, ord FROM p WHERE y0 BETWEEN 60 AND 500),
    r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc, page ORDER BY y0) - 1 AS INTEGER) AS row FROM s), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc, page, row ORDER BY x0, text) - 1 AS INTEGER) AS col FROM r),
    n AS (SELECT *, count(*) OVER w AS n, max(row) OVER w + 1 AS rows, max(col) OVER w + 1 AS columns FROM c WINDOW w AS (PARTITION BY doc, page))
    SELECT doc, page, row, col, printf('cell-p%02d-r%d-c%d', page, row, col) AS id, text, x0, y0, x1, y1, rows, columns FROM n WHERE n >= 4 AND rows >= 2 AND columns >= 2""")
def page_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of pages 560 pt high as cells of a table."""
    s = spans(spark, sf_dir).withColumn("x1", F.col("x0") + 50).withColumn("y1", F.col("y0") + 10)
    return layout.table_cells(s, s.select("doc", "page").distinct().withColumn("height_pt", F.lit(560.0)))


_STAMPED = f"""{CTE}, {_SEC}, m AS (SELECT doc, heading, change_type, classification, has_requirement_change, CASE WHEN change_type = 'modified' THEN ['Page ' || (page_old % 3) || ' → ' || (page_new % 2), '+ "' || substr(new_text, 1, 8) || '"'][1:1 + length(new_text) % 2] ELSE [] END AS snippets,
        CAST(classification = 'technical' AND page_old % 2 = 0 AS INTEGER) AS value_changes, CAST(has_tbd_change AS INTEGER) AS tbd_changes FROM s),
    x AS (SELECT doc, heading, unnest(snippets) AS snippet, generate_subscripts(snippets, 1) AS at_ FROM m), b AS (SELECT doc, snippet, count(*) AS n FROM x WHERE contains(snippet, '→') AND NOT regexp_matches(snippet, '^[+-]') GROUP BY ALL HAVING count(*) >= 3),
    k AS (SELECT doc, heading, list(snippet ORDER BY at_) AS kept FROM x ANTI JOIN b USING (doc, snippet) GROUP BY ALL),
    r AS (SELECT m.*, coalesce(kept, []) AS left_, change_type = 'modified' AND len(snippets) > 0 AND kept IS NULL AND value_changes = 0 AND tbd_changes = 0 AS no FROM m LEFT JOIN k USING (doc, heading))"""


def _stamped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections of two revisions with invented snippets: a stamp of their pages, and for some what was added."""
    said = F.slice(F.array(F.concat(F.lit("Page "), F.col("page_old") % 3, F.lit(" → "), F.col("page_new") % 2), F.concat(F.lit('+ "'), F.substring("new_text", 1, 8), F.lit('"'))), F.lit(1), 1 + F.length("new_text") % 2)
    value = ((F.col("classification") == "technical") & (F.col("page_old") % 2 == 0)).cast("int")
    rows = section_compare(spark, sf_dir).select(
        "doc", "heading", "change_type", "classification", "has_requirement_change", F.when(F.col("change_type") == "modified", said).otherwise(F.array().cast("array<string>")).alias("snippets"), value.alias("value_changes"), F.col("has_tbd_change").cast("int").alias("tbd_changes")
    )
    return versions.without_boilerplate(rows, "doc")


@query("sections_without_boilerplate", f"WITH {_STAMPED} SELECT doc, heading, CASE WHEN no THEN 'unchanged' ELSE change_type END AS change_type, CASE WHEN no THEN 'editorial' ELSE classification END AS classification, NOT no AND has_requirement_change AS has_requirement_change, array_to_string(left_, ';') AS snippets FROM r")
def sections_without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stamped(spark, sf_dir)[0]
    return rows.select("doc", "heading", "change_type", "classification", "has_requirement_change", F.array_join("snippets", ";").alias("snippets"))


@query("boilerplate_changes", f"WITH {_STAMPED} SELECT doc, snippet, n FROM b")
def boilerplate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(spark, sf_dir)[1]
