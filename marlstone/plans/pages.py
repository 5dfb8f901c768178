"""Queries on layout, OCR and journal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journal, layout, ocr
from .base import query, table
from .fixture import CTE, icd_blocks, icd_documents


def _a(spark, sf_dir) -> DataFrame:
    return icd_documents(spark, sf_dir)


@query("block_types", f"""WITH {CTE} SELECT block_id, CASE WHEN y0 < 792 * 0.08 THEN 'header' WHEN y1 > 792 * 0.92 THEN 'footer' WHEN regexp_matches(text, '\\.{{4,}}') THEN 'list_item'
    WHEN length(text) < 100 AND (starts_with(lower(text), 'figure') OR starts_with(lower(text), 'table')) THEN 'caption' WHEN y1 - y0 > 80 THEN 'paragraph' WHEN font_size >= 14 THEN 'heading' WHEN bold AND length(text) < 200 THEN 'heading'
    WHEN regexp_matches(text, '^[A-Z0-9]+(\\.[0-9]+)*\\.?\\s+\\S') THEN 'heading' ELSE 'paragraph' END AS block_type FROM icd""")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icd_blocks(spark, sf_dir).select("block_id", layout.block_type().alias("block_type"))


@query("page_classes", f"""WITH {CTE}, p AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY ord) AS text, (doc % 10) / 10.0::DOUBLE AS r, CAST(doc % 4 AS INT) AS n, CAST(doc % 30 AS INT) AS d, doc % 3 = 0 AS g FROM icdr GROUP BY doc, page),
    c AS (SELECT doc, page, concat_ws(',', CASE WHEN length(text) > 10 THEN 'native_digital_text' END, CASE WHEN r > 0.3 THEN 'mixed_content' END, CASE WHEN d > 20 AND g THEN 'table_heavy' END, CASE WHEN d > 10 AND NOT g AND n < 3 THEN 'diagram_heavy' END, CASE WHEN page = 1 THEN 'cover' END,
        CASE WHEN len(regexp_extract_all(lower(text), 'shall')) >= 3 THEN 'requirements' END) AS classes FROM p)
    SELECT doc, page, classes, false AS ocr_required, CASE len(string_split(classes, ',')) WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM c""")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    p = _a(spark, sf_dir).groupBy("doc", "page").agg(t.alias("text"))
    p = p.select("*", ((F.col("doc") % 10) / 10).alias("image_ratio"), (F.col("doc") % 4).cast("int").alias("images"), (F.col("doc") % 30).cast("int").alias("drawings"), (F.col("doc") % 3 == 0).alias("grid"))
    return layout.page_classes(p).select("doc", "page", F.array_join("classes", ",").alias("classes"), "ocr_required", "confidence")


@query("header_footer", f"""WITH {CTE}, z AS (SELECT *, CASE WHEN y0 < 80 THEN 'header' WHEN y0 > 700 THEN 'footer' END AS position, substr(trim(text), 1, 50) AS t FROM icdr)
    SELECT doc, position, t AS text, count(*) AS n, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, array_to_string(list_sort(list(block_id)), ',') AS block_ids, round(avg(y0), 3) AS y_position FROM z WHERE position IS NOT NULL GROUP BY doc, position, t HAVING count(*) >= 3""")
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.headers_footers(_a(spark, sf_dir)).withColumns({"pages": F.array_join(F.col("pages").cast("array<string>"), ","), "block_ids": F.array_join("block_ids", ",")})


@query("gap_sessions", """WITH g AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t FROM events), l AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) >= 86400 AS n FROM g)
    SELECT user_id, event_id, CAST(sum(coalesce(n, false)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS cluster FROM l""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return layout.gap_sessions(e, ["user_id"], "t", 86400.0, "event_id").select("user_id", "event_id", "cluster")


@query("cluster_positions", """WITH l AS (SELECT p_brand, p_retailprice AS v, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) >= 3.0 AS n FROM part),
    c AS (SELECT p_brand, v, sum(coalesce(n, false)::INT) OVER (PARTITION BY p_brand ORDER BY v) AS cluster FROM l)
    SELECT p_brand, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, list_sort(list(v))[count(*) // 2 + 1] AS position FROM c GROUP BY p_brand, cluster HAVING count(*) >= 2""")
def cluster_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cluster_positions(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 3.0)


@query("table_zones", f"""WITH {CTE}, b AS (SELECT doc, page, floor(y0 / 15) * 15 AS band, count(*) AS n FROM icd GROUP BY ALL HAVING count(*) >= 3), l AS (SELECT *, band - lag(band) OVER (PARTITION BY doc, page ORDER BY band) > 120 AS g FROM b),
    c AS (SELECT *, sum(coalesce(g, false)::INT) OVER (PARTITION BY doc, page ORDER BY band) AS zone FROM l)
    SELECT doc, page, CAST(zone AS BIGINT) AS zone, CAST(min(band) AS DOUBLE) AS y_from, CAST(max(band) + 15 AS DOUBLE) AS y_to, CAST(sum(n) AS BIGINT) AS n_spans FROM c GROUP BY doc, page, zone""")
def table_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_zones(icd_blocks(spark, sf_dir), ["doc", "page"])


@query("text_rows")
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored rows of a page's blocks."""
    return layout.group_rows(_a(spark, sf_dir).select("doc", "page", "ord", "y0"), ["doc", "page"], 19.0)


@query("table_grid")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_grid(_a(spark, sf_dir).select("doc", "page", "text", "x0", "x1", "y0"), ["doc", "page"])


@query("header_alignment", f"WITH {CTE} SELECT block_id, CASE WHEN y0 < 60 THEN 'header' ELSE 'footer' END AS zone, CASE WHEN x0 / 612 < 0.33 THEN 'left' WHEN x0 / 612 < 0.55 THEN 'center' ELSE 'right' END AS alignment FROM icd WHERE y0 < 60 OR y0 > 700")
def header_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icd_blocks(spark, sf_dir).where("y0 < 60 or y0 > 700").select("block_id", F.when(F.col("y0") < 60, "header").otherwise("footer").alias("zone"), layout.alignment().alias("alignment"))


@query("reflow", f"""WITH {CTE}, e AS (SELECT *, CASE WHEN ord % 5 = 0 THEN 24.0::DOUBLE - (y1 - y0) ELSE 0 END AS delta FROM icdr),
    s AS (SELECT *, CASE WHEN y0 < 60 OR y0 > 742 THEN 0 ELSE coalesce(sum(delta) OVER (PARTITION BY doc, page ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS shift FROM e)
    SELECT doc, page, block_id, y0 + shift AS y0, y1 + shift + delta AS y1, greatest(y1 + shift + delta - 742, 0) AS overflow FROM s""")
def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _a(spark, sf_dir)
    return layout.reflow(b, b.where("ord % 5 = 0").select("block_id", F.lit(24.0).alias("new_height")))


def _words(spark, sf_dir):
    """Two sources of words on invented pages: the second is shifted, disagrees at times and sees some that the first does not."""
    p = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 1000).alias("doc"), (F.col("p_partkey") % 20).alias("page"), F.col("p_partkey").alias("ord"), F.substring_index("p_name", " ", 1).alias("text"),
        ((F.col("p_partkey") / 20).cast("int") % 10 * 60.0).alias("x0"), ((F.col("p_partkey") % 1000 / 200).cast("int") * 20.0).alias("y0"), (F.lit(30.0) + F.col("p_partkey") * 7 % 70).cast("double").alias("confidence"), "p_size",
    )
    box = lambda d, dx: d.select("doc", "page", "ord", "text", (F.col("x0") + dx).alias("x0"), "y0", (F.col("x0") + dx + 40).alias("x1"), (F.col("y0") + 12).alias("y1"), "confidence", "source")
    first = box(p.where("p_size % 5 <> 0").withColumn("source", F.lit("a")), 0)
    other = p.withColumn("text", F.when(F.col("p_size") % 3 == 0, F.upper("text")).when(F.col("p_size") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return first, box(other.withColumn("confidence", F.col("confidence") + 5).withColumn("source", F.lit("b")), F.lit(8))


_OCR = """p AS (SELECT p_partkey // 1000 AS doc, p_partkey % 20 AS page, p_partkey AS ord, split_part(p_name, ' ', 1) AS text, (p_partkey // 20) % 10 * 60.0::DOUBLE AS x0, (p_partkey % 1000 // 200) * 20.0::DOUBLE AS y0, (30.0 + p_partkey * 7 % 70)::DOUBLE AS confidence, p_size FROM part),
    a AS (SELECT doc, page, ord, text, x0, y0, x0 + 40 AS x1, y0 + 12 AS y1, confidence, 'a' AS source FROM p WHERE p_size % 5 <> 0),
    b AS (SELECT doc, page, ord, CASE p_size % 3 WHEN 0 THEN upper(text) WHEN 1 THEN text || 'x' ELSE text END AS text, x0 + 8 AS x0, y0, x0 + 48 AS x1, y0 + 12 AS y1, confidence + 5 AS confidence, 'b' AS source FROM p),
    o AS (SELECT b.*, a.ord AS a_ord, a.text AS a_text, a.confidence AS a_conf FROM b JOIN a ON a.doc = b.doc AND a.page = b.page AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) > 0 AND (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0
        AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 480.0 > 0.5),
    f AS (SELECT DISTINCT ON (doc, page, ord) * FROM o ORDER BY doc, page, ord, a_ord),
    m AS (SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN f USING (doc, page, ord))"""


@query("ocr_merge", f"WITH {_OCR} SELECT * FROM m")
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.merge(*_words(spark, sf_dir), ("doc", "page"))


@query("ocr_review_flags", f"WITH {_OCR} SELECT doc, page, ord, source, 'disagreement' AS reason, least(confidence, a_conf) AS confidence FROM f WHERE lower(text) <> lower(a_text) AND confidence > 70 AND a_conf > 70 UNION ALL SELECT doc, page, ord, source, 'low confidence', confidence FROM m WHERE confidence < 60")
def ocr_review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.review_flags(*_words(spark, sf_dir), by=("doc", "page"))


@query("ocr_font_size", """WITH h AS (SELECT p_brand, p_size AS h FROM part), m AS (SELECT p_brand, list_sort(list(h::DOUBLE) FILTER (h > 3)) AS s FROM h GROUP BY p_brand), e AS (SELECT p_brand, s[len(s) // 2 + 1] / 1.2 AS est FROM m)
    SELECT p_brand, arg_min(z::DOUBLE, abs(z - est) * 1000 + z / 1000.0) AS font_size FROM e, (SELECT unnest([8, 9, 10, 11, 12, 14, 16, 18, 20, 24]) AS z) GROUP BY p_brand""")
def ocr_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.font_size(table(spark, sf_dir, "part").select("p_brand", F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("y1")), "p_brand")


@query("ocr_lines", f"WITH {_OCR} SELECT doc, page, CAST(y0 / 20 AS INT) AS line, y0, string_agg(text, ' ' ORDER BY x0, ord) AS text FROM b GROUP BY doc, page, y0")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.lines(_words(spark, sf_dir)[1], by=("doc", "page"))


def _calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("service"), (F.col("user_id") % 40).alias("page"), (F.col("event_id") % 97 / 1000).alias("cost"))


@query("cost_by_service", "WITH c AS (SELECT event_type AS service, user_id % 40 AS page, event_id % 97 / 1000 AS cost FROM events), g AS (SELECT service, count(*) AS calls, round(sum(cost), 6) AS cost, count(DISTINCT page) AS pages FROM c GROUP BY service) SELECT *, round(cost / pages, 6) AS cost_per_page FROM g")
def cost_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.cost_summary(_calls(spark, sf_dir))


@query("cost_rollup", "SELECT event_type AS operation, round(sum(event_id % 97 / 1000), 6) AS cost, count(*) AS calls FROM events GROUP BY ROLLUP (event_type)")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.cost_rollup(_calls(spark, sf_dir).withColumnRenamed("service", "operation"))


def actions(spark, sf_dir) -> DataFrame:
    """Events as a journal: errors undo, sign-ups redo, the rest edits a block."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit").alias("action"),
        (F.col("event_id") % 5).alias("block_id"), F.concat(F.lit("o"), "event_id").alias("old_text"), F.concat(F.lit("n"), "event_id").alias("new_text"), (F.col("event_id") % 97 / 1000).alias("cost"),
    )


#: The stacks u (applied) and r (undone) of each session after all its actions, by a recursion over them.
STACKS = """a AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f(session, n, u, r) AS (SELECT DISTINCT session, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM a UNION ALL
        SELECT f.session, a.n, CASE WHEN action = 'edit' THEN list_append(u, seq) WHEN action = 'undo' THEN u[:len(u) - 1] WHEN len(r) > 0 THEN list_append(u, r[len(r)]) ELSE u END,
            CASE WHEN action = 'edit' THEN []::BIGINT[] WHEN action = 'undo' THEN CASE WHEN len(u) > 0 THEN list_append(r, u[len(u)]) ELSE r END WHEN len(r) > 0 THEN r[:len(r) - 1] ELSE r END
        FROM f JOIN a ON a.session = f.session AND a.n = f.n + 1),
    l AS (SELECT session, arg_max(u, n) AS u, arg_max(r, n) AS r FROM f GROUP BY session)"""


@query("journal_state", f"WITH RECURSIVE {STACKS} SELECT session, array_to_string(u, ',') AS applied, array_to_string(r, ',') AS undone FROM l")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.stacks(actions(spark, sf_dir)).select("session", F.array_join(F.col("applied").cast("array<string>"), ",").alias("applied"), F.array_join(F.col("undone").cast("array<string>"), ",").alias("undone"))


@query("net_edits", f"""WITH RECURSIVE {STACKS}, e AS (SELECT session, unnest(u) AS seq FROM l)
    SELECT session, seq % 5 AS block_id, 'o' || min(seq) AS old_text, 'n' || max(seq) AS new_text, count(*) AS n_edits FROM e GROUP BY ALL""")
def net_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.net_edits(actions(spark, sf_dir))


@query("latest_text", "SELECT user_id AS session, event_id % 5 AS block_id, 'n' || max(event_id) AS new_text FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY ALL")
def latest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.latest_text(actions(spark, sf_dir))


@query("session_totals", "SELECT user_id AS session, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS edit_count, round(sum(event_id % 97 / 1000), 6) AS total_cost FROM events GROUP BY user_id")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.session_totals(actions(spark, sf_dir))


@query("history_tail3", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def history_tail3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.tail(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("duplicate_files", "SELECT sha, n AS copies, path FROM (SELECT sha256(text) AS sha, doc_id AS path, count(*) OVER (PARTITION BY text) AS n, row_number() OVER (PARTITION BY text ORDER BY source = 'src0' DESC, doc_id) AS k FROM documents) WHERE k = 1")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("path"), (F.col("source") == "src0").alias("curated"))
    return journal.distinct_files(d).select(F.col("sha256").alias("sha"), "copies", "path")


@query("registry_delta", """WITH k AS (SELECT DISTINCT p_type AS model FROM part WHERE p_size < 5), l AS (SELECT DISTINCT p_type AS model FROM part WHERE p_size BETWEEN 3 AND 8), b AS (SELECT DISTINCT p_type AS model FROM part WHERE p_size = 6)
    SELECT model, 'new' AS state FROM (SELECT * FROM l EXCEPT SELECT * FROM k) UNION ALL SELECT model, 'deprecated' FROM (SELECT * FROM k EXCEPT SELECT * FROM l) UNION ALL SELECT model, 'unbenchmarked' FROM (SELECT * FROM l EXCEPT SELECT * FROM b)""")
def registry_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("model"), "p_size")
    return journal.registry_delta(*[p.where(c).select("model").distinct() for c in ("p_size < 5", "p_size between 3 and 8", "p_size = 6")])
