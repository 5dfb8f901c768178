"""Layout: block types, page classes, clustering, table grids, header and footer mining, paragraphs, reflow.

Blocks are (doc, page, ord, block_id, text, x0, y0, x1, y1, font_size, bold); spans are text boxes of a page.
Chained clustering compares with the previous value (a window); anchored grouping compares with the first
member of the group and is an ordered fold over a group's sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranks import picked


def block_type(page_height: float = 792.0) -> Column:
    """Rules in order: place, leader dots, caption, height, large, bold, numbered; else paragraph."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    first = F.trim(F.element_at(F.split("text", "\n"), 1))
    low = F.lower("text")
    caption = (F.length("text") < 100) & (F.startswith(low, F.lit("figure")) | F.startswith(low, F.lit("table")))
    numbered = first.rlike(r"^[A-Z0-9]+(\.[0-9]+)*\.?\s+\S") & (F.length(first) < 200)
    return (
        F.when(F.col("y0") < page_height * 0.08, "header").when((F.col("y1") > page_height * 0.92) & (lines == 1), "footer").when(first.rlike(r"\.{4,}"), "list_item")
        .when(caption, "caption").when(F.col("y1") - F.col("y0") > 80, "paragraph").when((F.col("font_size") >= 14) & (lines <= 3), "heading")
        .when(F.col("bold") & (lines <= 2) & (F.length("text") < 200), "heading").when(numbered & (lines <= 3), "heading").otherwise("paragraph")
    )


def dominant_style(spans: DataFrame, *keys: str) -> DataFrame:
    """Mean size, most frequent font (the first by name of several), any bold (bit 4) or italic (bit 1) of spans (keys, font, size, flags)."""
    fonts = spans.groupBy(*keys, "font").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min_by("font", F.struct(-F.col("n"), "font")).alias("font"))
    rest = spans.groupBy(*keys).agg(F.round(F.avg("size"), 1).alias("font_size"), F.bool_or(F.getbit("flags", F.lit(4)) == 1).alias("bold"), F.bool_or(F.getbit("flags", F.lit(1)) == 1).alias("italic"))
    return rest.join(fonts, list(keys))


def page_classes(pages: DataFrame) -> DataFrame:
    """Labels of pages (page, text, image_ratio, images, drawings, grid): (…, classes, ocr_required, confidence)."""
    t = F.trim("text")
    up, has = F.upper(t), F.length(t) > 10
    r, d, g, n = (F.col(c) for c in ("image_ratio", "drawings", "grid", "images"))
    rules = [
        (r > 0.7) & ~has, has & ~((r > 0.7) & ~has), has & (r > 0.3), (d > 20) & g, (d > 10) & ~g & (n < 3), (n > 0) & ~has & (r > 0.8) & ~(r > 0.7),
        F.col("page") == 1, F.contains(up, F.lit("TABLE OF CONTENTS")) | F.startswith(up, F.lit("CONTENTS")), F.regexp_count(F.lower(t), F.lit("shall")) >= 3, F.contains(up, F.lit("REVISION HISTORY")) | F.contains(up, F.lit("CHANGE LOG")),
    ]
    names = ["scanned", "native_digital_text", "mixed_content", "table_heavy", "diagram_heavy", "image_only", "cover", "table_of_contents", "requirements", "revision_history"]
    found = F.filter(F.array(*[F.when(c, x) for c, x in zip(rules, names)]), lambda x: x.isNotNull())
    classes = F.when(F.size(found) > 0, found).otherwise(F.array(F.when(has, "native_digital_text").otherwise("scanned")))
    sure = F.when(F.size("classes") == 1, 0.9).when(F.size("classes") == 2, 0.8).otherwise(0.7)
    return pages.withColumn("classes", classes).withColumn("ocr_required", ~has).withColumn("confidence", sure)


def image_ratio(images: DataFrame, *keys: str) -> DataFrame:
    """Share of a page that images (keys, w, h, page_area) cover, one at most."""
    return images.groupBy(*keys).agg(F.least(F.sum(F.col("w") * F.col("h")) / F.max("page_area"), F.lit(1.0)).alias("image_ratio"))


def headers_footers(blocks: DataFrame, least: int = 3, head: float = 80.0, foot: float = 700.0) -> DataFrame:
    """Texts (first 50 characters) that repeat in the head or foot zone of a document: rows, pages, ids and mean height."""
    zone = F.when(F.col("y0") < head, "header").when(F.col("y0") > foot, "footer")
    rows = blocks.withColumn("position", zone).withColumn("text", F.substring(F.trim("text"), 1, 50)).where("position is not null and text <> ''")
    return rows.groupBy("doc", "position", "text").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_list("block_id")).alias("block_ids"), F.round(F.avg("y0"), 3).alias("y_position")).where(F.col("n") >= least)


def gap_sessions(rows: DataFrame, keys: list[str], value: str, gap: float, *tie: str) -> DataFrame:
    """Number of the cluster of each row: a new one begins where the step from the previous value is ``gap`` or more."""
    w = Window.partitionBy(*keys).orderBy(value, *tie)
    new = (F.col(value) - F.lag(value).over(w) >= gap).cast("int")
    return rows.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def cluster_positions(rows: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Upper median of each cluster of two or more values."""
    g = gap_sessions(rows, keys, value, gap)
    sizes = g.groupBy(*keys, "cluster").agg(F.count("*").alias("n")).where("n >= 2")
    return sizes.join(picked(g, [*keys, "cluster"], value, {"position": 0.5}), [*keys, "cluster"]).select(*keys, "cluster", "n", "position")


def table_zones(spans: DataFrame, keys: list[str], band: float = 15.0, gap: float = 120.0, least: int = 3) -> DataFrame:
    """Vertical zones with bands of several spans, not more than ``gap`` apart: (keys, zone, y_from, y_to)."""
    bands = spans.groupBy(*keys, (F.floor(F.col("y0") / band) * band).alias("band")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return gap_sessions(bands, keys, "band", gap + 1e-9).groupBy(*keys, F.col("cluster").alias("zone")).agg(F.min("band").alias("y_from"), (F.max("band") + band).alias("y_to"), F.sum("n").alias("n_spans"))


def anchored(values: Column, tolerance: float) -> Column:
    """Group number of each element of a sorted array: a new group where the distance to the group's first member is ``tolerance`` or more."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def add(acc, v):
        new = acc["anchor"].isNull() | (F.abs(v - acc["anchor"]) >= tolerance)
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(F.when(new, v).otherwise(acc["anchor"]).alias("anchor"), g.alias("g"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.aggregate(values, start, add, lambda acc: acc["out"])


def group_rows(spans: DataFrame, keys: list[str], tolerance: float = 5.0, value: str = "y0") -> DataFrame:
    """Add ``row``: the number of the text row, by distance to the row's first member."""
    others = [c for c in spans.columns if c not in (*keys, value)]
    s = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(value, *others))).alias("s"))
    s = s.withColumn("g", anchored(F.transform("s", lambda x: x[value].cast("double")), tolerance))
    return s.select(*keys, F.explode(F.zip_with("s", "g", lambda a, b: F.struct(a.alias("s"), b.alias("row")))).alias("z")).select(*keys, "z.s.*", "z.row")


def merge_spans(rows: DataFrame, keys: list[str], gap: float = 15.0) -> DataFrame:
    """Join spans of a text row whose left edge is less than ``gap`` from the furthest right edge so far."""
    w = Window.partitionBy(*keys, "row").orderBy("x0", "text")
    far = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    seg = rows.withColumn("_n", F.coalesce((F.col("x0") - far >= gap).cast("int"), F.lit(0))).withColumn("seg", F.sum("_n").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return seg.groupBy(*keys, "row", "seg").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), text.alias("text"))


def table_grid(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row_y, col_x, text) of a page's table: rows and columns are clusters of merged spans, each goes to the nearest."""
    merged = merge_spans(group_rows(spans, keys), keys)
    cols = cluster_positions(merged, keys, "x0", 30.0).select(*keys, F.col("position").alias("col_x"))
    rows = cluster_positions(merged, keys, "y0", 8.0).select(*keys, F.col("position").alias("row_y"))
    big = cols.groupBy(*keys).agg(F.count("*").alias("nc")).join(rows.groupBy(*keys).agg(F.count("*").alias("nr")), keys).where("nc >= 2 and nr >= 3").select(*keys)
    grids = cols.groupBy(*keys).agg(F.collect_list("col_x").alias("cs")).join(rows.groupBy(*keys).agg(F.collect_list("row_y").alias("rs")), keys).join(big, keys, "left_semi")

    def nearest(positions, at):
        return F.array_sort(F.transform(positions, lambda p: F.struct(F.abs(p - at).alias("d"), p.alias("p"))))[0]["p"]

    cells = merged.join(grids, keys).withColumn("col_x", nearest(F.col("cs"), F.col("x0"))).withColumn("row_y", nearest(F.col("rs"), F.col("y0")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ")
    return cells.groupBy(*keys, "row_y", "col_x").agg(text.alias("text")).where(F.trim("text") != "")


def alignment(page_width: float = 612.0) -> Column:
    """Thirds of the page for running heads: left, centre or right by the left edge."""
    r = F.col("x0") / page_width
    return F.when(r < 0.33, "left").when(r < 0.55, "center").otherwise("right")


def wrapped_lines(width: float, char: float = 5.0) -> Column:
    """Lines that ``text`` takes when words are filled greedily; a word wider than the line has one of its own."""
    most = int(width // char)
    start = F.struct(F.lit(1).alias("lines"), F.lit(0).alias("now"))

    def add(acc, w):
        n = F.length(w)
        room = F.when(acc["now"] == 0, n).otherwise(acc["now"] + 1 + n)
        fits = (room <= most) | (acc["now"] == 0)
        return F.struct(F.when(fits, acc["lines"]).otherwise(acc["lines"] + 1).alias("lines"), F.when(fits, room).otherwise(n).alias("now"))

    return F.aggregate(T.words("text"), start, add, lambda acc: acc["lines"])


def reflow(blocks: DataFrame, edited: DataFrame, line_height: float = 12.0, bottom: float = 742.0, head: float = 60.0, foot: float = 742.0) -> DataFrame:
    """Blocks after edits (block_id, new_height): those below, outside the running heads, shift by the growth above; ``overflow`` tells what passes the bottom."""
    rows = blocks.join(edited, "block_id", "left").withColumn("delta", F.coalesce(F.col("new_height") - (F.col("y1") - F.col("y0")), F.lit(0.0)))
    rows = rows.withColumn("delta", F.when(F.abs("delta") > 0.5, F.col("delta")).otherwise(0.0))
    w = Window.partitionBy("doc", "page").orderBy("y0", "ord").rowsBetween(Window.unboundedPreceding, -1)
    running = (F.col("y0") < head) | (F.col("y0") > foot)
    shift = F.when(running, 0.0).otherwise(F.coalesce(F.sum("delta").over(w), F.lit(0.0)))
    rows = rows.withColumn("shift", shift)
    return rows.select("doc", "page", "block_id", (F.col("y0") + F.col("shift")).alias("y0"), (F.col("y1") + F.col("shift") + F.col("delta")).alias("y1"), F.greatest(F.col("y1") + F.col("shift") + F.col("delta") - bottom, F.lit(0.0)).alias("overflow"))


def table_cells(spans: DataFrame, heights: DataFrame | None = None, y_min: float = 0.0, y_max: float = 9999.0, margin: float = 60.0) -> DataFrame:
    """(doc, page, row, col, id, text, x0, y0, x1, y1, rows, columns) of the spans (doc, page, text, x0, y0, x1, y1) of a page's table, for an editor.

    Spans in the margins (of pages of a height (doc, page, height_pt), 792 where none is given), outside y_min to y_max and blank ones are left out. Rows are
    spans within 5 pt of the row's first one, cells stand from left to right. A page with fewer than four spans, two rows or two columns has no table.
    """
    page = ["doc", "page"]
    rows = spans.withColumn("text", F.trim("text")).where(F.col("text") != "")
    rows = rows.withColumn("height_pt", F.lit(792.0)) if heights is None else rows.join(heights.select(*page, "height_pt"), page, "left").withColumn("height_pt", F.coalesce("height_pt", F.lit(792.0)))
    rows = rows.where((F.col("y0") >= margin) & (F.col("y0") <= F.col("height_pt") - margin) & F.col("y0").between(y_min, y_max)).select(*page, "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    placed = group_rows(rows.select(*page, "y0", "x0", "text", "x1", "y1"), page, 5.0, "y0")
    col = F.row_number().over(Window.partitionBy(*page, "row").orderBy("x0", "y0", "text", "x1", "y1")) - 1
    every = Window.partitionBy(*page)
    cells = placed.withColumn("col", col).withColumn("n", F.count("*").over(every)).withColumn("rows", F.max("row").over(every) + 1).withColumn("columns", F.max("col").over(every) + 1)
    cells = cells.where("n >= 4 and rows >= 2 and columns >= 2")
    return cells.select(*page, "row", "col", F.format_string("cell-p%02d-r%d-c%d", "page", "row", "col").alias("id"), "text", "x0", "y0", "x1", "y1", "rows", "columns")
