"""Page contents: what a page holds, splitting of blocks and pages, paragraphs, hidden text, answers of OCR services, undo, change reports.

Spans are (keys, ord, text, x0, y0, x1, y1, size); ``ord`` is their order on the page. A page's or a block's lines
are the largest group that any window or fold here holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import group_rows, reflow

# Patterns of section headings, of numbered lines, of list items and of sections within a page.
HEADING = r"^[A-Z0-9]+(\.[0-9]+)+\.?\s+\S"
NUMBERED = r"^\d+[\.\d]*\.?\s+\w"
LIST_ITEM = r"^\d+[\.\)]\s"
SECTION = r"^[1-9]\d*\.\d+"


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def dotted(c: Column) -> Column:
    """Whether a line has leader dots."""
    return F.contains(c, F.lit("...")) | (F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) > 5)


def page_content(spans: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """What pages (keys, width, height, drawings) hold, by their spans: type, running heads by thirds, titles, list items, table zone.

    The head is above 60 points, the foot in the last 72. A page without spans is of type text, or table by its drawings.
    """
    s = spans.withColumn("text", strip(F.col("text"))).where("text <> ''").join(pages, list(keys))
    zone = F.when(F.col("y0") < 60, "header").when(F.col("y0") > F.col("height") - 72, "footer").otherwise("body")
    third = F.when(F.col("x0") < F.col("width") * 0.33, "left").when(F.col("x0") > F.col("width") * 0.66, "right").otherwise("center")
    s = s.withColumn("zone", zone).withColumn("third", third)
    body, text = F.col("zone") == "body", F.col("text")
    bullet = F.startswith(text, F.lit("•")) | F.startswith(text, F.lit("- "))
    first = lambda z, t: F.min_by(F.when((F.col("zone") == z) & (F.col("third") == t), text), F.when((F.col("zone") == z) & (F.col("third") == t), F.col("ord"))).alias(f"{z}_{t}")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "text")))), lambda x: x["text"])
    found = s.groupBy(*keys).agg(
        *[first(z, t) for z in ("header", "footer") for t in ("left", "center", "right")], F.count_if(F.col("zone") == "header").alias("heads"),
        F.count_if(body & dotted(text) & text.rlike(r"\d+\s*$")).alias("toc_lines"), F.count_if(body & text.rlike(NUMBERED)).alias("numbered"),
        listed(body & (F.col("size") > 13)).alias("titles"), F.count_if(body & (F.col("size") <= 13) & ~F.startswith(text, F.lit("•"))).alias("paragraphs"), listed(body & bullet).alias("list_items"),
        F.min(F.when(body, F.col("y0"))).alias("top"), F.max(F.when(body & (F.col("y0") < 500), F.col("y0"))).alias("low"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    items = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rows = pages.join(found, list(keys), "left").withColumn("has_toc", (n("toc_lines") >= 3) | ((n("toc_lines") >= 2) & (n("numbered") >= 2))).withColumn("has_table", F.col("drawings") > 20)
    cover = (F.size(items("titles")) > 0) & (n("paragraphs") < 15) & (n("heads") == 0)
    kind = F.when(F.col("has_toc"), "table_of_contents").when(F.col("has_table"), "table").when(cover, "title_page").when(F.size(items("list_items")) > 0, "list").otherwise("text")
    within = lambda c: F.when(F.col("has_table"), c).otherwise(F.lit(0.0))
    return rows.select(
        *keys, kind.alias("page_type"), *[f"{z}_{t}" for z in ("header", "footer") for t in ("left", "center", "right")], items("titles").alias("titles"), n("paragraphs").alias("paragraphs"), items("list_items").alias("list_items"),
        "has_toc", "has_table", F.when(F.col("has_table"), F.col("drawings")).otherwise(0).alias("table_grid_elements"),
        within(F.coalesce("top", F.lit(0.0))).alias("table_y_min"), within(F.coalesce("low", F.lit(0.0)) + 20).alias("table_y_max"),
    )


def split_by_style(lines: DataFrame, *keys: str) -> DataFrame:
    """Add ``part`` to a block's lines (keys, line, text, size, bold): a new one where heading, size or weight change; tables of contents stay whole.

    Two of the rules look at how many lines the part has so far, so the break codes of a block's lines are folded in order.
    """
    w = Window.partitionBy(*keys).orderBy("line")
    text, before = strip(F.col("text")), lambda c: F.lag(c).over(w)
    short, size, last = F.length(text) < 150, F.col("size"), before(F.col("size"))
    always = (text.rlike(HEADING) & ~before(text.rlike(HEADING))) | ((size > 0) & (last > 0) & (size >= last + 2) & short)
    drop = (size > 0) & (last >= size + 2) & (last >= 13)
    heavy = F.col("bold") & ~before(F.col("bold")) & short
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = lines.select(*keys, "line", flag(always).alias("always"), flag(drop).alias("drop"), flag(heavy).alias("heavy"), dotted(F.col("text")).cast("int").alias("dots"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "always", "drop", "heavy"))).alias("s"), F.sum("dots").alias("dots"))
    toc = (F.size("s") >= 3) & (F.col("dots") >= F.size("s") * 0.5)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("g"), F.array().cast("array<struct<line:bigint,part:int>>").alias("out"))

    def add(acc, x):
        new = ~toc & (acc["n"] > 0) & (x["always"] | (x["drop"] & (acc["n"] <= 3)) | (x["heavy"] & (acc["n"] >= 2)))
        part = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        here = F.array(F.struct(x["line"].cast("bigint").alias("line"), part.alias("part")))
        return F.struct(F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), part.alias("g"), F.concat(acc["out"], here).alias("out"))

    out = g.select(*keys, F.explode(F.aggregate("s", start, add, lambda a: a["out"])).alias("z")).select(*keys, "z.line", "z.part")
    return lines.join(out, [*keys, "line"])


def split_heading(spans: DataFrame, *keys: str) -> DataFrame:
    """Lines (keys, line, part) of blocks by their spans (keys, line, text, font, flags): the leading lines that are bold, or sans in a block with serifs, are the heading."""
    font, shown = F.lower("font"), F.trim("text") != ""
    bold = (F.getbit("flags", F.lit(4)) == 1) | F.contains(font, F.lit("bold"))
    sans = F.contains(font, F.lit("arial")) | F.contains(font, F.lit("helvetica")) | (F.contains(font, F.lit("liberation")) & F.contains(font, F.lit("sans")))
    serif = F.contains(font, F.lit("times")) | F.contains(font, F.lit("serif"))
    lines = spans.groupBy(*keys, "line").agg(F.bool_or(shown & bold).alias("bold"), F.bool_or(shown & sans).alias("sans"), F.bool_or(shown & serif).alias("serif"))
    mixed = F.bool_or("serif").over(Window.partitionBy(*keys))
    lines = lines.withColumn("head", F.col("bold") | (F.col("sans") & mixed))
    leading = F.bool_and("head").over(Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select(*keys, "line", F.when(leading, "heading").otherwise("paragraph").alias("part"))


def paragraphs(spans: DataFrame, *keys: str) -> DataFrame:
    """Paragraphs (keys, paragraph, y0, lines, text) of a column's spans: lines are spans within 3 points of the line's first, and a new paragraph begins after a gap above 18, at and after headings, at list items, sections and bullets."""
    rows = group_rows(spans.select(*keys, "y0", "x0", "ord", "text", "size"), list(keys), math.nextafter(3.0, 4.0))
    at = F.struct("y0", "x0", "ord")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "text"))), lambda x: x["text"]), " ")
    lines = rows.groupBy(*keys, "row").agg(F.min("y0").alias("y0"), F.min_by("size", at).alias("size"), strip(F.min_by("text", at)).alias("first"), text.alias("text"))
    w = Window.partitionBy(*keys).orderBy("row")
    first = F.col("first")
    opens = (F.col("size") > 13) | first.rlike(LIST_ITEM) | first.rlike(SECTION) | F.startswith(first, F.lit("•")) | F.startswith(first, F.lit("‣"))
    new = F.lag("y0").over(w).isNotNull() & (opens | (F.col("y0") - F.lag("y0").over(w) > 18) | (F.lag("size").over(w) > 13))
    lines = lines.withColumn("new", new.cast("int")).withColumn("paragraph", F.sum("new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy(*keys, "paragraph").agg(F.min("y0").alias("y0"), F.count("*").alias("lines"), joined.alias("text"))


def page_overflow(blocks: DataFrame, height: float = 792.0, bottom: float = 72.0) -> DataFrame:
    """(doc, page, overflow): how far the first block in order that passes the bottom margin does so, running heads and feet aside; 0 without one."""
    over = (F.col("y0") >= 60) & (F.col("y0") <= height - 50) & (F.col("y1") > height - bottom)
    first = F.min_by(F.when(over, F.col("y1") - (height - bottom)), F.when(over, F.col("ord")))
    return blocks.groupBy("doc", "page").agg(F.coalesce(first, F.lit(0.0)).alias("overflow"))


# Types of blocks that go to a new page.
MOVABLE = ["paragraph", "list_item", "caption", "heading"]


def split_pages(blocks: DataFrame, height: float = 792.0, top: float = 72.0, bottom: float = 72.0, gap: float = 6.0) -> DataFrame:
    """Blocks (doc, page, ord, block_id, block_type, y0, y1, ...) after each page that passes its bottom margin is split, and ``moved``.

    Movable blocks beyond the margin, running heads and feet aside, go to a page of their own after it, below each
    other; later pages and their blocks are numbered anew. All pages of a document are split at once, which equals
    splitting them one at a time from the last to the first.
    """
    foot = (F.col("y0") > height - 50) & (F.col("y0") < height)
    rows = blocks.withColumn("moved", (F.col("y0") >= 60) & ~foot & F.col("block_type").isin(MOVABLE) & (F.col("y1") > height - bottom))
    here = Window.partitionBy("doc", "page", "moved").orderBy("y0", "ord")
    rows = rows.withColumn("opens", (F.col("moved") & (F.row_number().over(here) == 1)).cast("int"))
    before = F.coalesce(F.sum("opens").over(Window.partitionBy("doc").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = F.col("y1") - F.col("y0")
    above = F.coalesce(F.sum(h + gap).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("before", before).withColumn("y", F.when(F.col("moved"), top + above).otherwise(F.col("y0")))
    page = (F.col("page") + F.col("before") + F.col("moved").cast("int")).cast("int")
    place = F.row_number().over(Window.partitionBy("doc", "to").orderBy(F.when(F.col("moved"), F.col("y0")), "ord")) - 1
    name = F.format_string("block-p%02d-b%02d", F.col("to"), place)
    rows = rows.withColumn("to", page).withColumn("id", F.when(F.col("moved") | (F.col("before") > 0), name).otherwise(F.col("block_id")))
    rows = rows.withColumns({"y1": F.col("y") + h, "y0": F.col("y"), "page": F.col("to"), "block_id": F.col("id")})
    return rows.select(*blocks.columns, "moved")


def reflow_and_split(blocks: DataFrame, edited: DataFrame, height: float = 792.0, top: float = 72.0, bottom: float = 72.0) -> DataFrame:
    """Blocks after edits (block_id, new_height) have shifted those below, and pages that overflow by it are split."""
    placed = reflow(blocks, edited).select("block_id", F.col("y0").alias("to0"), F.col("y1").alias("to1"))
    rows = blocks.join(placed, "block_id").withColumns({"y0": F.col("to0"), "y1": F.col("to1")}).select(*blocks.columns)
    return split_pages(rows, height, top, bottom)


def rogue_text(spans: DataFrame, backgrounds: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hidden text: light spans (doc, page, ord, text, color, x0, y0, x1, y1) whose centre no image or dark fill (doc, page, x0, y0, x1, y1) holds.

    Each goes to the first block (doc, page, ord, block_id, text, x0, y0) within 20 points, else to the first
    that contains its text; without either it is left out. Short repeats in a block count once.
    """
    r, g, b = (F.shiftright("color", n).bitwiseAND(255) for n in (16, 8, 0))
    s = spans.withColumn("text", strip(F.col("text"))).where((F.length("text") >= 2) & ((r + g + b) / 3 >= 200)).withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2).alias("s")
    k = backgrounds.alias("k")
    behind = (F.col("s.doc") == F.col("k.doc")) & (F.col("s.page") == F.col("k.page")) & F.col("s.cx").between(F.col("k.x0"), F.col("k.x1")) & F.col("s.cy").between(F.col("k.y0"), F.col("k.y1"))
    s = s.join(k, behind, "left_anti").alias("s")
    t = blocks.alias("t")
    near = (F.abs(F.col("t.x0") - F.col("s.x0")) < 20) & (F.abs(F.col("t.y0") - F.col("s.y0")) < 20)
    on = (F.col("s.doc") == F.col("t.doc")) & (F.col("s.page") == F.col("t.page")) & (near | F.contains(F.col("t.text"), F.col("s.text")))
    found = s.join(t, on).groupBy(*[F.col(f"s.{c}").alias(c) for c in ("doc", "page", "ord", "text", "x0", "y0", "x1", "y1")]).agg(F.min_by("t.block_id", F.struct(~near, F.col("t.ord"), F.col("t.block_id"))).alias("block_id"))
    twice = F.row_number().over(Window.partitionBy("doc", "block_id", "text", F.when(F.length("text") > 80, F.struct("page", "ord"))).orderBy("page", "ord"))
    found = found.withColumn("twice", twice).where("twice = 1")
    return found.select("doc", "page", "ord", "block_id", F.substring("text", 1, 80).alias("text"), "x0", "y0", "x1", "y1", F.lit("white_no_background").alias("reason"), F.lit(0.95).alias("confidence"))


_BOX = "Geometry STRUCT<BoundingBox: STRUCT<`Left`: DOUBLE, Top: DOUBLE, Width: DOUBLE, Height: DOUBLE>>, Confidence DOUBLE"
_BLOCKS = f"Blocks ARRAY<STRUCT<Id: STRING, BlockType: STRING, Text: STRING, RowIndex: INT, ColumnIndex: INT, RowSpan: INT, ColumnSpan: INT, Relationships: ARRAY<STRUCT<Type: STRING, Ids: ARRAY<STRING>>>, {_BOX.replace('Geometry STRUCT', 'Geometry: STRUCT').replace('Confidence DOUBLE', 'Confidence: DOUBLE')}>>"
_DETECTIONS = f"TextDetections ARRAY<STRUCT<Type: STRING, DetectedText: STRING, {_BOX.replace('Geometry STRUCT', 'Geometry: STRUCT').replace('Confidence DOUBLE', 'Confidence: DOUBLE')}>>"


def _boxes(answers: DataFrame, schema: str, field: str) -> DataFrame:
    """Entries of JSON answers (doc, page, width, height, answer) with their boxes in points."""
    rows = answers.select("doc", "page", "width", "height", F.posexplode(F.from_json("answer", schema)[field]).alias("ord", "b"))
    at = lambda c, of: F.coalesce(F.col(f"b.Geometry.BoundingBox.{c}"), F.lit(0.0)) * F.col(of)
    rows = rows.withColumn("x0", at("Left", "width")).withColumn("y0", at("Top", "height"))
    return rows.withColumn("x1", F.col("x0") + at("Width", "width")).withColumn("y1", F.col("y0") + at("Height", "height")).withColumn("confidence", F.coalesce("b.Confidence", F.lit(0.0)))


def detected_words(answers: DataFrame) -> DataFrame:
    """Words of a text detector's answers."""
    rows = _boxes(answers, _DETECTIONS, "TextDetections").where("b.Type = 'WORD'")
    return rows.select("doc", "page", "ord", F.coalesce("b.DetectedText", F.lit("")).alias("text"), "x0", "y0", "x1", "y1", "confidence")


def document_words(answers: DataFrame) -> DataFrame:
    """Words of a document reader's answers."""
    rows = _boxes(answers, _BLOCKS, "Blocks").where("b.BlockType = 'WORD'")
    return rows.select("doc", "page", "ord", F.coalesce("b.Text", F.lit("")).alias("text"), "x0", "y0", "x1", "y1", "confidence")


def _children(rows: DataFrame, name: str) -> DataFrame:
    """(doc, page, {name}, rel, child, id) for the ids that blocks list as children."""
    r = rows.select("doc", "page", F.col("ord").alias(name), F.posexplode("b.Relationships").alias("rel", "r")).where("r.Type = 'CHILD'")
    return r.select("doc", "page", name, "rel", F.posexplode("r.Ids").alias("child", "id"))


def document_lines(answers: DataFrame) -> DataFrame:
    """Lines (doc, page, line, text, words, confidence) of a document reader's answers, from the blocks that each lists as children; one without children has no text."""
    rows = _boxes(answers, _BLOCKS, "Blocks")
    lines = rows.where("b.BlockType = 'LINE'")
    held = rows.select("doc", "page", F.col("b.Id").alias("id"), F.col("ord").alias("word"), F.coalesce("b.Text", F.lit("")).alias("text"))
    words = _children(lines, "line").join(held, ["doc", "page", "id"]).groupBy("doc", "page", "line").agg(F.array_sort(F.collect_list(F.struct("rel", "child", "word", "text"))).alias("w"))
    words = words.select("doc", "page", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.size("w").alias("words"))
    return lines.select("doc", "page", F.col("ord").alias("line"), "confidence").join(words, ["doc", "page", "line"], "left").na.fill("", ["text"]).na.fill(0, ["words"])


def document_cells(answers: DataFrame) -> DataFrame:
    """Cells of the tables in a document reader's answers, by the table that lists them and stands before them, with the table's size in rows and columns."""
    rows = _boxes(answers, _BLOCKS, "Blocks")
    cells = rows.where("b.BlockType = 'CELL'")
    held = rows.where("b.BlockType = 'WORD'").select("doc", "page", F.col("b.Id").alias("id"), F.col("ord").alias("word"), F.coalesce("b.Text", F.lit("")).alias("text"))
    kids = _children(cells, "cell")
    last = kids.groupBy("doc", "page", "cell").agg(F.max("rel").alias("rel"))
    words = kids.join(last, ["doc", "page", "cell", "rel"]).join(held, ["doc", "page", "id"]).groupBy("doc", "page", "cell").agg(F.array_sort(F.collect_list(F.struct("child", "word", "text"))).alias("w"))
    words = last.drop("rel").join(words, ["doc", "page", "cell"], "left").select("doc", "page", "cell", F.coalesce(F.array_join(F.transform("w", lambda x: x["text"]), " "), F.lit("")).alias("listed"))
    owner = _children(rows.where("b.BlockType = 'TABLE'"), "table").select("doc", "page", "table", "id").distinct()
    number = lambda c, d: F.coalesce(F.col(f"b.{c}"), F.lit(d))
    c = cells.select("doc", "page", F.col("ord").alias("cell"), F.col("b.Id").alias("id"), F.coalesce("b.Text", F.lit("")).alias("own"), number("RowIndex", 0).alias("row"), number("ColumnIndex", 0).alias("col"), number("RowSpan", 1).alias("row_span"), number("ColumnSpan", 1).alias("col_span"), "x0", "y0", "x1", "y1", "confidence")
    c = c.join(owner, ["doc", "page", "id"]).where(F.col("table") < F.col("cell")).join(words, ["doc", "page", "cell"], "left").withColumn("text", F.coalesce("listed", "own"))
    w = Window.partitionBy("doc", "page", "table")
    return c.select("doc", "page", "table", "row", "col", "row_span", "col_span", "text", "x0", "y0", "x1", "y1", "confidence", F.max("row").over(w).alias("rows"), F.max("col").over(w).alias("cols"))


def apply_undo(blocks: DataFrame, actions: DataFrame, redo: bool = False) -> DataFrame:
    """Blocks (block_id, text, ...) after one action each (block_id, old_text, new_text) is undone, or redone: the one text takes the other's place where it stands, else the block takes it whole."""
    gone, back = ("old_text", "new_text") if redo else ("new_text", "old_text")
    a = actions.select(F.col("block_id").alias("hit"), F.coalesce(gone, F.lit("")).alias("gone"), F.coalesce(back, F.lit("")).alias("back"))
    stands = (F.col("gone") != "") & F.contains("text", F.col("gone"))
    text = F.when(F.col("hit").isNull(), F.col("text")).when(stands, F.replace("text", F.col("gone"), F.col("back"))).otherwise(F.col("back"))
    return blocks.join(a, F.col("block_id") == F.col("hit"), "left").withColumn("text", text).select(*blocks.columns)


def change_report(changes: DataFrame) -> DataFrame:
    """Lines (section, page, block_id, line, text) of the Markdown report on changes (page, block_id, change_type, old_text, new_text); ordered by these they are the report.

    Section 0 is the head with its counts; 1 to 3 are the modified, removed and added blocks. Nothing changed gives a head alone.
    """
    n = lambda t: F.count_if(F.col("change_type") == t).cast("string")
    spaced = lambda c: F.replace(F.substring(c, 1, 50), F.lit("\n"), F.lit(" "))
    total = F.count("*").cast("string")
    some = F.array(
        F.concat(F.lit("# Change Report ("), total, F.lit(" changes)")), F.lit(""), F.lit("| Type | Count |"), F.lit("|------|-------|"),
        *[F.concat(F.lit(f"| {t.capitalize()} | "), n(t), F.lit(" |")) for t in ("modified", "added", "removed")], F.lit(""),
    )
    head = changes.agg(F.when(F.count("*") > 0, some).otherwise(F.array(F.lit("# Change Report"), F.lit(""), F.lit("No changes detected."))).alias("t"))
    head = head.select(F.lit(0).alias("section"), F.lit(None).cast("bigint").alias("page"), F.lit(None).cast("string").alias("block_id"), F.posexplode("t").alias("line", "text"))
    kinds = [("modified", 1), ("removed", 2), ("added", 3)]
    titles = changes.select("change_type").distinct()
    section = F.lit(None).cast("int")
    title = F.lit(None).cast("string")
    for kind, at in kinds:
        section = F.when(F.col("change_type") == kind, at).otherwise(section)
        title = F.when(F.col("change_type") == kind, f"## {kind.capitalize()} Blocks").otherwise(title)
    titles = titles.where(section.isNotNull()).select(section.alias("section"), F.lit(None).cast("bigint").alias("page"), F.lit(None).cast("string").alias("block_id"), F.posexplode(F.array(title, F.lit(""))).alias("line", "text"))
    page = F.col("page").cast("string")
    long = F.array(F.concat(F.lit("**Page "), page, F.lit("** ("), "block_id", F.lit(")")), F.concat(F.lit("- Old: `"), spaced("old_text"), F.lit("`")), F.concat(F.lit("- New: `"), spaced("new_text"), F.lit("`")), F.lit(""))
    brief = lambda c: F.array(F.concat(F.lit("- Page "), page, F.lit(": `"), F.substring(c, 1, 50), F.lit("`")))
    each = F.when(F.col("change_type") == "modified", long).when(F.col("change_type") == "removed", brief("old_text")).otherwise(brief("new_text"))
    body = changes.where(section.isNotNull()).select(section.alias("section"), F.col("page").cast("bigint").alias("page"), "block_id", F.posexplode(each).alias("line", "text"))
    return head.unionByName(titles).unionByName(body)
