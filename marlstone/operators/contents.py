"""Tables of contents read from the spans of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The part of a page that is read, the line that is a heading itself, what a line with leader dots, a page number and a section number look like.
TOP, BOTTOM, TITLE = 60.0, 700.0, "table of contents"
LEADER, NUMBER, PREFIX = r"^(.+?)\.{3,}\s*([ivxlcdmIVXLCDM\d]+)?\s*$", r"^\d+$", r"^\d+\."
#: References that make a page a table of contents.
REFERENCES = 3


def table_of_contents(spans: DataFrame) -> DataFrame:
    """(doc, page, place, title, page_ref, y, indent): the entries of pages that are tables of contents, from spans (doc, page, ord, x0, y0, text).

    A line with more than five points is a title and its page, a number alone the page of the entry before it (the last of several counts), and a
    section number such as ``3.`` joins the entry after it, which may be a number itself: of numbers in a row the first takes the second, the third
    the fourth. Other lines of more than three characters are entries too. A page counts if at least REFERENCES entries have a page.
    """
    text = F.trim("text")
    rows = spans.withColumn("t", text).where((F.col("t") != "") & F.col("y0").between(TOP, BOTTOM) & ~F.contains(F.lower("t"), F.lit(TITLE)))
    dots = F.length(F.regexp_replace("t", r"[^.]", "")) > 5
    led = dots & F.col("t").rlike(LEADER)
    cut = F.trim(F.regexp_replace("t", r"\.{3,}.*$", ""))
    kind = F.when(led, "entry").when(dots, F.when(cut != "", "entry")).when(F.col("t").rlike(NUMBER), "number").when(F.col("t").rlike(PREFIX), "prefix").when(F.length("t") > 3, "entry")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    rows = rows.withColumn("title", F.when(led, F.trim(F.regexp_extract("t", LEADER, 1))).when(dots, cut).otherwise(F.col("t"))).withColumn("ref", F.when(led, F.regexp_extract("t", LEADER, 2)).otherwise(""))
    page = Window.partitionBy("doc", "page")
    order = page.orderBy("ord")
    rows = rows.withColumn("n", F.count_if(F.col("kind") != "number").over(order)).where("n > 0")
    number = F.max_by(F.when(F.col("kind") == "number", F.col("t")), F.when(F.col("kind") == "number", F.col("ord"))).over(Window.partitionBy("doc", "page", "n"))
    entries = rows.withColumn("ref", F.coalesce(number, "ref")).where("kind <> 'number'")
    # Prefixes in a row are counted from 0; those of an even number take what follows.
    run = F.count_if(F.col("kind") != "prefix").over(order)
    entries = entries.withColumn("run", run).withColumn("at", F.when(F.col("kind") == "prefix", F.count_if(F.col("kind") == "prefix").over(Window.partitionBy("doc", "page", "run").orderBy("ord")) - 1))
    takes = F.coalesce(F.col("at") % 2 == 0, F.lit(False))
    entries = entries.withColumn("takes", takes).withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))
    entries = entries.withColumn("next_title", F.lead("title").over(order)).withColumn("next_ref", F.lead("ref").over(order)).where("not taken")
    joins = F.col("takes") & F.col("next_title").isNotNull()
    out = entries.select(
        "doc", "page", "ord", F.when(joins, F.concat("title", F.lit(" "), "next_title")).otherwise(F.col("title")).alias("title"),
        F.when(joins & (F.col("next_ref") != ""), F.col("next_ref")).otherwise(F.col("ref")).alias("page_ref"), F.col("y0").alias("y"), (F.col("x0") - 90).alias("indent"),
    )
    counted = out.withColumn("refs", F.count_if(F.col("page_ref") != "").over(page)).where(F.col("refs") >= REFERENCES)
    return counted.select("doc", "page", (F.row_number().over(order) - 1).alias("place"), "title", "page_ref", "y", "indent")
