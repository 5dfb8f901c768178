"""Sections from lines, paragraph differences with readable snippets, summaries of documents and of changes."""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .items import BARE, DEFINITION, FULL

# What a line that is no heading looks like, heading patterns, words that are headings or column labels, and sizes.
NO_HEADING = [
    r"^[•\-\*►▪]",
    r"(?i)^\d+\.?\d*\s*(V|W|A|mA|MHz|GHz|Mbps|mm|cm|kg|°C|K|psi|ft-lb|N|Nm|Ω|ohm|ns|ms|µs|bytes?|BTU|dB)",
    r"(?i)^\d+\s+bytes?$",
    r"^\d+\s*(x|×)\s*\d+",
    r"(?i)^(Figure|Table|Note)\s+\d",
    r"^\d{4}-\w{3}-\d{2}",
    r"(?i)^(NUMBER|CROSS SECTIONAL|RETRO REFLECTOR|HEMISPHERICAL)",
]
NUMBERED = r"^(\d+(?:\.\d+)*\.?)\s+([A-Za-z][A-Za-z\s&/,\-()]{2,})$"
CAPITALS = r"^[A-Z]{2,}(?:\s+[A-Z]{2,})+$"
HEADING_WORDS = ["PREFACE", "INTRODUCTION", "CONCURRENCE", "REFERENCES", "REQUIREMENTS", "APPENDIX", "GLOSSARY", "ACRONYMS", "SUMMARY", "CONTENTS", "ABSTRACT"]
COLUMN_LABELS = ["PARAGRAPH", "DESCRIPTION", "FIGURE", "TABLE", "PAGE", "NUMBER", "TITLE", "SECTION", "APPENDIX"]
LARGE_EXCEPT = ["NUMBER", "CROSS", "RETRO", "HEMI"]
LARGE, LONGEST, LONGEST_CAPITALS = 14, 80, 60
REFERENCE_PAGES = [
    r"(?i)(?:applicable|reference|referenced)\s+documents?",
    r"(?i)documents?\s+(?:applicable|referenced)",
    r"(?i)^\d+\.?\d*\s+(?:applicable|reference)\s+documents?",
]


def _any(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms)


def is_heading(line: Column, size: Column) -> Column:
    """Whether a trimmed line is a heading: not excluded, and numbered, in capitals, a known word or large."""
    short = F.length(line) < LONGEST
    capitals = line.rlike(CAPITALS) & (F.length(line) < LONGEST_CAPITALS)
    large = (size > LARGE) & short & line.rlike("[A-Za-z]{3,}") & ~_any([F.startswith(line, F.lit(x)) for x in LARGE_EXCEPT])
    rule = F.when(line.rlike(NUMBERED) & short, True).when(capitals, ~line.isin(COLUMN_LABELS)).when(line.isin(HEADING_WORDS), True).otherwise(large)
    return ~_any([line.rlike(p) for p in NO_HEADING]) & F.coalesce(rule, F.lit(False))


def line_sections(lines: DataFrame) -> DataFrame:
    """(doc, seg, heading, page, text) of the sections of lines (doc, page, ord, text, font_size); those without text are left out, and what stands before the first heading is the Preamble of page 1."""
    rows = lines.withColumn("line", F.trim("text")).where("line <> ''").withColumn("h", is_heading(F.col("line"), F.col("font_size")))
    rows = rows.withColumn("seg", F.count_if("h").over(Window.partitionBy("doc").orderBy("page", "ord")))
    body = F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("page", "ord", "line"))))
    g = rows.groupBy("doc", "seg").agg(F.max(F.when(F.col("h"), F.col("line"))).alias("heading"), F.max(F.when(F.col("h"), F.col("page"))).alias("page"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("text"), F.count_if(~F.col("h")).alias("n"))
    return g.where("n > 0").select("doc", "seg", F.coalesce("heading", F.lit("Preamble")).alias("heading"), F.coalesce("page", F.lit(1)).alias("page"), "text")


def paragraphs(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").split("\n") if p.strip()]


def line_change(old: str, new: str) -> str | None:
    """What changed between two lines in few words: up to three substituted words, or what one has more than the other."""
    a, b = old.split(), new.split()
    swapped = [(x, y) for x, y in zip(a, b) if x != y] if a and len(a) == len(b) else []
    if 0 < len(swapped) <= 3:
        return ", ".join(f"{x} → {y}" for x, y in swapped)
    for sign, part, whole in (("+", old, new), ("-", new, old)):
        rest = whole.replace(part, "").strip() if part in whole else ""
        if 0 < len(rest) < 60:
            return f'{sign} "{rest}"'
    return None


def paragraph_diff(old: str | None, new: str | None, most: int = 5) -> tuple[int, int, int, list[str]]:
    """Paragraphs added, removed and modified between two texts, and up to ``most`` snippets."""
    a, b = paragraphs(old), paragraphs(new)
    count, said = {"added": 0, "removed": 0, "modified": 0}, []

    def say(op: str, before: list[str], after: list[str]):
        for k in range(len(before) if op != "insert" else len(after)):
            if op == "replace" and k < len(after):
                was = before[k][:80].strip()
                yield line_change(was, after[k][:80].strip()) or f'Changed: "{was[:50]}..."'
            elif op == "replace":
                yield f'- "{before[k][:80].strip()[:60]}"'
            else:
                sign, line = ("+", after[k]) if op == "insert" else ("-", before[k])
                yield f'{sign} "{line[:70].strip()[:60]}"' if line[:70].strip() else None

    for op, i, j, x, y in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op == "equal":
            continue
        both = min(j - i, y - x)
        count["modified"] += both
        count["removed"] += j - i - both
        count["added"] += y - x - both
        # A run of lines takes no more places than were left when it began, blank ones included.
        room = most - len(said)
        said += [s for _, s in zip(range(room), say(op, a[i:j], b[x:y])) if s]
    return count["added"], count["removed"], count["modified"], said


DIFF = "struct<added:long,removed:long,modified:long,snippets:array<string>>"


def paragraph_changes(old: Column | str, new: Column | str) -> Column:
    """``paragraph_diff`` of two columns. Matching blocks of lines need Python's difflib; texts pass in Arrow batches."""

    @F.pandas_udf(DIFF)
    def changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([paragraph_diff(x, y) for x, y in zip(a, b)], columns=["added", "removed", "modified", "snippets"])

    return changes(old, new)


def _plural(n: Column, one: str, rest: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n != 1, "s").otherwise(""), F.lit(rest)))


def summary_line(values: Column, resolved: Column, introduced: Column, changes: Column, classification: Column) -> Column:
    """One line for a section: values and open items that changed, else paragraphs, else the kind of change."""
    items = F.concat_ws(", ", _plural(values, "value", " changed"), _plural(resolved, "TBD", " resolved"), _plural(introduced, "TBD", " introduced"))
    return F.when(items != "", items).otherwise(F.coalesce(_plural(changes, "paragraph", " modified"), F.concat(classification, F.lit(" changes"))))


def section_items(sections: DataFrame, around: int = 30) -> DataFrame:
    """(doc, section, item_id, item_type, owner, page, context) of open items in sections (doc, section, page, text).

    A full id counts once a section. Bare tokens are numbered within the section, a definition included, and
    named by page and number; one within reach of a full id is not counted.
    """
    keep = ["doc", "section", "page", "text"]
    held = sections.where(F.col("text").rlike(BARE))
    full = held.select(*keep, F.posexplode(T.spans("text", FULL)).alias("n", "s")).withColumn("item_id", F.col("s.match"))
    full = full.withColumn("k", F.row_number().over(Window.partitionBy("doc", "section", "item_id").orderBy("n"))).where("k = 1")
    full = full.withColumn("item_type", F.substring("item_id", 1, 3)).withColumn("owner", F.regexp_extract("item_id", r"^\w+-(.*)-\d+$", 1))
    bare = held.select(*keep, F.posexplode(T.spans("text", BARE)).alias("n", "s"))
    lo = F.greatest(F.col("s.start") - 5, F.lit(0))
    bare = bare.where(~F.substring("text", lo + 1, F.col("s.end") + 10 - lo).rlike(FULL))
    number = F.row_number().over(Window.partitionBy("doc", "section").orderBy("n"))
    bare = bare.withColumn("item_type", F.col("s.match")).withColumn("owner", F.lit(None).cast("string")).withColumn("item_id", F.format_string("%s-%03d-%02d", F.col("s.match"), F.col("page"), number))
    out = [d.select("doc", "section", "item_id", "item_type", "owner", "page", T.context("text", F.col("s.start"), F.col("s.end"), around).alias("context")) for d in (full, bare)]
    return out[0].unionByName(out[1].where(~_any([F.contains(F.lower("context"), F.lit(w)) for w in DEFINITION])))


def _first_page(blocks: DataFrame, n: int) -> DataFrame:
    """(doc, texts): the first n block texts of each document's first page, in order."""
    first = F.dense_rank().over(Window.partitionBy("doc").orderBy("page"))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("page", "ord"))
    rows = blocks.select("doc", "page", "ord", "text", first.alias("p"), nth.alias("k")).where((F.col("p") == 1) & (F.col("k") <= n))
    return rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))


def document_summary(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, revision, date, page_count, tbd_count, tbr_count, doc_type) of each document; TBC and TBS count as TBR, and any block from OCR (is_ocr) makes a document flattened."""
    ocr = F.bool_or("is_ocr") if "is_ocr" in blocks.columns else F.lit(False)
    docs = blocks.groupBy("doc").agg(F.count_distinct("page").alias("page_count"), F.first(ocr).alias("o") if "is_ocr" not in blocks.columns else ocr.alias("o"))
    head = _first_page(blocks, 10).select("doc", F.array_join("texts", " ").alias("head"))
    n = items.groupBy("doc").agg(F.count_if(F.col("item_type") == "TBD").alias("tbd_count"), F.count_if(F.col("item_type").isin("TBR", "TBC", "TBS")).alias("tbr_count"))
    rows = docs.join(head, "doc", "left").join(n, "doc", "left").fillna(0, ["tbd_count", "tbr_count"])
    return rows.select("doc", T.revision("head").alias("revision"), T.date_text("head").alias("date"), "page_count", "tbd_count", "tbr_count", F.when(F.col("o"), "flattened").otherwise("digital").alias("doc_type"))


def briefing(summaries: DataFrame) -> DataFrame:
    """One row of totals over document summaries."""
    return summaries.agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.sum("tbd_count").alias("tbds"), F.sum("tbr_count").alias("tbrs"), F.count_if(F.col("doc_type") == "flattened").alias("flattened"))


def document_title(blocks: DataFrame) -> DataFrame:
    """(doc, title): the longest of the first eight blocks of the first page with 6 to 199 characters, the first of several, else empty."""
    t = F.filter(F.transform("texts", lambda x: F.trim(x)), lambda x: (F.length(x) > 5) & (F.length(x) < 200))
    longest = F.aggregate(t, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return _first_page(blocks, 8).select("doc", longest.alias("title"))


def reference_pages(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) that speak of applicable or referenced documents."""
    return pages.where(_any([F.col("text").rlike(p) for p in REFERENCE_PAGES]))


def search_terms(stem: Column, title: Column, number: Column) -> Column:
    """Terms that name a document: its number, as written, with blanks and with hyphens, the words of its stem and the head of its title; of terms that differ by case only the first, and none below three letters."""
    words = F.replace(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    numbers = [F.nullif(number, F.lit("")), *[F.nullif(F.replace(number, F.lit("_"), F.lit(c)), F.lit("")) for c in (" ", "-")]]
    terms = F.array_compact(F.array(*numbers, F.when(F.length(words) > 3, words), F.when(F.length(title) > 10, F.substring(title, 1, 80))))
    low = F.transform(terms, lambda x: F.lower(F.trim(x)))
    return F.filter(terms, lambda x, i: (F.array_position(low, F.lower(F.trim(x))) == i + 1) & (F.length(F.trim(x)) >= 3))


def split_on_headings(text: Column) -> Column:
    """A block's text cut before each line like "3.17 Title" or "A.1 Title" that has lines before it; parts are trimmed, empty ones left out."""
    cut = F.split(F.regexp_replace(text, r"\n(?=[ \t]*[A-Z0-9]+(?:\.[0-9]+)+\.?\s+\S)", "\u0000"), "\u0000")
    parts = F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def table_cells(blocks: DataFrame, font_size: float = 10.0) -> DataFrame:
    """Cells (block_id, n, text, x0, y0, x1, y1) of table blocks (block_id, text, x0, y0, x1, y1): pairs of key and value if four lines or more and even, else a line a row; a single line keeps the block's place."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = blocks.withColumn("lines", lines).withColumn("k", F.size("lines")).withColumn("two", (F.col("k") % 2 == 0) & (F.col("k") >= 4))
    cells = rows.where("k >= 2").select("*", F.posexplode("lines").alias("n", "cell"))
    row = F.when(F.col("two"), F.floor(F.col("n") / 2)).otherwise(F.col("n"))
    height = (F.col("y1") - F.col("y0")) / F.when(F.col("two"), F.col("k") / 2).otherwise(F.col("k"))
    y, mid = F.col("y0") + row * height + 2.0, (F.col("x0") + F.col("x1")) / 2
    right = F.col("two") & (F.col("n") % 2 == 1)
    out = cells.select("block_id", "n", F.col("cell").alias("text"), F.when(right, mid + 3).otherwise(F.col("x0") + 3).alias("x0"), y.alias("y0"), F.when(F.col("two") & ~right, mid - 3).otherwise(F.col("x1") - 3).alias("x1"), (y + font_size * 1.2).alias("y1"))
    whole = rows.where("k < 2").select("block_id", F.lit(0).alias("n"), "text", "x0", "y0", "x1", "y1")
    return out.unionByName(whole)
