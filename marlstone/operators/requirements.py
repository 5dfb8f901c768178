"""Requirements and semantic validation of blocks (doc, page, ord, block_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# References to sections and tables, headings with numbers, names of tables; requirement ids and leading section numbers.
SECTION_REF, TABLE_REF = r"[Ss]ection\s+(\d+[\.\d]*)", r"[Tt]able\s+([\d\.]+[-\d]*)"
HEADING, TABLE_NAME = r"^(\d+[\.\d]*\.?)\s+\S", r"^[Tt]able\s+([\d\.]+[-\d]*)"
REQUIREMENT, NUMBER = r"\b([A-Z]{2,}-[A-Z0-9]+-\d+|REQ-\d+)\b", r"^(\d+\.[\d.]*\d)"
# Normative terms in order of priority with their confidence.
TERMS = {"shall": 0.95, "must": 0.85, "will": 0.70, "should": 0.70}


def extract(blocks: DataFrame) -> DataFrame:
    """Blocks with a normative term (with blanks around, or at the start): term, section so far, first requirement id, open item, confidence."""
    low = F.lower("text")
    term, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for t, c in reversed(TERMS.items()):
        has = F.contains(low, F.lit(f" {t} ")) | F.startswith(low, F.lit(f"{t} "))
        term, sure = F.when(has, t).otherwise(term), F.when(has, c).otherwise(sure)
    number = F.nullif(F.regexp_extract(F.trim("text"), NUMBER, 1), F.lit(""))
    w = Window.partitionBy("doc").orderBy("page", "ord")
    rows = blocks.withColumn("section", F.last(number, ignorenulls=True).over(w)).withColumn("normative_term", term).withColumn("confidence", sure)
    rid = F.nullif(F.regexp_extract("text", REQUIREMENT, 1), F.lit(""))
    return rows.where(F.col("normative_term").isNotNull()).select(
        "doc", "page", "block_id", "normative_term", "section", rid.alias("requirement_id"), "confidence", F.col("text").rlike(r"\b(TBD|TBR|TBC|TBS)\b").alias("has_tbd"), F.trim("text").alias("text")
    )


def counts(requirements: DataFrame) -> DataFrame:
    return requirements.groupBy("normative_term").agg(F.count("*").alias("n"), F.count_if("has_tbd").alias("n_tbd"), F.count("requirement_id").alias("n_with_id"))


def sections(blocks: DataFrame) -> DataFrame:
    """(doc, number): the numbers of headings, without a point at the end."""
    number = F.rtrim(F.regexp_extract(F.trim("text"), HEADING, 1), F.lit("."))
    return blocks.select("doc", number.alias("number")).where("number <> ''").distinct()


def _references(blocks: DataFrame) -> DataFrame:
    """References to sections and tables that the document does not define, with their place: section references of a block come before its table references."""
    t = F.trim("text")
    is_table = F.startswith(t, F.lit("Table "))
    tables = blocks.where(is_table).select("doc", F.regexp_extract(t, TABLE_NAME, 1).alias("target")).where("target <> ''").distinct()

    def missing(rows, pattern, defined, severity, kind, bare):
        refs = rows.where(F.col("text").rlike(pattern)).select("doc", "page", "ord", "block_id", F.posexplode(T.found("text", pattern, 1)).alias("n", "target"))
        refs = refs.withColumn("target", F.rtrim("target", F.lit("."))) if bare else refs
        return refs.join(defined, ["doc", "target"], "left_anti").select("doc", "page", "ord", "block_id", "n", F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "target")

    return missing(blocks, SECTION_REF, sections(blocks).withColumnRenamed("number", "target"), "warning", "section", True).unionByName(missing(blocks.where(~is_table), TABLE_REF, tables, "info", "table", False))


def unresolved_references(blocks: DataFrame) -> DataFrame:
    """References to sections and tables that the document does not define."""
    return _references(blocks).select("doc", "page", "block_id", "severity", "kind", "target")


def numbering_gaps(sections: DataFrame, compat: bool = False) -> DataFrame:
    """Gaps between neighbouring top-level numbers of (doc, number). ``compat`` sorts all numbers as strings, so 10 follows 1 and a dotted number hides a gap."""
    rows = sections.select("doc", "number").distinct()
    if not compat:
        rows = rows.where(~F.contains("number", F.lit(".")))
    order = F.col("number") if compat else F.col("number").cast("int")
    rows = rows.withColumn("prev", F.lag("number").over(Window.partitionBy("doc").orderBy(order)))
    plain = ~F.contains("number", F.lit(".")) & ~F.contains("prev", F.lit("."))
    return rows.where(plain & (F.col("number").cast("int") - F.col("prev").cast("int") > 1)).select("doc", "prev", "number")


# Severities in their order.
SEVERITIES = ("error", "warning", "info")


def validate(blocks: DataFrame, compat: bool = False) -> DataFrame:
    """(doc, place, severity, category, message, page, block_id): what is wrong with each document, by severity, then where it stands; gaps in the numbering come after references.

    Unresolved section references and gaps are warnings, table references to be checked infos. ``compat`` finds gaps in the order of strings.
    """
    refs = _references(blocks)
    said = F.when(F.col("kind") == "section", F.concat(F.lit("Section "), "target", F.lit(" referenced but not found as a heading"))).otherwise(F.concat(F.lit("Table "), "target", F.lit(" referenced — verify it exists")))
    refs = refs.select("doc", "severity", F.lit("cross_ref").alias("category"), said.alias("message"), F.col("page").cast("int").alias("page"), "block_id", F.lit(0).alias("turn"), F.col("ord").cast("double").alias("at"), "n", F.lit("").alias("word"))
    gaps = numbering_gaps(sections(blocks), compat)
    gaps = gaps.select(
        "doc", F.lit("warning").alias("severity"), F.lit("structure").alias("category"), F.concat(F.lit("Gap in section numbering: "), "prev", F.lit(" → "), "number").alias("message"), F.lit(0).alias("page"), F.lit("").alias("block_id"),
        F.lit(1).alias("turn"), (F.lit(0.0) if compat else F.col("number").cast("double")).alias("at"), F.lit(0).alias("n"), F.col("number").alias("word"),
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    w = Window.partitionBy("doc").orderBy(rank, "turn", "page", "at", "block_id", "n", "word")
    return refs.unionByName(gaps).withColumn("place", F.row_number().over(w) - 1).select("doc", "place", "severity", "category", "message", "page", "block_id")
