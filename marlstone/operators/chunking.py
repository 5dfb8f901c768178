"""Chunkers: paragraph, section, sliding window and fixed words, behind a registry.

Elements are rows (doc, page, y, kind, ord, text), kind one of heading, text, table; a chunk is
a row (doc, page, chunk, content_type, section_heading, text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KIND_ORDER = {"heading": 0, "text": 1, "table": 2}
STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    def put(f):
        STRATEGIES[name] = f
        return f

    return put


def chunk_document(elements: DataFrame, name: str, **options) -> DataFrame:
    if name not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy: {name}")
    return STRATEGIES[name](elements, **options)


def _order(*more) -> list:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv]), F.col("kind"))
    return [F.col("page"), F.col("y"), kind, F.col("ord"), *more]


def pack_sentences(text: Column, max_tokens: int) -> Column:
    """Sentences filled into parts greedily; one above the budget is a part of its own. An ordered fold."""
    pieces = F.split(text, r"(?<=[.!?])\s+")
    empty = F.array().cast("array<string>")

    def add(acc, s):
        n = T.token_estimate(s)
        full = (acc["n"] + n > max_tokens) & (F.size(acc["now"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.concat(acc["now"], F.array(s))).alias("now"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    start = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(pieces, start, add, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]))


def _split(text: Column, max_tokens: int) -> Column:
    return F.when(T.token_estimate(text) > max_tokens, pack_sentences(text, max_tokens)).otherwise(F.array(text))


@strategy("paragraph")
def paragraphs(elements: DataFrame, max_tokens: int = 512) -> DataFrame:
    """A chunk per element; the heading carries forward within its page; long texts are split at sentences."""
    w = Window.partitionBy("doc", "page").orderBy(*_order())
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w)
    parts = F.when(F.col("kind") == "text", _split(F.col("text"), max_tokens)).otherwise(F.array("text"))
    rows = elements.withColumn("section_heading", heading).where((F.col("kind") == "heading") | (F.trim("text") != ""))
    rows = rows.select("*", F.posexplode(parts).alias("part", "piece"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy(*_order("part"))) - 1
    kind = F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind"))
    return rows.select("doc", "page", number.alias("chunk"), kind.alias("content_type"), "section_heading", F.col("piece").alias("text"))


@strategy("section")
def sections(elements: DataFrame, max_tokens: int = 1024, prefix: bool = True) -> DataFrame:
    """A chunk per section: the texts between two headings, over pages, in order; long sections are split at sentences."""
    w = Window.partitionBy("doc").orderBy(*_order())
    rows = elements.withColumn("seg", F.sum((F.col("kind") == "heading").cast("int")).over(w)).withColumn("at", F.row_number().over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") != "heading") & (F.trim("text") != ""), F.struct("at", "text")))), lambda x: x["text"]), "\n")
    secs = rows.groupBy("doc", "seg").agg(F.min("page").alias("page"), F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("section_heading"), body.alias("body"))
    secs = secs.where(F.trim("body") != "")
    whole = F.when(F.lit(prefix) & F.col("section_heading").isNotNull(), F.concat("section_heading", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    parts = secs.select("*", F.posexplode(_split(whole, max_tokens)).alias("part", "text"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("seg", "part")) - 1
    return parts.select("doc", "page", number.alias("chunk"), F.lit("section").alias("content_type"), "section_heading", "text")


def windows(texts: DataFrame, size: int, step: int, *carry: str) -> DataFrame:
    """(doc, chunk, text, carried columns) from (doc, words, ...): windows of ``size`` words every ``step`` words while a start is left."""
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))
    rows = texts.where(F.size("words") > 0).select("doc", "words", *carry, F.posexplode(starts).alias("chunk", "at"))
    return rows.select("doc", "chunk", F.array_join(F.slice("words", F.col("at") + 1, size), " ").alias("text"), *carry)


def window_size(max_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    size, overlap = max_tokens * 10 // 13, overlap_tokens * 10 // 13
    return size, max(1, size - overlap)


@strategy("sliding_window")
def sliding(elements: DataFrame, max_tokens: int = 512, overlap_tokens: int = 64) -> DataFrame:
    """Windows over a document's words in order; the page is that of the first word. Tables are not read."""
    size, step = window_size(max_tokens, overlap_tokens)
    rows = elements.where(F.col("kind") != "table").withColumn("w", F.transform(T.words("text"), lambda x: F.struct(x.alias("word"), F.col("page").alias("page"))))
    key = F.struct("page", "y", F.when(F.col("kind") == "text", 0).otherwise(1), "ord", "w")
    docs = rows.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["w"])).alias("words"))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(step))
    cut = docs.where(F.size("words") > 0).select("doc", "words", F.posexplode(starts).alias("chunk", "at")).withColumn("cut", F.slice("words", F.col("at") + 1, size))
    return cut.select("doc", F.element_at("cut", 1)["page"].alias("page"), "chunk", F.lit("window").alias("content_type"), F.lit(None).cast("string").alias("section_heading"), F.array_join(F.transform("cut", lambda x: x["word"]), " ").alias("text"))


@strategy("fixed_words")
def fixed(elements: DataFrame, max_tokens: int = 512) -> DataFrame:
    return sliding(elements, max_tokens, 0)


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc").agg(F.count("*").alias("n_chunks"), F.sum(T.token_estimate("text")).alias("n_tokens"))
