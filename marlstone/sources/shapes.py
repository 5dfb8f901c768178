"""Records of several shapes as VARIANT: pages of two forms, vectors of five, answers of a search service. What does not parse is kept apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parse(rows: DataFrame, text: str = "text", into: str = "v") -> tuple[DataFrame, DataFrame]:
    """Rows whose text is a JSON object, with the variant ``into``, and the others as they are: null, broken or another kind of value."""
    v = F.try_parse_json(F.col(text))
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return rows.where(good).withColumn(into, v), rows.where(~good)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def value(v: Column, path: str, kind: str, default=None) -> Column:
    """The value at a path; ``default`` where the path is not there. A null that is there stays null, as does what is of another type."""
    return _at(v, path, kind) if default is None else F.when(_at(v, path).isNull(), F.lit(default).cast(kind)).otherwise(_at(v, path, kind))


def array(v: Column, path: str) -> Column:
    """The elements at a path as variants; none where there is no array."""
    return F.coalesce(_at(v, path, "array<variant>"), F.array().cast("array<variant>"))


HEADING = "array<struct<text:string,y:double,section_number:string>>"
TEXT = "array<struct<text:string,y:double>>"


def _entry(b: Column) -> Column:
    return F.struct(_at(b, "$.text", "string").alias("text"), value(b, "$.y", "double", 0.0).alias("y"))


def normalized_page(v: Column) -> Column:
    """(page_number, headings, text_blocks, tables) of a page variant of either form.

    A page with headings, or whose first block has ``text`` and no ``text_verbatim``, is in the plain form and taken as it is. In the other form
    blocks of the type heading become headings with the number before their text, the others text blocks, blank ones go, and a table's place is that of its box.
    """
    blocks, headings = array(v, "$.text_blocks"), array(v, "$.headings")
    first = F.get(blocks, 0)
    plain = (F.size(headings) > 0) | (_at(first, "$.text").isNotNull() & _at(first, "$.text_verbatim").isNull())
    verbatim = lambda b: F.when(_at(b, "$.text_verbatim").isNotNull(), _at(b, "$.text_verbatim", "string")).otherwise(_at(b, "$.text", "string"))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    held = F.filter(blocks, lambda b: F.coalesce(trimmed(verbatim(b)) != "", F.lit(False)))
    is_heading = lambda b: F.coalesce(value(b, "$.block_type", "string", "paragraph") == "heading", F.lit(False))
    y = lambda b: F.coalesce(_at(b, "$.bbox.y0", "double"), F.lit(0.0))
    split_h = F.transform(F.filter(held, is_heading), lambda b: F.struct(trimmed(verbatim(b)).alias("text"), y(b).alias("y"), T.section_number(trimmed(verbatim(b))).alias("section_number")))
    split_t = F.transform(F.filter(held, lambda b: ~is_heading(b)), lambda b: F.struct(trimmed(verbatim(b)).alias("text"), y(b).alias("y")))
    as_is = F.transform(headings, lambda b: F.struct(_at(b, "$.text", "string").alias("text"), value(b, "$.y", "double", 0.0).alias("y"), _at(b, "$.section_number", "string").alias("section_number")))
    tables = F.transform(array(v, "$.tables"), lambda t: F.struct(F.when(plain, value(t, "$.y", "double", 0.0)).otherwise(y(t)).alias("y"), F.to_json(_at(t, "$.rows")).alias("rows"), F.to_json(_at(t, "$.cells")).alias("cells")))
    return F.struct(
        value(v, "$.page_number", "int", 0).alias("page_number"), F.when(plain, as_is.cast(HEADING)).otherwise(split_h.cast(HEADING)).alias("headings"),
        F.when(plain, F.transform(blocks, _entry).cast(TEXT)).otherwise(split_t.cast(TEXT)).alias("text_blocks"), tables.alias("tables"),
    )


def elements(pages: DataFrame, v: str, *keys: str) -> DataFrame:
    """(keys, page, kind, ord, y, text, section_number): headings and text blocks of normalised pages, as the chunkers take them."""
    rows = pages.select(*keys, normalized_page(F.col(v)).alias("_p")).withColumn("page", F.col("_p.page_number"))
    h = rows.select(*keys, "page", F.lit("heading").alias("kind"), F.posexplode("_p.headings").alias("ord", "e")).select(*keys, "page", "kind", "ord", "e.y", "e.text", "e.section_number")
    t = rows.select(*keys, "page", F.lit("text").alias("kind"), F.posexplode("_p.text_blocks").alias("ord", "e")).select(*keys, "page", "kind", "ord", "e.y", "e.text", F.lit(None).cast("string").alias("section_number"))
    return h.unionByName(t)


def _numbers(v: Column, path: str) -> Column:
    """The array at a path if its first element is a number."""
    kind = F.schema_of_variant(_at(v, path + "[0]"))
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), _at(v, path, "array<double>"))


# Names under which services put a vector, in the order in which they are tried.
VECTOR_PATHS = ("$.embedding", "$.embeddings[0]", "$.embeddings", "$.embeddings.float[0]", "$.embeddings.int8[0]", "$.embeddings.uint8[0]", "$.vector", "$.data", "$.output")


def vector(v: Column) -> Column:
    """The vector in an answer of any of the known shapes; null if none has it."""
    return reduce(lambda a, b: F.coalesce(a, b), [_numbers(v, p) for p in VECTOR_PATHS])


def search_totals(v: Column) -> Column:
    """(took_ms, total_hits) of a search answer, 0 where missing."""
    return F.struct(value(v, "$.took", "long", 0).alias("took_ms"), value(v, "$.hits.total.value", "long", 0).alias("total_hits"))


def search_hits(answers: DataFrame, v: str, *keys: str) -> DataFrame:
    """A row for each hit of search answers, in order (rank from 1), with the service's defaults for missing fields; the chunk's id is the hit's own where the source has none."""
    rows = answers.select(*keys, F.posexplode(array(F.col(v), "$.hits.hits")).alias("rank", "h"))
    h = F.col("h")
    own = F.when(_at(h, "$._source.chunk_id").isNull(), value(h, "$._id", "string", "")).otherwise(_at(h, "$._source.chunk_id", "string"))
    text = lambda n, d="": value(h, f"$._source.{n}", "string", d).alias(n)
    return rows.select(
        *keys, (F.col("rank") + 1).alias("rank"), own.alias("chunk_id"), text("text"), value(h, "$._score", "double", 0.0).alias("score"), text("document_hash"), text("document_title"),
        value(h, "$._source.page_number", "int", 0).alias("page_number"), text("section_heading", None), text("section_number", None), text("content_type", "paragraph"), F.coalesce(F.to_json(_at(h, "$._source.metadata")), F.lit("{}")).alias("metadata"),
    )


def table_text(table: Column) -> Column:
    """A table variant as text to search: rows that are arrays or hold cells as lines, their cells joined by bars; without rows the texts of its cells. Nulls count as empty."""
    rows, cells = array(table, "$.rows"), array(table, "$.cells")
    plain = lambda r: F.transform(F.coalesce(_at(r, "$", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.coalesce(_at(c, "$", "string"), F.lit("")))
    texts = lambda cs: F.transform(cs, lambda c: F.coalesce(_at(c, "$.text", "string"), F.lit("")))
    is_list = lambda r: F.coalesce(F.schema_of_variant(r).startswith("ARRAY"), F.lit(False))
    line = lambda r: F.array_join(F.when(is_list(r), plain(r)).otherwise(texts(array(r, "$.cells"))), " | ")
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, line), "\n")).otherwise(F.array_join(F.filter(texts(cells), lambda t: t != ""), " | "))
