"""A searchable collection: documents indexed under several configurations, searched and asked.

The indices are tables of ``sources.tables``, one for each configuration, which change together in one version.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import index_name
from ..sources.tables import Tables
from . import chunking, retrieval
from .providers import Embedder, ExtractiveGenerator, Generator, HashingEmbedder

# What is said where nothing is found or no answer could be made.
NOTHING = "I could not find any relevant content in the indexed documents for this query."
NOTHING_WARNING = "No matching content found in the indexed ICD corpus."
FAILED = "I encountered an error generating a synthesized answer. Here are the most relevant passages:\n\n"
#: Passages that stand in for an answer that failed.
PASSAGES = 3


@dataclass
class Configuration:
    """How documents are cut and embedded for one index."""

    name: str
    strategy: str
    options: dict = field(default_factory=dict)
    embedder: Embedder = field(default_factory=HashingEmbedder)

    @property
    def index(self) -> str:
        return index_name(self.name)


class Collection:
    """Indices of all configurations over one set of documents."""

    def __init__(self, tables: Tables, configurations: list[Configuration]):
        if not configurations or len({c.index for c in configurations}) < len(configurations):
            raise ValueError("configurations need names of their own")
        self.tables, self.configurations = tables, configurations

    def ingest(self, elements: DataFrame) -> DataFrame:
        """Index the documents of elements (doc, title, page, y, kind, ord, text) anew under all configurations: what was indexed of them before goes in the same version.

        A document without elements keeps what it has. Chunks without a vector of the configuration's size are put into ``<index>__quarantine``. Gives (index, n_chunks, n_rejected),
        zeros where a configuration makes no chunks.
        """
        titles = elements.groupBy("doc").agg(F.min("title").alias("title"))
        docs = elements.select(F.col("doc").alias("document_hash")).distinct()
        put, drop, split = {}, {}, {}
        elements = elements.repartition("doc")  # once for all windows and groups of a strategy, which go by document
        for c in self.configurations:
            chunks = chunking.chunk_document(elements.drop("title"), c.strategy, **c.options).join(titles, "doc")
            rows = chunks.select(
                F.col("doc").alias("document_hash"), F.col("title").alias("document_title"), F.concat_ws("_", "doc", "chunk").alias("chunk_id"), F.col("chunk").cast("int").alias("chunk"), F.col("page").cast("int").alias("page"),
                "content_type", "section_heading", "text", c.embedder.embed(F.col("text")).alias("embedding"),
            )
            whole = F.coalesce(F.size("embedding") == c.embedder.dims, F.lit(False))
            put[c.index], split[c.index] = rows, (whole, f"{c.index}__quarantine")
            drop[c.index] = drop[f"{c.index}__quarantine"] = docs
        at = self.tables.commit(put=put, drop=drop, split=split)
        count = lambda n: self.tables.read(n, at).join(docs, "document_hash", "left_semi").agg(F.count("*").alias("n"))
        parts = [count(c.index).select(F.lit(c.index).alias("index"), F.col("n").alias("n_chunks")).crossJoin(count(f"{c.index}__quarantine").select(F.col("n").alias("n_rejected"))) for c in self.configurations]  # one row each
        return reduce(DataFrame.unionByName, parts)

    def chunks(self, configuration: Configuration | None = None) -> DataFrame:
        return self.tables.read((configuration or self.configurations[0]).index)

    def best(self, runs: DataFrame | None) -> Configuration:
        """The configuration of the best row of the last run (run_id, config, mean_recall), by the part of its name before a slash; the first one if there is no run or it names none."""
        if runs is not None:
            top = runs.orderBy(F.desc("run_id"), F.desc("mean_recall"), "config").limit(1).collect()
            for c in self.configurations:
                if top and top[0].config.split("/")[0] == c.name:
                    return c
        return self.configurations[0]

    def search(self, queries: DataFrame, mode: str = "rrf", k: int = 10, by: dict | None = None, configuration: Configuration | None = None, runs: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score) for queries (query_id, query), under a configuration or the best of the last run. Queries may be embedded otherwise than documents."""
        c = configuration or self.best(runs)
        rows = self.chunks(c)
        embed = getattr(c.embedder, "embed_query", c.embedder.embed)
        asked = queries.select("query_id", embed(F.col("query")).alias("embedding"))
        return retrieval.search(rows, rows, queries, asked, mode, k, by)

    def ask(self, queries: DataFrame, k: int = 8, mode: str = "rrf", generator: Generator | None = None, configuration: Configuration | None = None, runs: DataFrame | None = None) -> DataFrame:
        """Answers with their evidence, see ``answer``; one row a query."""
        c = configuration or self.best(runs)
        return answer(self.search(queries, mode, k, configuration=c), self.chunks(c), queries, generator)


def answer(results: DataFrame, chunks: DataFrame, queries: DataFrame, generator: Generator | None = None) -> DataFrame:
    """(query_id, answer, generated, confidence, n_passages, open_items, contractual, warning) for each query (query_id, query).

    The generator sees the question and the numbered passages of the results. Where it gives null, the answer is an apology and the first PASSAGES passages; a query without
    results is told so, with low confidence and a warning.
    """
    context = retrieval.context(results, chunks)
    made = (generator or ExtractiveGenerator()).answer(F.col("query"), F.col("context"))
    rows = queries.select("query_id", "query").join(context, "query_id", "left").withColumn("_made", F.when(F.col("context").isNotNull(), made))
    passages = F.concat(F.array_join(F.slice(F.split("context", "\n\n"), 1, PASSAGES), "\n\n"), F.lit("\n\n"))
    rows = rows.withColumn("answer", F.when(F.col("context").isNull(), NOTHING).otherwise(F.coalesce("_made", F.concat(F.lit(FAILED), passages))))
    rows = rows.withColumn("generated", F.col("_made").isNotNull())
    said = rows.select("query_id", "answer")
    sure = retrieval.confidence(results, said).select("query_id", "confidence")
    flags = retrieval.warnings(results.join(chunks.select("chunk_id", "text"), "chunk_id"), said)
    none = F.col("n_passages").isNull()
    return rows.join(sure, "query_id").join(flags, "query_id").select(
        "query_id", "answer", "generated", "confidence", F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"), "open_items", F.when(none, False).otherwise(F.col("contractual")).alias("contractual"), F.when(none, NOTHING_WARNING).alias("warning")
    )


def table_text(table: Column) -> Column:
    """A table of the document IR as text to search: cells joined by bars in the order of its columns, a line a row; missing cells are empty."""
    cell = lambda r, c: F.coalesce(F.try_element_at(r["cells"], c["id"])["value"], F.lit(""))
    return F.array_join(F.transform(table["rows"], lambda r: F.array_join(F.transform(table["columns"], lambda c: cell(r, c)), " | ")), "\n")
