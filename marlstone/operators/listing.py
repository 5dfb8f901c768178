"""Lists and small rules: documents and pages to choose, page ranges, costs, configurations, shapes on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Predefined index configurations (name, model, dimensions, strategy, tokens, overlap, cost of 1,000 tokens) and strategies.
CONFIGS = [
    ("titan-v2-paragraph", "amazon.titan-embed-text-v2:0", 1024, "paragraph", 512, 0, 0.0001),
    ("titan-v2-section", "amazon.titan-embed-text-v2:0", 1024, "section", 1024, 0, 0.0001),
    ("titan-v2-sliding", "amazon.titan-embed-text-v2:0", 1024, "sliding_window", 256, 64, 0.0001),
    ("cohere-en-paragraph", "cohere.embed-english-v3", 1024, "paragraph", 512, 0, 0.0001),
]
STRATEGIES = ["paragraph", "section", "sliding_window"]
# Prices in dollars: a page of text, of tables, of diagrams; tokens in and out and their price for a classification and a second opinion.
PRICES = {"textract_text": 0.0015, "textract_tables": 0.015, "rekognition": 0.001, "bedrock_classify": 1000 * 0.00006 / 1000 + 100 * 0.00025 / 1000, "bedrock_disambiguate": 1500 * 0.003 / 1000 + 50 * 0.015 / 1000}
CONFLICTS = 0.05


def short_model(model: Column | str) -> Column:
    """A model's name after the last point and before the first colon."""
    return F.split_part(F.element_at(F.split(T.col(model), r"\."), -1), F.lit(":"), F.lit(1))


def index_name(model: Column | str, strategy: Column | str, dims: Column | str) -> Column:
    return F.concat(F.lit("icd-"), short_model(model), F.lit("-"), T.col(strategy), F.lit("-"), T.col(dims).cast("string"), F.lit("d"))


def configurations(spark) -> DataFrame:
    """The predefined index configurations with their index names."""
    rows = spark.createDataFrame(CONFIGS, "name string, model_id string, dims int, strategy string, max_tokens int, overlap int, cost_per_1k_tokens double")
    return rows.withColumn("index_name", index_name("model_id", "strategy", "dims"))


def model_configurations(models: DataFrame) -> DataFrame:
    """A configuration for each model (model_id, dims, max_tokens, cost_per_1k_tokens) and strategy; what a model does not tell is 1,024 dimensions, 512 tokens and 0.0001, and tokens stop at 1,024."""
    rows = models.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])))
    known = lambda c, v: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(v))
    return rows.select(F.concat(short_model("model_id"), F.lit("-"), "strategy").alias("name"), "model_id", known("dims", 1024).alias("dims"), "strategy", F.least(known("max_tokens", 512), F.lit(1024)).alias("max_tokens"), known("cost_per_1k_tokens", 0.0001).alias("cost_per_1k_tokens"))


def page_range(spec: Column, pages: Column) -> Column:
    """Page numbers of a range like "1-3,5" within 1 to ``pages``, in the order written; null means all."""
    part = lambda p, k: F.trim(F.split_part(p, F.lit("-"), F.lit(k))).cast("int")
    one = lambda p: F.when(F.contains(p, F.lit("-")), F.when(part(p, 1) <= part(p, 2), F.sequence(part(p, 1), part(p, 2))).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.trim(p).cast("int")))
    listed = F.filter(F.flatten(F.transform(F.split(spec, ","), one)), lambda p: (p >= 1) & (p <= pages))
    every = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    return F.when(spec.isNull(), every).otherwise(listed)


def cost_estimate(documents: DataFrame) -> DataFrame:
    """Cost of documents (doc, pages, tables, diagrams) by service and in all; one page in twenty, one at least, takes a second opinion."""
    conflicts = F.greatest(F.lit(1), F.floor(F.col("pages") * CONFLICTS))
    units = {"textract_text": F.col("pages"), "textract_tables": F.col("tables"), "rekognition": F.col("diagrams"), "bedrock_classify": F.col("pages"), "bedrock_disambiguate": conflicts}
    rows = documents.select("doc", *[(n * PRICES[k]).alias(k) for k, n in units.items()])
    return rows.withColumn("total", sum((F.col(k) for k in units), F.lit(0.0)))


def suite(queries: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Queries (query_id, ...) with their document: that of the first prefix that stands in the id, else _other."""
    doc = F.lit("_other")
    for prefix, name in reversed(list(prefixes.items())):
        doc = F.when(F.contains("query_id", F.lit(prefix)), name).otherwise(doc)
    return queries.withColumn("document", doc)


def document_list(files: DataFrame, contains: str = "", by: str = "filename", ascending: bool = True) -> DataFrame:
    """Files whose name holds a text, case aside, in order of a column; names in the order of their locale."""
    key = F.collate(F.col(by), "UNICODE") if dict(files.dtypes)[by] == "string" else F.col(by)
    kept = files.where(F.contains(F.lower("filename"), F.lit(contains.lower())))
    return kept.orderBy(key.asc() if ascending else key.desc())


def related_versions(files: DataFrame, asked: DataFrame) -> DataFrame:
    """For files asked about (path, filename) the others of their family in files (path, filename, ...): (path, family, other, other_filename)."""
    stem = T.normalized_stem("filename")
    mine = asked.select("path", stem.alias("family"))
    return mine.join(files.select(stem.alias("family"), F.col("path").alias("other"), F.col("filename").alias("other_filename")), "family").where("path <> other").select("path", "family", "other", "other_filename")


def indexed_only(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose stem has a document in the index (stem)."""
    return files.withColumn("stem", T.stem("filename")).join(indexed.select("stem").distinct(), "stem", "left_semi").select(*files.columns)


def newer(versions: DataFrame) -> DataFrame:
    """Versions (family, ord, chosen, ...) after the chosen one of their family."""
    at = F.max(F.when(F.col("chosen"), F.col("ord"))).over(Window.partitionBy("family"))
    return versions.withColumn("at", at).where(F.col("ord") > F.col("at")).drop("at")


def diff_order(sections: DataFrame, *keys: str) -> DataFrame:
    """Changed sections before unchanged ones, each in order of the heading, case aside; ``place`` counts from 1."""
    w = Window.partitionBy(*keys).orderBy(F.col("change_type") == "unchanged", F.lower("heading"), "heading")
    return sections.withColumn("place", F.row_number().over(w))


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, infos and all."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), F.count("*").alias("findings"))


def thin(w: Column, h: Column) -> Column:
    """Whether a rectangle is a line: below 3 one way, above 5 the other or the same."""
    return ((w < 3) | (h < 3)) & ((w > 5) | (h > 5))


def has_grid(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, grid): whether a page's lines (keys, x0, y0, x1, y1) hold three horizontal and three vertical ones of more than 20 points."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    flat = (dy < 2) & (dx > 20)
    return lines.groupBy(*keys).agg(((F.count_if(flat) >= 3) & (F.count_if(~flat & (dx < 2) & (dy > 20)) >= 3)).alias("grid"))


def has_text(pages: DataFrame) -> DataFrame:
    """(doc, has_text): whether a document's first page holds more than 10 characters, and so is no scan."""
    return pages.groupBy("doc").agg(F.coalesce(F.length(F.trim(F.min_by("text", "page"))) > 10, F.lit(False)).alias("has_text"))


def table_data(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, page, block_id, block_type, text, y0, y1) that hold a table's data: paragraphs of two lines or more with a caption that ends less than 15 points above."""
    two = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")) >= 2
    caption = blocks.where("block_type = 'caption'").select("doc", "page", F.col("y1").alias("end"))
    para = blocks.where((F.col("block_type") == "paragraph") & two)
    near = (para["doc"] == caption["doc"]) & (para["page"] == caption["page"]) & (F.col("end") <= F.col("y0")) & (F.col("y0") - F.col("end") < 15)
    return para.join(caption, near, "left_semi")


def without_rogue(blocks: DataFrame, rogue: DataFrame) -> DataFrame:
    """Blocks that are not found to be rogue text."""
    return blocks.join(rogue.select("block_id").distinct(), "block_id", "left_anti").select(*blocks.columns)


def update_header(blocks: DataFrame, ids: DataFrame, old: str, new: str) -> DataFrame:
    """Blocks with the running head or foot ``old`` replaced in those of ``ids`` (block_id)."""
    held = ids.select(F.col("block_id").alias("hit")).distinct()
    text = F.when(F.col("hit").isNotNull(), F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text"))
    return blocks.join(held, F.col("block_id") == F.col("hit"), "left").withColumn("text", text).select(*blocks.columns)


def smallest(files: DataFrame) -> DataFrame:
    """The smallest file (path, size) and the size of all."""
    return files.agg(F.min_by("path", F.struct("size", "path")).alias("path"), F.sum("size").alias("total_size"))
