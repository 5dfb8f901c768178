"""OCR words: merge of two sources, review flags, lines, font size, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import picked
from .tablefunctions import anchor_groups

# Common font sizes.
SIZES = [8, 9, 10, 11, 12, 14, 16, 18, 20, 24]


def overlap(a: str, b: str) -> Column:
    """Shared area of two boxes over the smaller area."""
    w = F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")
    h = F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    least = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (least > 0), w * h / least).otherwise(0.0)


def band(df: DataFrame, size: float) -> DataFrame:
    """A row per horizontal band of a page that a box touches, so that boxes meet by equality."""
    cells = F.sequence(F.floor(F.col("y0") / size).cast("long"), F.floor(F.col("y1") / size).cast("long"))
    return df.withColumn("band", F.explode(cells))


def match(primary: DataFrame, secondary: DataFrame, by: tuple = ("page",), size: float = 50.0) -> DataFrame:
    """First primary word that each secondary word of its page (``by``) overlaps by more than half: (secondary columns as s, primary as p)."""
    a, b = band(primary, size).alias("a"), band(secondary, size).alias("b")
    hit = F.col("a.band") == F.col("b.band")
    for c in by:
        hit = hit & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = b.join(a, hit).where(overlap("b", "a") > 0.5)
    word = lambda t, d: F.struct(*[F.col(f"{t}.{c}").alias(c) for c in d.columns])
    return pairs.select(word("b", secondary).alias("s"), word("a", primary).alias("p")).groupBy("s").agg(F.min_by("p", "p.ord").alias("p"))


def merge(primary: DataFrame, secondary: DataFrame, by: tuple = ("page",)) -> DataFrame:
    """Primary words and the secondary ones (by, ord, text, x0, y0, x1, y1, confidence, source) that overlap none."""
    got = match(primary, secondary, by).select("s.*")
    return primary.unionByName(secondary.join(got.select(*by, "ord"), [*by, "ord"], "left_anti"))


def review_flags(primary: DataFrame, secondary: DataFrame, sure: float = 70.0, low: float = 60.0, by: tuple = ("page",)) -> DataFrame:
    """(by, ord, source, reason, confidence): confident sources that disagree, then merged words of low confidence."""
    m = match(primary, secondary, by).where((F.lower("s.text") != F.lower("p.text")) & (F.col("s.confidence") > sure) & (F.col("p.confidence") > sure))
    a = m.select(*[f"s.{c}" for c in by], "s.ord", "s.source", F.lit("disagreement").alias("reason"), F.least("s.confidence", "p.confidence").alias("confidence"))
    b = merge(primary, secondary, by).where(F.col("confidence") < low).select(*by, "ord", "source", F.lit("low confidence").alias("reason"), "confidence")
    return a.unionByName(b)


def font_size(words: DataFrame, *keys: str) -> DataFrame:
    """Nearest common size (the first of several) to the upper median of heights above 3, over 1.2; 11 without any."""
    rows = words.withColumn("_h", F.when(F.col("y1") - F.col("y0") > 3, F.col("y1") - F.col("y0")))
    g = rows.select(*keys).distinct().join(picked(rows, list(keys), "_h", {"h": 0.5}), list(keys), "left")
    near = F.array_sort(F.transform(F.array(*[F.lit(float(s)) for s in SIZES]), lambda s: F.struct(F.abs(s - F.col("h") / 1.2).alias("d"), s.alias("s"))))[0]["s"]
    return g.select(*keys, F.when(F.col("h").isNotNull(), near).otherwise(11.0).alias("font_size"))


def lines(words: DataFrame, tolerance: float = 5.0, by: tuple = ("page",)) -> DataFrame:
    """(by, line, text, y0): words of a page in order of height go to a new line where they are ``tolerance`` from the line's first word."""
    key = F.struct(*by)
    placed = anchor_groups(words.select(key.alias("key"), F.struct("x0", "ord", "text").alias("ord"), F.col("y0").cast("double").alias("value")), tolerance)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x["text"]), " ")
    rows = placed.groupBy("key", F.col("number").alias("line")).agg(F.min("value").alias("y0"), text.alias("text"))
    return rows.select(*[F.col(f"key.{c}").alias(c) for c in by], "line", "y0", "text")


def cost_summary(calls: DataFrame) -> DataFrame:
    """Calls (service, page, cost) by service: calls, cost, pages and cost per page."""
    g = calls.groupBy("service").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.count_distinct("page").alias("pages"))
    return g.withColumn("cost_per_page", F.round(F.col("cost") / F.col("pages"), 6))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of usage (model, tokens_in, tokens_out) by a price table (model, price_in, price_out per 1,000 tokens); unknown models cost nothing."""
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1000
    return usage.join(prices, "model", "left").withColumn("cost", F.round(cost, 9)).drop("price_in", "price_out")
