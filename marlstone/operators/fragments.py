"""The words in which two texts differ, and pages whose text has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def common_prefix(a: Column, b: Column, most: Column | None = None) -> Column:
    """How many characters two texts share at the beginning, at most ``most``: bisection over their substrings."""
    least = F.least(F.length(a), F.length(b)) if most is None else most
    steps = F.sequence(F.ceil(F.log2(least + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))

    def longer(n: Column, k: Column) -> Column:
        to = n + F.pow(F.lit(2), k).cast("int")
        return F.when((to <= least) & (F.substring(a, n + 1, to - n) == F.substring(b, n + 1, to - n)), to).otherwise(n)

    return F.aggregate(steps, F.lit(0), longer)


def fragments(rows: DataFrame, old: str, new: str) -> DataFrame:
    """``rows`` whose texts differ with ``old_fragment`` and ``new_fragment``; rows without a fragment are left out.

    Fragments are what differs, widened to the borders of the old text's words, which end at blanks and line breaks. An insertion
    takes in the words that it touches; where it touches none there is no fragment, nor for a null text.
    """
    a, b = F.col(old), F.col(new)
    d = rows.where(a != b).withColumn("_p", common_prefix(a, b))
    d = d.withColumn("_s", common_prefix(F.reverse(a), F.reverse(b), F.least(F.length(a), F.length(b)) - F.col("_p")))
    d = d.withColumn("_oe", F.length(a) - F.col("_s")).withColumn("_new", F.substring(b, F.col("_p") + 1, F.length(b) - F.col("_s") - F.col("_p")))
    head = F.length(F.regexp_extract(F.substring(a, F.lit(1), F.col("_p")), r"[^ \n]*\z", 0))
    tail = F.length(F.regexp_extract(F.substring(a, F.col("_oe") + 1, F.length(a)), r"\A[^ \n]*", 0))
    d = d.withColumn("_from", F.col("_p") - head).withColumn("_to", F.col("_oe") + tail)
    piece = F.substring(a, F.col("_from") + 1, F.col("_to") - F.col("_from"))
    inserted = F.substring(b, F.col("_from") + 1, F.col("_to") + F.length("_new") - F.col("_from"))
    replaced = F.concat(F.substring(a, F.col("_from") + 1, F.col("_p") - F.col("_from")), "_new", F.substring(a, F.col("_oe") + 1, F.col("_to") - F.col("_oe")))
    d = d.withColumn("old_fragment", piece).withColumn("new_fragment", F.when(F.col("_oe") == F.col("_p"), inserted).otherwise(replaced))
    return d.where("old_fragment <> '' and old_fragment <> new_fragment").drop("_p", "_s", "_oe", "_new", "_from", "_to")


def edited_pages(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(keys, page) of pages (keys, page, text) that both versions have and whose words differ; white space does not count."""
    k = [*keys, "page"]
    squeeze = lambda c: F.array_join(T.words(c), " ")
    rows = old.select(*k, squeeze("text").alias("_a")).join(new.select(*k, squeeze("text").alias("_b")), k)
    return rows.where(F.col("_a") != F.col("_b")).select(*k)
