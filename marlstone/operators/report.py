"""Markdown reports: one renderer over aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, columns: list[str], order: list[str], title: str) -> DataFrame:
    """One row (report): a title, a header and a line per row in order. For aggregates of report size."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), " | "), F.lit(" |"))
    rows = df.select(F.struct(*order, line.alias("_line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    head = f"# {title}\n\n| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rs", lambda r: r["_line"]), "\n")).alias("report"))


def csv_text(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row (csv): header and quoted lines in order."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = df.select(F.struct(*order, F.concat_ws(",", *[quote(c) for c in columns]).alias("_line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform("rs", lambda r: r["_line"]), "\n")).alias("csv"))
