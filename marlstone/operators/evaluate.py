"""Evaluation of retrieval: per-query metrics, their aggregates, comparison of runs and staged choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import picked


def score_queries(hits: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, reciprocal_rank, ndcg_raw, ndcg_capped, hit) from hits (query_id, rank, text) and judgments (query_id, relevant_texts).

    A hit is relevant if its lower-case text contains any expected substring. ndcg_raw gains for every
    relevant hit but sizes the ideal by expected substrings, so it may exceed one; ndcg_capped does not.
    """
    want = judgments.select("query_id", F.transform("relevant_texts", lambda x: F.lower(x)).alias("want"))
    rows = hits.where(F.col("rank") <= k).withColumn("t", F.lower("text")).join(want, "query_id")
    rows = rows.withColumn("found", F.filter("want", lambda x: F.contains(F.col("t"), x)))
    per = rows.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
        F.min(F.when(F.size("found") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.size("found") > 0, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size("want"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = want.join(per, "query_id", "left").withColumn("n", F.size("want"))
    n_found = F.size(F.filter("want", lambda x: F.array_contains(F.coalesce("found", F.array().cast("array<string>")), x)))
    ndcg = F.when(F.col("n") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)
    return out.select(
        "query_id", F.when(F.col("n") > 0, n_found / F.col("n")).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.round(ndcg, 9).alias("ndcg_raw"), F.round(F.least(ndcg, F.lit(1.0)), 9).alias("ndcg_capped"), (n_found > 0).alias("hit"),
    )


def aggregate(metrics: DataFrame, *by: str) -> DataFrame:
    """Means, hit rate and, if there is a latency, its p50 and p95 as picked elements."""
    out = [F.round(F.avg("recall"), 9).alias("mean_recall"), F.round(F.avg("reciprocal_rank"), 9).alias("mean_mrr"), F.round(F.avg("ndcg_raw"), 9).alias("mean_ndcg_raw"), F.round(F.avg(F.col("hit").cast("double")), 9).alias("hit_rate"), F.count("*").alias("n_queries")]
    g = metrics.groupBy(*by).agg(*out)
    if "latency_ms" not in metrics.columns:
        return g
    times = picked(metrics, list(by), "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return g.join(times, list(by), "left")


def best(configs: DataFrame) -> DataFrame:
    """The configuration of the highest mean recall, the first in order if several."""
    return configs.orderBy(F.desc("mean_recall"), "ord").limit(1)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Change of the best recall against the run before."""
    return runs.withColumn("change", F.col("best_recall") - F.lag("best_recall").over(Window.orderBy("run_id")))


def within_budget(steps: DataFrame, cap: float) -> DataFrame:
    """Steps in order until the cost so far reaches the cap."""
    before = F.coalesce(F.sum("cost").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return steps.withColumn("cost_before", before).where(F.col("cost_before") < cap)


def recommend(models: DataFrame, baseline: str, baseline_recall: float, n_queries: int) -> DataFrame:
    """What to do about the best of new models (model_id, best_recall, cost_usd): one row (action, model_id, recall, cost_per_query, confidence).

    upgrade above 0.05 of gain, test_further above 0.02, cost_savings above -0.01 if it costs less than 0.7 of
    the baseline's recall (the two are compared as numbers), else stay. Of equal models the first by name counts.
    """
    level = "high" if n_queries >= 30 else "medium" if n_queries >= 15 else "low"
    gain = F.col("best_recall") - baseline_recall
    action = F.when(gain > 0.05, "upgrade").when(gain > 0.02, "test_further").when((gain > -0.01) & (F.col("cost_usd") < baseline_recall * 0.7), "cost_savings").otherwise("stay")
    rows = models.orderBy(F.desc("best_recall"), "model_id").limit(1).withColumn("action", action)
    stay = F.col("action") == "stay"
    return rows.select(
        "action", F.when(stay, baseline).otherwise(F.col("model_id")).alias("model_id"), F.when(stay, baseline_recall).otherwise(F.col("best_recall")).alias("recall"),
        F.when(stay, 0.00001).otherwise(F.col("cost_usd") / max(n_queries, 1)).alias("cost_per_query"), F.lit(level).alias("confidence"),
    )


def grid(judgments: DataFrame, found: dict[str, DataFrame | None], k: int = 10) -> DataFrame:
    """Metrics of every judged query under every configuration: found has the hits (query_id, rank, text[, latency_ms]) by name; where a search failed (None), and for queries without hits, rows of zeros count."""
    rows = []
    for ord_, (name, hits) in enumerate(found.items()):
        if hits is None:
            m = judgments.select("query_id", *[F.lit(0.0).alias(c) for c in ("recall", "reciprocal_rank", "ndcg_raw", "ndcg_capped")], F.lit(False).alias("hit"))
        else:
            m = score_queries(hits, judgments, k)
        rows.append(m.withColumn("config", F.lit(name)).withColumn("ord", F.lit(ord_)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def save_run(summary: DataFrame, path: str, run_id: str) -> None:
    """Append one run's summary (config, mean_recall, ...) to the table of runs."""
    summary.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def latest_run(spark, path: str) -> DataFrame:
    """The summary of the run with the largest run_id."""
    runs = spark.read.option("partitionColumnsTypeInferenceEnabled", False).parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    last = runs.agg(F.max("run_id")).first()[0]
    return runs.where(F.col("run_id") == last)
