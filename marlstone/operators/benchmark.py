"""Models tried in stages: each stage asks more queries of fewer models, and the cost so far may end it.

models: (model_id, ord, valid, filter_cost), ord the order in which models are tried; outcomes: (model_id, query_id, stratum,
recall, reciprocal_rank, hit, cost), what a query would give and cost if it were asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of the baseline's recall that a model needs to come into the last stage.
COMPETITIVE = 0.9
#: Decimals to which recalls are compared: a mean of doubles depends on the order of its rows beyond them.
PLACES = 9


def subset(queries: DataFrame, per_stratum: int) -> DataFrame:
    """Queries (query_id, stratum): of each stratum the first ``per_stratum`` by a hash of their id, the same in every run. A null stratum is one too."""
    w = Window.partitionBy("stratum").orderBy(F.xxhash64("query_id"), "query_id")
    return queries.select("query_id", "stratum").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_stratum).drop("_n")


def run_until(models: DataFrame, cost: str, cap: float, spent: float = 0.0) -> DataFrame:
    """Models (ord, cost) in order with ``cost_before``, as long as the cost before them is below the cap; the one that passes it still runs. There are as many rows as models."""
    before = F.coalesce(F.sum(cost).over(Window.orderBy("ord", "model_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + spent
    return models.withColumn("cost_before", before).where(F.col("cost_before") < cap)


def measured(models: DataFrame, outcomes: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Means over the queries asked for each model, and what they cost; a model without outcomes has zeros."""
    rows = outcomes if queries is None else outcomes.join(queries.select("query_id"), "query_id", "left_semi")
    g = rows.groupBy("model_id").agg(F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("n_queries"), F.sum("cost").alias("cost"))
    return models.select("model_id", "ord").join(g, "model_id", "left").fillna(0, ["recall", "mrr", "hit_rate", "n_queries", "cost"])


def staged(models: DataFrame, outcomes: DataFrame, baseline_recall: float, cap: float, per_stratum: int = 5) -> DataFrame:
    """(model_id, stage_reached, recall, mrr, hit_rate, n_queries, recall_delta, cost): what became of each model that was tried at all.

    Stage 1 looks whether a model gives valid vectors, stage 2 asks a subset with the same number of queries of each stratum, stage 3 all queries, of
    models with at least COMPETITIVE of the baseline's recall, both to PLACES decimals. Models come in order of ord; before each, the cost of all that was done so far must be below the cap, else
    the stage ends. Figures are those of the last stage that a model reached; after stage 1 there are none. cost is that of all its stages.
    """
    first = run_until(models.withColumn("filter_cost", F.coalesce("filter_cost", F.lit(0.0))), "filter_cost", cap)
    spent = first.agg(F.coalesce(F.sum("filter_cost"), F.lit(0.0))).first()[0]
    valid = first.where(F.coalesce("valid", F.lit(False)))
    asked = subset(outcomes.select("query_id", "stratum"), per_stratum)
    second = run_until(measured(valid, outcomes.join(valid.select("model_id"), "model_id", "left_semi"), asked), "cost", cap, spent)
    spent += second.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    good = second.where(F.round("recall", PLACES) >= round(baseline_recall * COMPETITIVE, PLACES))
    third = run_until(measured(good, outcomes.join(good.select("model_id"), "model_id", "left_semi")), "cost", cap, spent)
    names = ["recall", "mrr", "hit_rate", "n_queries", "cost"]
    tagged = lambda d, k: d.select("model_id", *[F.col(c).alias(f"{c}{k}") for c in names])
    rows = first.select("model_id", "filter_cost").join(tagged(second, 2), "model_id", "left").join(tagged(third, 3), "model_id", "left")
    best = [F.coalesce(f"{c}3", f"{c}2").alias(c) for c in names[:-1]]
    total = F.col("filter_cost") + F.coalesce("cost2", F.lit(0.0)) + F.coalesce("cost3", F.lit(0.0))
    stage = F.when(F.col("recall3").isNotNull(), 3).when(F.col("recall2").isNotNull(), 2).otherwise(1)
    return rows.select("model_id", stage.alias("stage_reached"), *best, (F.coalesce("recall3", "recall2") - baseline_recall).alias("recall_delta"), total.alias("cost"))
