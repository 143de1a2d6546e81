"""Token cost: price lookup by fuzzy model name, row cost, totals, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a price table is sent to every executor.
SMALL = 10_000


def priced_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``model`` -> ``price_model`` and prices for every different model name.

    Exact name first, else the longest known name that the model begins with or holds.
    Only the distinct names meet the price table, not the usage rows.
    """
    names = usage.select("model").where("model is not null").distinct().withColumn("m", F.regexp_replace(F.lower(F.trim("model")), " ", "_"))
    p = prices.select(F.col("model").alias("price_model"), F.col("input").alias("p_in"), F.col("output").alias("p_out"), F.col("reasoning").alias("p_reason"), F.col("cached").alias("p_cached"))
    p = F.broadcast(p) if prices.limit(SMALL + 1).count() <= SMALL else p
    hits = names.join(p, F.contains(F.col("m"), F.col("price_model")))
    rank = F.struct((F.col("m") == F.col("price_model")).cast("int"), F.length("price_model"))
    best = F.max_by(F.struct("price_model", "p_in", "p_out", "p_reason", "p_cached"), rank)
    return hits.groupBy("model").agg(best.alias("b")).select("model", "b.*")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with cost parts in dollars; an unknown model costs nothing."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    models = priced_models(usage, prices)
    x = usage.join(models, "model", "left").na.fill(0.0, ["p_in", "p_out", "p_reason", "p_cached"])
    million = 1_000_000.0
    parts = {
        "input_cost": F.greatest(F.lit(0.0), n("input_tokens") - n("cached_tokens")) / million * F.col("p_in"),
        "cached_cost": n("cached_tokens") / million * F.col("p_cached"),
        "output_cost": n("output_tokens") / million * F.col("p_out"),
        "reasoning_cost": n("reasoning_tokens") / million * F.col("p_reason"),
    }
    x = x.withColumns(parts)
    return x.withColumn("cost", sum_of(*parts))


def sum_of(*names: str) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out + F.col(n)
    return out


def number_or_zero(column: str) -> Column:
    """A count or cost as given; 0 for null."""
    return F.coalesce(F.col(column), F.lit(0))
