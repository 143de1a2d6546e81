"""Queries over token usage and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import cost as C
from inkwell.plans.registry import query
from inkwell.sources.tables import table

_PRICED = """names AS (SELECT DISTINCT model, replace(lower(trim(model)),' ','_') AS m FROM ensemble WHERE model IS NOT NULL),
best AS (SELECT model, price_model, p_in, p_out, p_reason, p_cached FROM (SELECT n.model, p.model AS price_model, p.input AS p_in, p.output AS p_out, p.reasoning AS p_reason, p.cached AS p_cached,
  row_number() OVER (PARTITION BY n.model ORDER BY (n.m = p.model) DESC, length(p.model) DESC) AS rn FROM names n JOIN price_table p ON contains(n.m, p.model)) WHERE rn = 1)"""
_COST = f"""{_PRICED}, u AS (SELECT e.*, b.price_model, coalesce(p_in,0) AS p_in, coalesce(p_cached,0) AS p_cached, coalesce(p_out,0) AS p_out, coalesce(p_reason,0) AS p_reason FROM ensemble e LEFT JOIN best b USING (model)),
k AS (SELECT *, greatest(0, coalesce(input_tokens,0) - coalesce(cached_tokens,0))/1e6*p_in AS input_cost, coalesce(cached_tokens,0)/1e6*p_cached AS cached_cost, coalesce(output_tokens,0)/1e6*p_out AS output_cost, coalesce(reasoning_tokens,0)/1e6*p_reason AS reasoning_cost FROM u),
c AS (SELECT *, input_cost + cached_cost + output_cost + reasoning_cost AS cost FROM k)"""
_COLS = ("row_id", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", "total_cost_usd")


def _usage(spark, d):
    return table(spark, d, "ensemble", *_COLS)


def _cost(spark, d):
    return C.with_cost(_usage(spark, d), table(spark, d, "price_table"))


@query("j8_price_match", f"WITH {_PRICED} SELECT model, price_model, p_in, p_out FROM best")
def j8_price_match(spark, d):
    return C.priced_models(_usage(spark, d), table(spark, d, "price_table")).select("model", "price_model", "p_in", "p_out")


@query("k16_row_cost", f"WITH {_COST} SELECT row_id, round(cost*1e6,4) AS micro_dollars FROM c")
def k16_row_cost(spark, d):
    return _cost(spark, d).select("row_id", F.round(F.col("cost") * 1e6, 4).alias("micro_dollars"))


@query("a31_cost_by_model", f"WITH {_COST} SELECT coalesce(model,'all') AS model, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost),4) AS cost, round(1000*avg(cost),6) AS per_1k FROM c GROUP BY ROLLUP(model)")
def a31_cost_by_model(spark, d):
    by = _cost(spark, d).rollup("model").agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.round(1000 * F.avg("cost"), 6).alias("per_1k"))
    return by.withColumn("model", F.coalesce("model", F.lit("all")))


@query("a31_extrapolation", f"WITH {_COST}, a AS (SELECT model, avg(cost) AS m FROM c GROUP BY 1), n AS (SELECT unnest([1000,10000,100000,1000000]) AS requests) SELECT model, requests, round(m*requests,3) AS cost FROM a, n")
def a31_extrapolation(spark, d):
    by = _cost(spark, d).groupBy("model").agg(F.avg("cost").alias("m"))
    return by.select("model", F.explode(F.array(*[F.lit(n) for n in (1000, 10000, 100000, 1000000)])).alias("requests"), "m").select("model", "requests", F.round(F.col("m") * F.col("requests"), 3).alias("cost"))


@query("a32_savings", f"WITH {_COST} SELECT model, round(sum(coalesce(cached_tokens,0)/1e6*(p_in-p_cached)),6) AS caching, round(0.5*sum(cost),4) AS batch, round(10000*avg(cost),4) AS per_10k FROM c GROUP BY 1")
def a32_savings(spark, d):
    caching = F.coalesce("cached_tokens", F.lit(0)) / 1e6 * (F.col("p_in") - F.col("p_cached"))
    return _cost(spark, d).groupBy("model").agg(F.round(F.sum(caching), 6).alias("caching"), F.round(0.5 * F.sum("cost"), 4).alias("batch"), F.round(10000 * F.avg("cost"), 4).alias("per_10k"))


@query("a33_reported_cost_gap", f"WITH {_COST} SELECT model, count(*) FILTER (total_cost_usd IS NULL) AS unreported, count(*) FILTER (abs(total_cost_usd - cost) > 1e-6) AS different FROM c GROUP BY 1")
def a33_reported_cost_gap(spark, d):
    off = F.abs(F.col("total_cost_usd") - F.col("cost")) > 1e-6
    return _cost(spark, d).groupBy("model").agg(F.count_if(F.col("total_cost_usd").isNull()).alias("unreported"), F.count_if(off).alias("different"))


@query("a41_capacity", "SELECT model, ceil(sum(total_tokens)/1e4)*100 AS capacity, round(sum(total_tokens)*0.9/1e6*1.0 + sum(total_tokens)*0.1/1e6*4.0, 4) AS pay_as_you_go FROM ensemble GROUP BY 1")
def a41_capacity(spark, d):
    t = F.sum("total_tokens")
    return table(spark, d, "ensemble", "model", "total_tokens").groupBy("model").agg((F.ceil(t / 1e4).cast("double") * 100).alias("capacity"), F.round(t * 0.9 / 1e6 * 1.0 + t * 0.1 / 1e6 * 4.0, 4).alias("pay_as_you_go"))
