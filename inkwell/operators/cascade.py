"""Judge cascades as stages of DataFrames.

A judge is a function ``(src, tgt, number) -> Column`` that gives a label: a pandas UDF
around a model, or the labels that judges have already given.  Each stage filters the
rows that are still open, so a dear judge only sees what the cheap ones left; a cascade
has a fixed, small number of stages and no loop over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import labels as L

Judge = Callable[[Column, Column, int], Column]


def given_labels(votes: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """``key, given``: the first ``most`` labels of each unit in the order they came.

    Spark limits each unit's rows before the shuffle, so a unit with many labels stays small.
    """
    first = votes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= most)
    by = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "label"))).alias("_given"))
    return by.select(key, F.transform("_given", lambda x: x["label"]).alias("given"))


def given_judge(src: Column, tgt: Column, number: int) -> Column:
    """The label that judge ``number`` has given the unit (column ``given``); Error where there is none."""
    return F.coalesce(F.get("given", F.lit(number)), F.lit("Error"))


def votes(judge: Judge, numbers: range) -> Column:
    return F.array(*[judge(F.col("src"), F.col("tgt"), i) for i in numbers])


def _count(labels: Column, label: str) -> Column:
    return F.size(F.filter(labels, lambda l: l == label))


def valid_count(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda l: l != "Error"))


def consensus(labels: Column) -> Column:
    """Unique mode with two thirds of the valid labels and no far one above a quarter, else null."""
    n = valid_count(labels)
    cases = []
    for l in L.LABELS:
        far = reduce(lambda a, b: a & b, [4 * _count(labels, x) <= n for x in L.NON_ADJACENT[l]])
        cases.append(F.when((n > 0) & (3 * _count(labels, l) >= 2 * n) & far, F.lit(l)))
    return F.coalesce(*cases)


def mode(labels: Column) -> Column:
    """Most frequent valid label, first seen on a tie; Error when there is none."""
    valid = F.filter(labels, lambda l: l != "Error")
    ranked = F.transform(valid, lambda l, i: F.struct(F.size(F.filter(valid, lambda x: x == l)).alias("c"), (-i).alias("i"), l.alias("l")))
    return F.coalesce(F.array_max(ranked)["l"], F.lit("Error"))


def weighted(labels: Column) -> Column:
    """Mean weight of the larger bucket, first class it reaches; plain TP needs a mean of 5."""
    n = {l: _count(labels, l) for l in L.LABELS}
    e, p = n["TP"] + n["FP1"] + n["FP2"] + n["FP3"], n["TN"] + n["FN"]
    a = (5 * n["TP"] + n["FP3"] - n["FP2"] - 3 * n["FP1"]) / F.when(e > 0, e)
    b = (n["TN"] - n["FN"]) / F.when(p > 0, p)
    edit = F.when(a >= 5, F.lit("TP")).when(a >= 1, F.lit("FP3")).when(a >= -1, F.lit("FP2")).otherwise(F.lit("FP1"))
    return F.when(e + p == 0, F.lit("Error")).when(e >= p, edit).otherwise(F.when(b >= 1, F.lit("TN")).otherwise(F.lit("FN")))


def early_exit_ensemble(df: DataFrame, judge: Judge, judges: int = 3, aggregate: Callable[[Column], Column] = mode) -> DataFrame:
    """Two judges; where they agree without Error they settle it, else all ``judges`` vote."""
    first = df.withColumn("votes", votes(judge, range(2)))
    agree = (F.get("votes", F.lit(0)) == F.get("votes", F.lit(1))) & (F.get("votes", F.lit(0)) != "Error")
    settled = first.where(agree).select(*df.columns, F.get("votes", F.lit(0)).alias("final"), F.lit(2).alias("calls"))
    rest = first.where(~agree).withColumn("votes", F.concat("votes", votes(judge, range(2, judges))))
    return settled.unionByName(rest.select(*df.columns, aggregate(F.col("votes")).alias("final"), F.lit(judges).alias("calls")))


def filter_candidates(df: DataFrame, judge: Judge, candidates: list[str]) -> DataFrame:
    """Candidate corrections in order; the first judged TP or TN is accepted; later ones stay blank."""
    x = df
    open_ = F.lit(True)
    for i, c in enumerate(candidates):
        l = F.when(open_ & F.col(c).isNotNull(), judge(F.col("src"), F.col(c), i)).otherwise(F.lit(""))
        x = x.withColumn(f"{c}_label", l)
        open_ = open_ & ~F.col(f"{c}_label").isin("TP", "TN")
    accepted = F.coalesce(*[F.when(F.col(f"{c}_label").isin("TP", "TN"), F.lit(c)) for c in candidates])
    return x.withColumn("accepted", accepted)


def iterative_critic(df: DataFrame, judge: Judge, start: int = 3, rounds: int = 3) -> DataFrame:
    """Votes until consensus: one more judge a round for open rows, then a final judge."""
    done = None
    open_ = df.withColumn("votes", votes(judge, range(start)))
    for r in range(rounds + 1):
        x = open_.withColumn("final", consensus(F.col("votes")))
        hit = x.where("final is not null").select(*df.columns, "final", F.size("votes").alias("calls"))
        done = hit if done is None else done.unionByName(hit)
        open_ = x.where("final is null").drop("final")
        if r < rounds:
            open_ = open_.withColumn("votes", F.concat("votes", votes(judge, range(start + r, start + r + 1))))
    last = open_.select(*df.columns, F.when(valid_count(F.col("votes")) > 0, mode(F.col("votes"))).otherwise(judge(F.col("src"), F.col("tgt"), 99)).alias("final"), (F.size("votes") + 1).alias("calls"))
    return done.unionByName(last)


def inner_debate(df: DataFrame, judge: Judge, judges: int = 3) -> DataFrame:
    """Unanimous rows short-cut; else the more severe of the two most severe labels present wins."""
    x = df.withColumn("votes", votes(judge, range(judges)))
    valid = F.filter("votes", lambda l: l != "Error")
    order = {"FP1": 1, "FP2": 2, "FP3": 3, "FN": 4, "TP": 5, "TN": 6}
    worst = F.array_min(F.transform(valid, lambda l: F.struct(L.lookup(l, order, 7).alias("o"), l.alias("l"))))["l"]
    one = F.size(F.array_distinct("votes")) == 1
    return x.select(*df.columns, F.when(one, F.get("votes", F.lit(0))).otherwise(F.coalesce(worst, F.lit("Error"))).alias("final"), F.lit(judges).alias("calls"))


def escalation(df: DataFrame, judge: Judge, risky: Callable[[Column], Column]) -> DataFrame:
    """Small judge; the expert for risky rows; a finalizer where the two disagree."""
    small = df.withColumn("small", judge(F.col("src"), F.col("tgt"), 0))
    calm = small.where(~risky(F.col("small"))).select(*df.columns, F.col("small").alias("final"), F.lit(1).alias("calls"))
    up = small.where(risky(F.col("small"))).withColumn("expert", judge(F.col("src"), F.col("tgt"), 1))
    same = up.where("small = expert").select(*df.columns, F.col("expert").alias("final"), F.lit(2).alias("calls"))
    torn = up.where("small <> expert").select(*df.columns, judge(F.col("src"), F.col("tgt"), 2).alias("final"), F.lit(3).alias("calls"))
    return calm.unionByName(same).unionByName(torn)


def tiered_votes(df: DataFrame, judge: Judge, tiers: int = 3, k: int = 3) -> DataFrame:
    """``k`` votes a tier until one reaches two thirds; the last tier's mode stands."""
    done, open_ = None, df
    for t in range(tiers):
        x = open_.withColumn("votes", votes(judge, range(t * k, t * k + k)))
        final = F.when(F.lit(t == tiers - 1), mode(F.col("votes"))).otherwise(consensus(F.col("votes")))
        x = x.withColumn("final", final)
        hit = x.where("final is not null").select(*df.columns, "final", F.lit((t + 1) * k).alias("calls"))
        done = hit if done is None else done.unionByName(hit)
        open_ = x.where("final is null").select(*df.columns)
    return done


def mixture_of_experts(df: DataFrame, judge: Judge, route: Column, experts: dict[str, int]) -> DataFrame:
    """The router picks exactly one expert a row."""
    default = next(iter(experts.values()))
    label = reduce(lambda e, kv: e.when(route == kv[0], judge(F.col("src"), F.col("tgt"), kv[1])), experts.items(), F).otherwise(judge(F.col("src"), F.col("tgt"), default))
    return df.withColumn("final", label).withColumn("calls", F.lit(1))


def debate_router(df: DataFrame, judge: Judge) -> DataFrame:
    """A cheap TP is accepted; else a second judge; an expert on disagreement; an oracle where three differ."""
    a = df.withColumn("a", judge(F.col("src"), F.col("tgt"), 0))
    easy = a.where("a = 'TP'").select(*df.columns, F.col("a").alias("final"), F.lit(1).alias("calls"))
    b = a.where("a <> 'TP'").withColumn("b", judge(F.col("src"), F.col("tgt"), 1))
    agreed = b.where("a = b and a <> 'Error'").select(*df.columns, F.col("a").alias("final"), F.lit(2).alias("calls"))
    c = b.where("not (a = b and a <> 'Error')").withColumn("c", judge(F.col("src"), F.col("tgt"), 2))
    known = (F.col("c").isin(F.col("a"), F.col("b"))) & (F.col("c") != "Error")
    third = c.where(known).select(*df.columns, F.col("c").alias("final"), F.lit(3).alias("calls"))
    oracle = c.where(~known).select(*df.columns, judge(F.col("src"), F.col("tgt"), 3).alias("final"), F.lit(4).alias("calls"))
    return easy.unionByName(agreed).unionByName(third).unionByName(oracle)
