"""Crowd votes and judge labels: long form, majorities, sentence labels, ensembles.

All operators take a long table and aggregate with partial combination; none gathers a
unit's rows in Python.  A unit's votes are few by design, but nothing here depends on it:
counts by (unit, label) come first, decisions are made on those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import labels as L


def long_votes(annotations: DataFrame, edits: int = 5) -> DataFrame:
    """``unit_id, vote_id, edit_no, label``: one row a vote on an edit.

    Blank units and labels that are none of the crowd's are left out; ``vote_id`` keeps
    arrival order.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("edit_no"), F.col(f"id1_label{k}").alias("raw")) for k in range(1, edits + 1)])
    rows = annotations.where("trim(_unit_id) <> ''").select(F.trim("_unit_id").alias("unit_id"), "vote_id", F.explode(pairs).alias("e"))
    return rows.select("unit_id", "vote_id", "e.edit_no", L.crowd_label(F.col("e.raw")).alias("label")).where("label is not null")


def judge_votes(annotations: DataFrame) -> DataFrame:
    """``unit_id, vote_id, label``: one judge label a row, 'Error' where none is given."""
    label = F.coalesce(L.crowd_label(F.col("id1_label1")), F.when(F.col("llm_label").isin(*L.LABELS), F.col("llm_label")), F.lit("Error"))
    return annotations.where("trim(_unit_id) <> ''").select(F.trim("_unit_id").alias("unit_id"), "vote_id", label.alias("label"))


def missing_error(annotations: DataFrame) -> DataFrame:
    """Whether a unit misses an error, by each policy for blanks; a tie means yes.

    ``strict``: only given judgments count, none means no; ``blank_false``: a blank is a
    no.  Spellings of truth: 'missed_error', 'True' (any case); of falsehood: 'False'.
    """
    m = F.lower(F.trim("missed_error"))
    yes, no = m.isin("missed_error", "true"), m == "false"
    by = annotations.where("trim(_unit_id) <> ''").groupBy(F.trim("_unit_id").alias("unit_id"))
    n = by.agg(F.count_if(yes).alias("n_true"), F.count_if(no).alias("n_false"), F.count(F.lit(1)).alias("n_rows"))
    strict = (F.col("n_true") + F.col("n_false") > 0) & (F.col("n_true") >= F.col("n_false"))
    return n.select("unit_id", strict.alias("strict"), (F.col("n_true") >= F.col("n_rows") - F.col("n_true")).alias("blank_false"))


def majority(votes: DataFrame, *keys: str) -> DataFrame:
    """``keys, label, n``: the most frequent label, the more severe one of a tie."""
    counts = votes.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c"))
    best = F.max_by("label", F.struct("c", L.severity(F.col("label")))).alias("label")
    return counts.groupBy(*keys).agg(best, F.max("c").alias("n"))


def edit_statistics(votes: DataFrame) -> DataFrame:
    """By unit and edit: dominant label, its votes, whether the top is shared, votes."""
    counts = votes.groupBy("unit_id", "edit_no", "label").agg(F.count(F.lit(1)).alias("c"))
    by = counts.groupBy("unit_id", "edit_no").agg(F.max_by("label", F.struct("c", L.severity(F.col("label")))).alias("dominant"), F.max("c").alias("dominant_votes"), F.sum("c").alias("votes"), F.collect_list("c").alias("cs"))
    tie = F.size(F.filter("cs", lambda c: c == F.col("dominant_votes"))) > 1
    return by.select("unit_id", "edit_no", "dominant", "dominant_votes", "votes", tie.alias("tie"))


def sentence_labels(votes: DataFrame, missing: DataFrame, pooled: bool) -> DataFrame:
    """Unit label: the majority of all its votes (pooled), or the worst of its edits' majorities."""
    if pooled:
        base = majority(votes, "unit_id").select("unit_id", "label")
    else:
        base = majority(votes, "unit_id", "edit_no").groupBy("unit_id").agg(F.max_by("label", L.severity(F.col("label"))).alias("label"))
    x = missing.join(base, "unit_id", "left").withColumn("label", F.coalesce("label", F.lit("TN")))
    return x.select("unit_id", F.when((F.col("label") == "TP") & F.col("missing"), F.lit("FN")).otherwise(F.col("label")).alias("label"))


def _label_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("unit_id").agg(*[F.count_if(F.col("label") == l).alias(f"n_{l}") for l in (*L.LABELS, "Error")], F.count(F.lit(1)).alias("n"))


def weighted_label(votes: DataFrame, strong: bool) -> DataFrame:
    """Weighted vote: the bucket with more votes, mean weight, first class it reaches.

    ``strong`` rounds the mean to two places and lets plain TP reach down to the weak TP's
    weight of 3; otherwise TP needs the full 5.
    """
    c = _label_counts(votes)
    n = {l: F.col(f"n_{l}") for l in L.LABELS}
    edits_n = reduce(lambda a, b: a + b, [n[l] for l in ("TP", "FP1", "FP2", "FP3")])
    plain_n = n["TN"] + n["FN"]
    mean = (5 * n["TP"] + n["FP3"] - n["FP2"] - 3 * n["FP1"]) / edits_n
    plain_mean = (n["TN"] - n["FN"]) / plain_n
    if strong:
        mean, plain_mean = F.round(mean, 2), F.round(plain_mean, 2)
    of_edits = F.when(mean >= (3 if strong else 5), F.lit("TP")).when(mean >= 1, F.lit("FP3")).when(mean >= -1, F.lit("FP2")).otherwise(F.lit("FP1"))
    of_plain = F.when(plain_mean >= 1, F.lit("TN")).otherwise(F.lit("FN"))
    return c.select("unit_id", F.when(edits_n + plain_n == 0, F.lit("Error")).when(edits_n >= plain_n, of_edits).otherwise(of_plain).alias("label"))


def consistent_label(votes: DataFrame, same: Column | None = None) -> DataFrame:
    """Majority; any Error gives Error; ties go to FP1, FP2, FP3, FN, then TP (TN when ``same``)."""
    order = {"FP1": 1, "FP2": 2, "FP3": 3, "FN": 4, "TP": 5, "TN": 6}
    counts = votes.groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("c"))
    best = F.min_by("label", F.struct(-F.col("c"), L.lookup(F.col("label"), order, 7)))
    return counts.groupBy("unit_id").agg(best.alias("best"), F.max((F.col("label") == "Error").cast("int")).alias("e")).select("unit_id", F.when(F.col("e") == 1, F.lit("Error")).otherwise(F.col("best")).alias("label"))


def first_seen_mode(votes: DataFrame) -> DataFrame:
    """Mode without Errors, first seen wins a tie; consistent when it has over half the votes."""
    counts = votes.where("label <> 'Error'").groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("c"), F.min("vote_id").alias("first"))
    by = counts.groupBy("unit_id").agg(F.max_by("label", F.struct("c", -F.col("first"))).alias("label"), F.max("c").alias("votes"), F.sum("c").alias("n"))
    return by.select("unit_id", "label", "votes", (F.col("votes") > F.floor(F.col("n") / 2)).alias("is_consistent"))


def consensus(votes: DataFrame) -> DataFrame:
    """Unique mode with two thirds of the valid votes and no far label above a quarter; else null."""
    c = _label_counts(votes)
    n = {l: F.col(f"n_{l}") for l in L.LABELS}
    valid = reduce(lambda a, b: a + b, n.values())
    out = F.lit(None).cast("string")
    for l in reversed(L.LABELS):
        far = reduce(lambda a, b: a & b, [4 * n[x] <= valid for x in L.NON_ADJACENT[l]])
        out = F.when((valid > 0) & (3 * n[l] >= 2 * valid) & far, F.lit(l)).otherwise(out)
    return c.select("unit_id", out.alias("label"))


def top_two(votes: DataFrame) -> DataFrame:
    """The two most frequent labels of each unit: count down, label up."""
    counts = votes.where("label <> 'Error'").groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("unit_id").orderBy(F.desc("votes"), "label")
    return counts.withColumn("place", F.row_number().over(w)).where("place <= 2")


def most_dominant_two(votes: DataFrame) -> DataFrame:
    """The two most severe labels of each unit, whatever their counts."""
    w = Window.partitionBy("unit_id").orderBy(F.desc("severity"))
    kinds = votes.groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("votes")).withColumn("severity", L.severity(F.col("label"))).where("severity > 0")
    return kinds.withColumn("place", F.row_number().over(w)).where("place <= 2").select("unit_id", "label", "votes", "place")
