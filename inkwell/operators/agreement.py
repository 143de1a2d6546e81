"""Inter-annotator agreement from long (item, category) votes; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _item_sums(counts: DataFrame, *items: str) -> DataFrame:
    return counts.groupBy(*items).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))


def fleiss(votes: DataFrame, *items: str, modal: bool = False, clamp: bool = True) -> DataFrame:
    """``items, p_observed, p_expected, kappa``.

    Items need two votes.  Unequal rater numbers weigh items by their raters; with
    ``modal`` only items with the most frequent number of raters stay (the smaller number
    on a tie).  Fewer than two items or categories give 0.
    """
    counts = votes.groupBy(*items, "label").agg(F.count(F.lit(1)).alias("c"))
    per_item = _item_sums(counts, *items)
    if modal:
        mode = per_item.groupBy("n").agg(F.count(F.lit(1)).alias("k")).agg(F.max_by("n", F.struct("k", -F.col("n"))).alias("n"))
        per_item = per_item.join(F.broadcast(mode), "n")  # one row
    else:
        per_item = per_item.where("n >= 2")
    kept = counts.join(per_item.select(*items), list(items), "left_semi")
    shares = kept.groupBy("label").agg(F.sum("c").alias("s"))
    expected = shares.agg(F.count(F.lit(1)).alias("categories"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("s").alias("all"))
    observed = per_item.agg(F.count(F.lit(1)).alias("items"), F.sum(F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") - 1)).otherwise(0.0)).alias("agree"), F.sum("n").alias("raters"))
    x = observed.join(F.broadcast(expected)).withColumn("p", F.col("agree") / F.col("raters")).withColumn("e", F.col("ss") / (F.col("all") * F.col("all")))
    k = (F.col("p") - F.col("e")) / (1 - F.col("e"))
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k)) if clamp else k
    kappa = F.when((F.col("items") < 2) | (F.col("categories") < 2), 0.0).when(F.col("p") >= 1, 1.0).when(F.col("e") >= 1, 0.0).otherwise(k)
    return x.select("items", F.round("p", 6).alias("p_observed"), F.round("e", 6).alias("p_expected"), F.round(kappa, 6).alias("kappa"))


def cohen(df: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """Unweighted kappa of two raters over all rows and, with ``by``, for each group (null: all)."""
    cells = df.groupBy(*([by] if by else []), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if by:
        cells = cells.select(F.explode(F.array(F.col(by), F.lit(None).cast("string"))).alias("grp"), "a", "b", "n").groupBy("grp", "a", "b").agg(F.sum("n").alias("n"))
    else:
        cells = cells.select(F.lit(None).cast("string").alias("grp"), "a", "b", "n")
    total = cells.groupBy("grp").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("grp", F.col("a").alias("l")).agg(F.sum("n").alias("na")), cells.groupBy("grp", F.col("b").alias("l")).agg(F.sum("n").alias("nb"))
    pe = left.alias("x").join(right.alias("y"), F.expr("x.l = y.l and x.grp <=> y.grp")).groupBy("x.grp").agg(F.sum(F.col("na") * F.col("nb")).alias("ab"))
    x = total.alias("t").join(pe.alias("p"), F.expr("t.grp <=> p.grp"), "left")
    po, pexp = F.col("same") / F.col("total"), F.coalesce(F.col("ab"), F.lit(0)) / (F.col("total") * F.col("total"))
    return x.select(F.col("t.grp").alias("grp"), F.col("total").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pexp < 1, (po - pexp) / (1 - pexp)).otherwise(1.0), 6).alias("kappa"))
