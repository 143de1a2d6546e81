"""Quality of predicted labels against gold ones, from one confusion count.

The confusion table is the only shuffle of rows; everything else is computed on its at
most (labels x labels) cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """label, tp, fp, fn, tn, support, precision, recall, f1 over the union of both sides' labels."""
    sides = cells.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), (F.col("pred") != F.col("gold")).cast("int").alias("off")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), (F.col("pred") != F.col("gold")).cast("int").alias("off")))).alias("x"), "n")
    by = sides.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when((F.col("x.g") == 1) & (F.col("x.off") == 0), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("x.g") == 0) & (F.col("x.off") == 1), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("x.g") == 1) & (F.col("x.off") == 1), F.col("n")).otherwise(0)).alias("fn"),
    )
    total = cells.agg(F.sum("n").alias("total"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    x = by.join(F.broadcast(total)).withColumn("precision", p).withColumn("recall", r)  # one row of totals
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return x.select("label", "tp", "fp", "fn", (F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), (F.col("tp") + F.col("fn")).alias("support"), *[F.round(c, 6).alias(c) for c in ("precision", "recall")], F.round(f1, 6).alias("f1"))


def overall(cells: DataFrame) -> DataFrame:
    """Accuracy and macro means over the labels of either side."""
    m = class_metrics(cells).agg(F.round(F.avg("precision"), 5).alias("macro_precision"), F.round(F.avg("recall"), 5).alias("macro_recall"), F.round(F.avg("f1"), 5).alias("macro_f1"))
    a = cells.agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return a.join(F.broadcast(m))
