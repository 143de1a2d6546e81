"""Records that differ in form only, found by refining a partition step by step.

A class of the partition is split by the next, dearer key only while it has several
members:

1. the number of letters and digits of the pair and a histogram of letter groups, both
   symmetric in the two fields and read off the text without sorting it;
2. for the members of classes of two and more only, a digest of the bare pair, the
   fields in a fixed order so that swapped ones meet.  The digest is made while the
   text is at hand, since 16 bytes travel cheaper than a text; it is grouped on inside
   those classes alone.

Classes are counted with partial aggregation and members are matched to their class by
an ordinary equi-join, so that a class holding a third of all rows is never gathered
in one task (adaptive execution splits the join's hot partition; only one short row
per class is on its other side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.lineage import cut

#: White space and punctuation as Unicode has them, with the ASCII signs that Unicode
#: files under symbols.
FORM = r"[\s\p{Z}\u0085\p{P}$+<=>^`|~]+"
#: Letters counted by the histogram: frequent ones of the scripts in use.
HISTOGRAM = ("e", "a", "n", "t", "о", "и", "р", "1")


def bare(text: Column) -> Column:
    """Text without white space, punctuation and letter case; null counts as empty.

    Case goes by folding, so that ß and SS are the same and so are the two small sigmas.
    """
    low = F.lower(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), FORM, "")))
    return F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ς", "σ")


def _invariant(a: Column, b: Column) -> Column:
    both = F.concat(a, b)
    counts = [F.length(F.replace(both, F.lit(c), F.lit(""))) for c in HISTOGRAM]
    return F.xxhash64(F.length(both), F.greatest(F.length(a), F.length(b)), *counts)


def formatting_sets(df: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """Members of every set of two and more records equal but for their form.

    Result: ``set_id`` (smallest id of the set), ``member_id``, ``copies`` (size of the
    set).  Exact copies count; fields may have changed places; a null field is an empty
    one; records without any letter or digit in both fields are in no set; columns
    other than the three named are not read.
    """
    rows = df.select(F.col(id_col).alias("member_id"), bare(F.col(left)).alias("_a"), bare(F.col(right)).alias("_b"))
    rows = rows.select(
        "member_id",
        _invariant(F.col("_a"), F.col("_b")).alias("_inv"),
        F.unhex(F.md5(F.concat(F.least("_a", "_b"), F.lit("\x1f"), F.greatest("_a", "_b")).cast("binary"))).alias("_key"),
        ((F.col("_a") == "") & (F.col("_b") == "")).alias("_blank"),
    )
    rows = cut(rows).where("not _blank")  # a short row each: the texts are read and stripped once
    several = rows.groupBy("_inv").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_inv")
    members = rows.join(several.hint("merge"), "_inv")  # one row a class grows with the rows: no broadcast
    sets = members.groupBy("_inv", "_key").agg(F.min("member_id").alias("set_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return members.join(sets, ["_inv", "_key"]).select("set_id", "member_id", "copies")


def collapse(df: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """One record per set of equals (its smallest id) with ``copies``, 1 for single ones."""
    sets = formatting_sets(df, id_col, left, right)
    later = sets.where("member_id <> set_id").select(F.col("member_id").alias(id_col))
    sizes = sets.where("member_id = set_id").select(F.col("set_id").alias(id_col), "copies")
    return df.join(later, id_col, "left_anti").join(sizes, id_col, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each later copy of a gold pair beside the first of its set."""
    gold = spark.read.parquet(f"{sf_dir}/gold_annotations.parquet")
    sets = formatting_sets(gold, "row_id", "src", "tgt").where("member_id <> set_id")
    return sets.select(F.col("set_id").alias("row_id_a"), F.col("member_id").alias("row_id_b"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs without later copies, and the number of copies of each."""
    gold = spark.read.parquet(f"{sf_dir}/gold_annotations.parquet").select("row_id", "src", "tgt")
    return collapse(gold, "row_id", "src", "tgt").select("row_id", "copies")
