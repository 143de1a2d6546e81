"""Pair filters, joins, distinct rows and expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X


def kept_pairs(df: DataFrame, src: str = "src", tgt: str = "tgt", aligned: str = "aligned", least: float = 0.55) -> DataFrame:
    """Rows not multi-line, both sides of 10 to 50 words, at most 4 edits, enough words in common.

    The cheap tests are a filter of their own below the Python one, so that the
    subsequence is only worked out for rows that pass them.  Null sides are rejected.
    """
    s, t = F.col(src), F.col(tgt)
    cheap = df.where(~s.contains("\n") & ~t.contains("\n") & X.length_ok(s, t) & (X.count_edits(F.col(aligned)) <= 4))
    return cheap.where(X.lcs_similarity(s, t) >= least)


def keep_first(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """The row with the smallest ``order`` of each combination of ``keys`` (nulls are equal).

    The first rows are found with partial aggregation, so a combination that fills a
    third of all rows is no hot group.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def upsert(base: DataFrame, updates: DataFrame, key: str, *columns: str) -> DataFrame:
    """Columns of ``base`` replaced by the non-null values of the one update a key has."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    x = base.join(new, key, "left")
    return x.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def expand_correct_and_missed(df: DataFrame, id_col: str, src: str, tgt: str) -> DataFrame:
    """Equal pairs give (src, src, TN); others (src, src, FN) and (tgt, tgt, TN)."""
    row = lambda c, l: F.struct(F.col(c).alias("src"), F.col(c).alias("tgt"), F.lit(l).alias("label"))
    rows = F.when(F.col(src) == F.col(tgt), F.array(row(src, "TN"))).otherwise(F.array(row(src, "FN"), row(tgt, "TN")))
    return df.select(id_col, F.inline(rows))


def match_votes_to_edits(units: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes on the first edit of their unit with the same old and new text.

    ``units``: unit_id, edits; ``votes``: unit_id, vote_id, annotation, label.  Both sides
    meet on (unit, old, new).
    """
    e = units.select("unit_id", F.posexplode("edits").alias("edit_no", "e")).groupBy("unit_id", F.col("e.old").alias("old"), F.col("e.new").alias("new")).agg(F.min("edit_no").alias("edit_no"))
    parts = F.split("annotation", "=>", 2)
    v = votes.where(F.contains("annotation", F.lit("=>"))).select("unit_id", "vote_id", "label", F.trim(parts[0]).alias("old"), F.trim(parts[1]).alias("new"))
    return v.join(e, ["unit_id", "old", "new"])
