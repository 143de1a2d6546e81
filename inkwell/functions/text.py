"""Text and inline-alignment expressions; all but the subsequence stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMILARITY_WORD = re.compile(r"[\w']+")

EDIT = r"\{([^{}]*?)=>([^{}]*?)\}"
UPPER, LOWER = "A-ZА-ЯІЇЄҐ", "a-zа-яіїєґ"


def n_words(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def length_ok(src: Column, tgt: Column, low: int = 10, high: int = 50) -> Column:
    return n_words(src).between(low, high) & n_words(tgt).between(low, high)


def count_edits(aligned: Column) -> Column:
    return F.coalesce(F.regexp_count(aligned, F.lit(EDIT)), F.lit(0))


def edits(aligned: Column) -> Column:
    """Inline edits as array<struct<old, new>>, trimmed; empty for null."""
    old, new = (F.regexp_extract_all(aligned, F.lit(EDIT), F.lit(g)) for g in (1, 2))
    return F.coalesce(F.zip_with(old, new, lambda o, n: F.struct(F.trim(o).alias("old"), F.trim(n).alias("new"))), F.array().cast("array<struct<old:string,new:string>>"))


def project_src(aligned: Column) -> Column:
    return F.trim(F.regexp_replace(aligned, EDIT, "$1"))


def project_tgt(aligned: Column) -> Column:
    return F.trim(F.regexp_replace(aligned, EDIT, "$2"))


def edit_type(old: Column, new: Column) -> Column:
    return F.when((old == "") & (new != ""), F.lit("insertion")).when((old != "") & (new == ""), F.lit("deletion")).when(old == new, F.lit("no_change")).otherwise(F.lit("substitution"))


def fix_punctuation_spacing(c: Column) -> Column:
    c = F.regexp_replace(c, f"([.!?])([{UPPER}][{LOWER}])", "$1 $2")
    c = F.regexp_replace(c, r"([.!?])([0-9])", "$1 $2")
    return F.trim(F.regexp_replace(c, f"([{LOWER}])([{UPPER}])", "$1. $2"))


def split_sentences(c: Column) -> Column:
    """Sentences of the text with its punctuation spaced: split after . ! ? before a capital, trimmed, empty ones dropped."""
    parts = F.split(fix_punctuation_spacing(c), rf"(?<=[.!?])\s+(?=[{UPPER}])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def middle_word_spans(aligned: Column) -> Column:
    """Edits with a letter or digit on either side."""
    return F.coalesce(F.regexp_count(aligned, F.lit(r"[\p{L}\p{N}]\{[^}]*=>[^}]*\}(?=[\p{L}\p{N}])")), F.lit(0))


def clean_reasoning(c: Column, limit: int = 500) -> Column:
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def strip_markup(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>|\[/?[a-z-]+\]", ""), r"\s+", " "))


def similarity_words(c: Column) -> Column:
    """Lower-case word tokens that the subsequence similarity compares."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[\w']+"), F.lit(0))


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by one row of bits over ``a``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        if hit := row & places.get(y, 0):
            row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def lcs_similarity(src: pd.Series, tgt: pd.Series) -> pd.Series:
    """Common subsequence of the words over the longer side; 0 for a side without words, null for null."""
    out = []
    for s, t in zip(src, tgt, strict=True):
        if s is None or t is None:
            out.append(None)
            continue
        a, b = _SIMILARITY_WORD.findall(s.lower()), _SIMILARITY_WORD.findall(t.lower())
        out.append(_common(a, b) / max(len(a), len(b)) if a and b else 0.0)
    return pd.Series(out, dtype="float64")
