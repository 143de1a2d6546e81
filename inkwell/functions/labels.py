"""Label algebra: normal forms, crowd labels, severities, weights, parsers of answers.

Every map is stated once here; operators take the expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("TP", "FP1", "FP2", "FP3", "TN", "FN")
#: Raw crowd labels.
CROWD = {"good_edit": "TP", "optional_edit": "FP3", "incorrect_grammar_edit": "FP2", "hallucination_or_meaning_change": "FP1", "TP": "TP", "FP1": "FP1", "FP2": "FP2", "FP3": "FP3"}
SEVERITY = {"FP1": 4, "FP2": 3, "FP3": 2, "TP": 1}
WEIGHT_5 = {"TP-S": 5, "TP": 5, "TP-W": 3, "FP3": 1, "FP2": -1, "FP1": -3}
WEIGHT_BINARY = {"TN": 1, "FN": -1}
NON_ADJACENT = {"TP": ("FP2", "FP1"), "FP3": ("FP1",), "FP2": ("TP",), "FP1": ("TP", "FP3"), "TN": ("FN",), "FN": ("TN",)}


def lookup(key: Column, table: dict[str, object], default: object = None) -> Column:
    """Chained CASE over a small constant map; codegen-friendly."""
    expr = reduce(lambda e, kv: e.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))
    return expr.otherwise(F.lit(default))


def clean_null(c: Column) -> Column:
    """Null for null, blank, 'nan' and 'none' in any case."""
    return F.when(F.lower(F.trim(c)).isin("", "nan", "none"), F.lit(None)).otherwise(c)


def normalized(c: Column) -> Column:
    """One of the six labels, else 'Error'; null and blank are errors too."""
    up = F.upper(F.trim(c))
    return F.when(up.isin(*LABELS), up).otherwise(F.lit("Error"))


def crowd_label(c: Column) -> Column:
    return lookup(F.trim(c), CROWD)


def severity(c: Column) -> Column:
    return lookup(c, SEVERITY, 0)


def worst(labels: Column) -> Column:
    """The most severe label of an array."""
    return F.array_max(F.transform(labels, lambda l: F.struct(severity(l).alias("s"), l.alias("l"))))["l"]


def binary(c: Column) -> Column:
    return F.when(c.isin("TP", "TN"), F.lit("TP")).otherwise(F.lit("FP"))


def simplified(c: Column) -> Column:
    return F.when(c.isin("TP", "TN", "FP3"), F.lit("TP")).otherwise(F.lit("FP"))


def four_class(c: Column) -> Column:
    """Judge label to class: strong TP, weak TP as FP3, six labels as they are, else FP2."""
    return F.when(c == "TP-S", F.lit("TP")).when(c == "TP-W", F.lit("FP3")).when(c.isin(*LABELS), c).otherwise(F.lit("FP2"))


def judged_class(c: Column) -> Column:
    """Class of a judge's raw label; null, blank and 'Error' stay failures, other unknown labels are FP2."""
    up = F.upper(F.trim(c))
    return F.when(c.isNull() | up.isin("", "NAN", "ERROR"), F.lit("Error")).otherwise(four_class(up))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def parsed_label(text: Column) -> Column:
    """Label of a judge's answer: JSON keys first, then the first label in scan order; else Error."""
    up = F.upper(text)
    one = _first(up, r'"CLASSIFICATION"\s*:\s*"([A-Z0-9]+)"')
    inside = _first(up, r'"CLASSIFICATIONS"\s*:\s*\[(.*?)\]')
    many = _first(inside, r'"?(TP|TN|FN|FP1|FP2|FP3|FP)"?')
    grade = _first(up, r'"FP_SEVERITY"\s*:\s*"?(FP[123])')
    label = _first(up, r'"LABEL"\s*:\s*"(TP|TN|FN|FP1|FP2|FP3)"')
    padded = F.concat(F.lit(" "), up)
    scan = F.coalesce(*[F.when(padded.contains(f" {l}"), F.lit(l)) for l in ("TP", "TN", "FN", "FP1", "FP2", "FP3")])
    return F.coalesce(F.when(one.isin(*LABELS), one), F.when(many == "FP", F.coalesce(grade, many)).otherwise(many), label, scan, F.lit("Error"))


def parsed_tnfn(text: Column) -> Column:
    up = F.upper(text)
    return F.when(text.isNull() | (text == ""), F.lit("FN")).otherwise(F.coalesce(_first(up, r'"CLASSIFICATION"\s*:\s*"(TN|FN)"'), F.when(F.concat(F.lit(" "), up).contains(" TN"), F.lit("TN")), F.lit("FN")))


def parsed_baseline(text: Column) -> Column:
    """Default TN; a JSON classification or the first label found in severity order."""
    up = F.upper(text)
    has = F.lower(text).rlike(r'"classification"\s*:\s*"[^"]*"')
    value = F.regexp_extract(up, r'"CLASSIFICATION"\s*:\s*"([^"]*)"', 1)
    scan = F.coalesce(*[F.when(up.contains(l), F.lit(l)) for l in ("FP1", "FP2", "FP3", "TP", "TN", "FN")], F.lit("TN"))
    return F.when(text.isNull() | (text == ""), F.lit("TN")).when(has, F.when(value.isin(*LABELS), value).otherwise(F.lit("TN"))).otherwise(scan)


def parsed_writing_type(text: Column) -> Column:
    a = _first(text, r'(?i)"type_of_writing"\s*:\s*"([^"]+)"')
    b = _first(text, r'(?i)"writing_type"\s*:\s*"([^"]+)"')
    return F.coalesce(F.trim(a), F.trim(b), F.lit(""))


def kappa_level(k: Column) -> Column:
    return F.when(k < 0.2, F.lit("poor")).when(k < 0.4, F.lit("fair")).when(k < 0.6, F.lit("moderate")).when(k < 0.8, F.lit("substantial")).otherwise(F.lit("almost perfect"))
