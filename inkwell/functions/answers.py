"""Parsers of judges' answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import labels as L

#: Severity words of each false-positive class, in the order they are looked for.
SEVERITY_WORDS = (("FP1", "CRITICAL"), ("FP2", "MEDIUM"), ("FP3", "MINOR"))
#: Spellings of an edit with its class in a line of broken JSON.
EDIT_LINES = (r'"(\{[^}]*\})"\s*:\s*"(TP|FP[123])', r'(\{[^}]*\})\s*:\s*"?(TP|FP[123])"?', r'"([^"{}]*=>+[^"{}]*)"\s*:\s*"(TP|FP[123])"')


def _group(text: Column, pattern: str) -> Column:
    """First group of the first match, or null."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def severity_class(words: Column) -> Column:
    """The class that severity words name; null for none."""
    up = F.upper(words)
    return F.coalesce(*[F.when(up.contains(l) | up.contains(w), F.lit(l)) for l, w in SEVERITY_WORDS])


def severity_label(text: Column) -> Column:
    """Label of an answer that lists classifications and grades a false positive in words; Error where none is listed."""
    listed = F.upper(_group(text, r'(?i)"classifications"\s*:\s*\[([^\]]*)\]'))
    kind = F.coalesce(*[F.when(listed.contains(l), F.lit(l)) for l in ("TP", "TN", "FN", "FP")])
    graded = F.coalesce(severity_class(_group(text, r'(?i)"fp_severity"\s*:\s*"([^"]*)"')), F.lit("FP"))
    return F.when(kind == "FP", graded).otherwise(F.coalesce(kind, F.lit("Error")))


def feedback_label(text: Column) -> Column:
    """Label of a feedback answer: its classification before a slash, else the first label found by severity."""
    given = F.trim(F.split_part(_group(text, r'(?i)"classification"\s*:\s*"([^"]+)"'), F.lit("/"), F.lit(1)))
    up = F.upper(text)
    scan = F.coalesce(*[F.when(up.contains(l), F.lit(l)) for l in ("FP1", "FP2", "FP3", "TP")], F.lit("Error"))
    return F.when(text.isNull() | (text == ""), F.lit("Error")).when(given.isin("TP", "FP1", "FP2", "FP3"), given).otherwise(scan)


def votes(text: Column) -> Column:
    """The labels of a votes answer ``{"votes": [...]}`` in order; spellings are normalised, others left out."""
    given = F.coalesce(F.from_json(text, "votes array<string>")["votes"], F.array().cast("array<string>"))
    return F.filter(F.transform(given, lambda v: F.upper(F.trim(v))), lambda v: v.isin(*L.LABELS))


def batch_answers(text: Column, size: Column) -> Column:
    """``size`` (label, reasoning) pairs of an answer that holds a JSON list; missing ones are errors."""
    inside = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    item = "label string, classification string, classifications array<string>, fp_severity string, reasoning string, explanation string"
    items = F.coalesce(F.from_json(inside, f"array<struct<{item.replace(' string', ':string').replace(' array', ':array')}>>"), F.array())
    kind = lambda x: F.upper(F.coalesce(x["label"], x["classification"], F.get(x["classifications"], F.lit(0)), F.lit("Error")))
    label = lambda x: F.when(kind(x) == "FP", F.coalesce(severity_class(x["fp_severity"]), F.lit("FP"))).otherwise(kind(x))
    found = F.transform(items, lambda x: F.struct(label(x).alias("label"), F.left(F.coalesce(x["reasoning"], x["explanation"], F.lit("")), F.lit(200)).alias("reasoning")))
    failed = F.array_repeat(F.struct(F.lit("Error").alias("label"), F.lit("Batch parsing failed").alias("reasoning")), size)
    return F.slice(F.concat(found, failed), F.lit(1), size)


def salvaged_edits(text: Column) -> Column:
    """(edit, class) pairs that broken edit JSON still shows, in order of the spellings, each once."""
    found = [F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda e, c: F.struct(F.when(e.startswith("{"), e).otherwise(F.concat(F.lit("{"), e, F.lit("}"))).alias("edit"), c.alias("label"))) for p in EDIT_LINES]
    return F.array_distinct(F.concat(*found))


def salvaged(text: Column) -> Column:
    """Fields that broken edit JSON still shows, with the defaults of those it does not."""
    return F.struct(
        F.coalesce(_group(text, r'"writing_type"\s*:\s*"([^"]+)"'), F.lit("Other")).alias("writing_type"),
        F.coalesce(_group(text, r'"missed_error"\s*:\s*(true|false)') == "true", F.lit(False)).alias("missed_error"),
        F.coalesce(_group(text, r'"reasoning"\s*:\s*"([^"]+)"'), F.lit("Unable to extract reasoning")).alias("reasoning"),
        salvaged_edits(text).alias("edits"),
    )
