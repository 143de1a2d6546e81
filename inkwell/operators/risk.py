"""Risk features of edits and of pairs; array expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import text as X

#: Spanish word lists of the meaning score.
PRONOUNS = ("me", "te", "se", "nos", "os", "le", "la", "lo", "les", "las", "los")
NEGATIONS = ("no", "ni", "nunca", "nada", "nadie", "ningún", "ninguna")
TEMPORAL = ("ayer", "hoy", "mañana", "antes", "después", "nunca", "siempre")
MODALS = ("tal vez", "quizás", "puede", "podría", "debe", "debería", "definitivamente")
ACCENTS = (("mas", "más"), ("si", "sí"), ("tu", "tú"), ("que", "qué"))
CONTRACTIONS = (("a el", "al"), ("de el", "del"))
#: Negation markers of each language.
NEGATION_MARKERS = {
    "en": ("no", "not", "n't", "never", "neither", "nor", "without", "none", "nobody", "nothing"),
    "es": ("no", "nunca", "jamás", "ni", "tampoco", "sin", "nada", "nadie", "ningún", "ninguna", "ninguno", "ningunas", "ningunos", "n't"),
}
#: Signs that open, the signs that close them, and those that do both.
OPENING, CLOSING, BOTH = "«“‘([{", "»”’)]}", "\"'"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0))


def escalation_flags(src: Column, tgt: Column, aligned: Column, label: Column) -> Column:
    """Distinct risk flags in the order they first occur, span by span; a changed pair without edits is one span."""
    found = X.edits(aligned)
    whole = F.array(F.struct(src.alias("old"), tgt.alias("new")))
    spans = F.when((F.size(found) == 0) & (src != "") & (tgt != "") & (src != tgt), whole).otherwise(found)
    capital = lambda c: F.filter(_words(c), lambda w: w.rlike(r"^\p{Lu}"))
    changed = F.aggregate(spans, F.lit(0), lambda acc, e: acc + F.greatest(F.size(_words(e["old"])), F.size(_words(e["new"]))))
    of_span = lambda e: F.array(
        F.when(~F.concat(e["old"], e["new"]).rlike(r"[\p{L}\p{N}]"), F.lit("punctuation_only")),
        F.when(_numbers(e["old"]) != _numbers(e["new"]), F.lit("number_change")),
        F.when(capital(e["old"]) != capital(e["new"]), F.lit("proper_noun_change")),
        F.when(F.concat(e["old"], e["new"]).rlike(r"https?://|www\.|@|[#{}()\[\]<>]"), F.lit("structured_token_change")),
    )
    of_row = F.array(F.when(changed >= 6, F.lit("long_rewrite_risk")), F.when(label.isin("FP1", "FP2", "Error"), F.lit("low_trust_label")))
    return F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(spans, of_span)), of_row)))


def routed(flags: Column, label: Column, backends: tuple[str, ...], labels: tuple[str, ...], on: tuple[str, ...]) -> Column:
    """The backend to escalate to, '' for none."""
    expert = backends[1] if len(backends) > 1 else ""
    return F.when(label.isin(*labels) | F.arrays_overlap(flags, F.array(*map(F.lit, on))), F.lit(expert)).otherwise(F.lit(""))


def information_loss(src: Column, tgt: Column) -> Column:
    """Half of the text gone and at most 0.4 of the words in common."""
    a, b = F.array_distinct(X.similarity_words(src)), F.array_distinct(X.similarity_words(tgt))
    drop = (F.length(src) - F.length(tgt)) / F.length(src)
    jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.coalesce((F.length(src) > 0) & (drop >= 0.5) & (jaccard <= 0.4), F.lit(False))


def unbalanced(text: Column) -> Column:
    """Brackets and quotes left open, and those that close nothing, read with a stack.

    The stack is a string; a sign that closes nothing is a # in front of it.
    """
    signs = F.regexp_extract_all(text, F.lit("[" + re.escape(OPENING + CLOSING + BOTH) + "]"), F.lit(0))
    pop = lambda s: F.substring(s, F.lit(1), F.length(s) - 1)
    step = lambda s, c: (
        F.when(F.instr(F.lit(OPENING), c) > 0, F.concat(s, c))
        .when(F.instr(F.lit(BOTH), c) > 0, F.when(F.right(s, F.lit(1)) == c, pop(s)).otherwise(F.concat(s, c)))
        .otherwise(F.when(F.right(s, F.lit(1)) == F.translate(c, CLOSING, OPENING), pop(s)).otherwise(F.concat(F.lit("#"), s)))
    )
    return F.length(F.aggregate(signs, F.lit(""), step))


def negation_flip(a: Column, b: Column, lang: str = "en") -> Column:
    marks = F.array(*map(F.lit, NEGATION_MARKERS[lang]))
    has = lambda c: F.arrays_overlap(X.similarity_words(c), marks)
    return (has(a) != has(b)) & a.rlike(r"\p{L}") & b.rlike(r"\p{L}")


def meaning_score(src: Column, tgt: Column) -> tuple[Column, Column]:
    """(severity up to 4, likelihood): numbers, pronouns, negation, time, modality; accents and contractions take back."""
    a, b = F.lower(src), F.lower(tgt)
    listed = lambda c, ws: F.filter(_words(c), lambda w: w.isin(*ws))
    modal = lambda c: F.array_compact(F.array(*[F.when(c.contains(m), F.lit(m)) for m in MODALS]))
    number = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(-[0-9]+)?"), F.lit(0))
    tests = [
        (number(src) != number(tgt), 3, 0.8),
        (listed(a, PRONOUNS) != listed(b, PRONOUNS), 2, 0.6),
        (F.size(listed(a, NEGATIONS)) != F.size(listed(b, NEGATIONS)), 4, 0.9),
        (listed(a, TEMPORAL) != listed(b, TEMPORAL), 2, 0.5),
        (modal(a) != modal(b), 1, 0.3),
    ]
    severity = reduce(lambda x, y: x + y, [F.when(t, F.lit(s)).otherwise(0) for t, s, _ in tests])
    likely = reduce(lambda x, y: x + y, [F.when(t, F.lit(p)).otherwise(0.0) for t, _, p in tests])
    for pairs in (ACCENTS, CONTRACTIONS):
        hit = reduce(lambda x, y: x | y, [a.contains(o) & b.contains(n) for o, n in pairs])
        severity = F.when(hit, F.greatest(F.lit(0), severity - 2)).otherwise(severity)
        likely = F.when(hit, F.greatest(F.lit(0.0), likely - 0.5)).otherwise(likely)
    return F.least(F.lit(4), severity), likely


def change_type(likely: Column) -> Column:
    return F.when(likely > 0.7, F.lit("critical")).when(likely > 0.4, F.lit("alteration")).when(likely > 0.2, F.lit("clarification")).otherwise(F.lit("none"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def change_bucket(distance: Column) -> Column:
    return F.when(distance < 0.10, F.lit("none")).when(distance < 0.25, F.lit("slight")).when(distance < 0.45, F.lit("moderate")).when(distance < 0.70, F.lit("strong")).otherwise(F.lit("extreme"))


def modular_label(nonsense: Column, meaning: Column, quality: Column) -> Column:
    return F.when(nonsense >= 2, F.lit("FP1")).when(meaning >= 2, F.lit("FP1")).when(quality < 0, F.lit("FP2")).when(quality < 1, F.lit("FP3")).otherwise(F.lit("TP"))
