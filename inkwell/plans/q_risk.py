"""Queries over risk features and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import labels as L
from inkwell.operators import risk as R
from inkwell.plans.registry import query
from inkwell.sources.tables import table


def _gold(spark, d):
    return table(spark, d, "gold_annotations", "row_id", "src", "tgt", "aligned", "label")


_SPANS = r"""e AS (SELECT row_id, label, src, tgt, CASE WHEN len(regexp_extract_all(coalesce(aligned,''), '\{([^{}]*?)=>([^{}]*?)\}', 1)) = 0 AND src <> '' AND tgt <> '' AND src <> tgt THEN [{'o': coalesce(src,''), 'n': coalesce(tgt,'')}] ELSE list_transform(list_zip(regexp_extract_all(coalesce(aligned,''), '\{([^{}]*?)=>([^{}]*?)\}', 1), regexp_extract_all(coalesce(aligned,''), '\{([^{}]*?)=>([^{}]*?)\}', 2)), lambda p: {'o': trim(p[1],' '), 'n': trim(p[2],' ')}) END AS s FROM gold_annotations)"""
_W = r"list_filter(regexp_split_to_array(x.{c}, '[ \t\n\r\f\x{{0B}}]+'), lambda w: w <> '')"
_FLAGS = rf"""SELECT row_id, label, src, tgt, list_filter(list_concat(flatten(list_transform(s, lambda x: [
 CASE WHEN NOT regexp_matches(x.o || x.n, '[\p{{L}}\p{{N}}]') THEN 'punctuation_only' END,
 CASE WHEN regexp_extract_all(x.o, '[0-9]+') <> regexp_extract_all(x.n, '[0-9]+') THEN 'number_change' END,
 CASE WHEN list_filter({_W.format(c='o')}, lambda w: regexp_matches(w, '^\p{{Lu}}')) <> list_filter({_W.format(c='n')}, lambda w: regexp_matches(w, '^\p{{Lu}}')) THEN 'proper_noun_change' END,
 CASE WHEN regexp_matches(x.o || x.n, 'https?://|www\.|@|[#{{}}()\[\]<>]') THEN 'structured_token_change' END])),
 [CASE WHEN coalesce(list_sum(list_transform(s, lambda x: greatest(len({_W.format(c='o')}), len({_W.format(c='n')})))),0) >= 6 THEN 'long_rewrite_risk' END,
 CASE WHEN label IN ('FP1','FP2','Error') THEN 'low_trust_label' END]), lambda f: f IS NOT NULL) AS flags FROM e"""
#: The flags without repetition, in the order they first occur.
_ORDERED = "list_filter(flags, lambda f, i: list_position(flags, f) = i)"


@query("k1_escalation_flags", f"WITH {_SPANS}, f AS ({_FLAGS}) SELECT row_id, array_to_string({_ORDERED}, ',') AS flags FROM f")
def k1_escalation_flags(spark, d):
    g = _gold(spark, d)
    return g.select("row_id", F.array_join(R.escalation_flags(F.col("src"), F.col("tgt"), F.col("aligned"), F.col("label")), ",").alias("flags"))


@query("k2_routes", f"WITH {_SPANS}, f AS ({_FLAGS}) SELECT CASE WHEN label IN ('FP1','FN') OR list_has_any(flags, ['number_change','long_rewrite_risk']) THEN 'expert' ELSE '' END AS backend, count(*) AS n FROM f GROUP BY 1")
def k2_routes(spark, d):
    g = _gold(spark, d)
    flags = R.escalation_flags(F.col("src"), F.col("tgt"), F.col("aligned"), F.col("label"))
    route = R.routed(flags, F.col("label"), ("small", "expert"), ("FP1", "FN"), ("number_change", "long_rewrite_risk"))
    return g.groupBy(route.alias("backend")).agg(F.count(F.lit(1)).alias("n"))


@query("k3_number_changes", r"SELECT row_id FROM gold_annotations WHERE list_sort(list_distinct(regexp_extract_all(coalesce(src,''), '[0-9]+'))) <> list_sort(list_distinct(regexp_extract_all(coalesce(tgt,''), '[0-9]+')))")
def k3_number_changes(spark, d):
    n = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[0-9]+"), F.lit(0))))
    return _gold(spark, d).where(n("src") != n("tgt")).select("row_id")


@query("k3_information_loss")
def k3_information_loss(spark, d):
    """Word sets need Unicode words, which RE2 lacks; tested against brute force."""
    return _gold(spark, d).where(R.information_loss(F.col("src"), F.col("tgt"))).select("row_id")


_STACK = """length(list_reduce(regexp_extract_all({c}, '[«“‘(\\[{{»”’)\\]}}"'']'), lambda s, c:
 CASE WHEN contains('«“‘([{{', c) THEN s || c
  WHEN c IN ('"', '''') THEN CASE WHEN right(s, 1) = c THEN left(s, length(s) - 1) ELSE s || c END
  WHEN right(s, 1) = translate(c, '»”’)]}}', '«“‘([{{') THEN left(s, length(s) - 1) ELSE '#' || s END, ''))"""


@query("k4_balance_regressions", f"SELECT row_id, {_STACK.format(c='src')} AS of_src, {_STACK.format(c='tgt')} AS of_tgt FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL AND {_STACK.format(c='tgt')} > {_STACK.format(c='src')}")
def k4_balance_regressions(spark, d):
    """Pairs whose target leaves more brackets and quotes unbalanced."""
    g = _gold(spark, d).where("src is not null and tgt is not null").select("row_id", R.unbalanced(F.col("src")).cast("bigint").alias("of_src"), R.unbalanced(F.col("tgt")).cast("bigint").alias("of_tgt"))
    return g.where("of_tgt > of_src")


@query("k4_balances", f"SELECT row_id, {_STACK.format(c='aligned')} AS open_signs FROM gold_annotations WHERE aligned IS NOT NULL")
def k4_balances(spark, d):
    return _gold(spark, d).where("aligned is not null").select("row_id", R.unbalanced(F.col("aligned")).cast("bigint").alias("open_signs"))


def _flips(lang):
    marks = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in R.NEGATION_MARKERS[lang]) + "]"
    has = lambda c: f"list_has_any(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}\\p{{M}}_'']+'), {marks})"
    return f"SELECT row_id, '{lang}' AS lang FROM gold_annotations WHERE {has('src')} <> {has('tgt')} AND regexp_matches(src, '\\p{{L}}') AND regexp_matches(tgt, '\\p{{L}}')"


@query("k7_negation_flips", _flips("en") + " UNION ALL " + _flips("es"))
def k7_negation_flips(spark, d):
    """Pairs whose sides differ in having a negation marker, by the markers of each language; one pass."""
    langs = F.array_compact(F.array(*[F.when(R.negation_flip(F.col("src"), F.col("tgt"), l), F.lit(l)) for l in R.NEGATION_MARKERS]))
    return _gold(spark, d).select("row_id", F.explode(langs).alias("lang"))


def _listed(c, ws):
    return f"list_filter(regexp_split_to_array(lower({c}), '[ \\t\\n\\r\\f\\x{{0B}}]+'), lambda w: list_contains({list(ws)!r}, w))"


def _modal(c):
    return "list_filter([" + ", ".join(f"CASE WHEN contains(lower({c}), '{m}') THEN '{m}' END" for m in R.MODALS) + "], lambda m: m IS NOT NULL)"


def _hit(pairs):
    return "(" + " OR ".join(f"(contains(lower(src),'{o}') AND contains(lower(tgt),'{n}'))" for o, n in pairs) + ")"


_TESTS = [
    ("regexp_extract_all(src, '[0-9]+(-[0-9]+)?') <> regexp_extract_all(tgt, '[0-9]+(-[0-9]+)?')", 3, 0.8),
    (f"{_listed('src', R.PRONOUNS)} <> {_listed('tgt', R.PRONOUNS)}", 2, 0.6),
    (f"len({_listed('src', R.NEGATIONS)}) <> len({_listed('tgt', R.NEGATIONS)})", 4, 0.9),
    (f"{_listed('src', R.TEMPORAL)} <> {_listed('tgt', R.TEMPORAL)}", 2, 0.5),
    (f"{_modal('src')} <> {_modal('tgt')}", 1, 0.3),
]
_K8 = (
    "WITH t AS (SELECT row_id, " + " + ".join(f"CASE WHEN {t} THEN {s} ELSE 0 END" for t, s, _ in _TESTS) + " AS sev, "
    + " + ".join(f"CASE WHEN {t} THEN {p}::DOUBLE ELSE 0 END" for t, _, p in _TESTS) + f" AS lik, {_hit(R.ACCENTS)} AS acc, {_hit(R.CONTRACTIONS)} AS con FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL), "
    "a AS (SELECT row_id, con, CASE WHEN acc THEN greatest(0, sev-2) ELSE sev END AS sev, CASE WHEN acc THEN greatest(0, lik-0.5) ELSE lik END AS lik FROM t), "
    "b AS (SELECT row_id, CASE WHEN con THEN greatest(0, sev-2) ELSE sev END AS sev, CASE WHEN con THEN greatest(0, lik-0.5) ELSE lik END AS lik FROM a) "
    "SELECT row_id, least(4, sev) AS severity, round(lik, 4) AS likelihood, CASE WHEN round(lik,4) > 0.7 THEN 'critical' WHEN round(lik,4) > 0.4 THEN 'alteration' WHEN round(lik,4) > 0.2 THEN 'clarification' ELSE 'none' END AS kind FROM b"
)


@query("k8_meaning_change", _K8)
def k8_meaning_change(spark, d):
    """Likelihoods are rounded before the thresholds, so that sums of tenths compare as meant."""
    sev, lik = R.meaning_score(F.col("src"), F.col("tgt"))
    x = _gold(spark, d).where("src is not null and tgt is not null").select("row_id", sev.alias("severity"), F.round(lik, 4).alias("likelihood"))
    return x.withColumn("kind", R.change_type(F.col("likelihood")))


@query("k9_modular_cascade", "WITH n AS (SELECT unit_id, count(*) FILTER (label='FP1') AS a, count(*) FILTER (label='FP2') AS b, count(*) FILTER (label='TP') - count(*) FILTER (label LIKE 'FP%') AS q FROM (SELECT trim(idx) AS unit_id, upper(trim(tp_fp_label)) AS label FROM ensemble) GROUP BY 1) SELECT CASE WHEN a >= 2 THEN 'FP1' WHEN b >= 2 THEN 'FP1' WHEN q < 0 THEN 'FP2' WHEN q < 1 THEN 'FP3' ELSE 'TP' END AS label, count(*) AS units FROM n GROUP BY 1")
def k9_modular_cascade(spark, d):
    e = table(spark, d, "ensemble", "idx", "tp_fp_label").select(F.trim("idx").alias("unit_id"), F.upper(F.trim("tp_fp_label")).alias("label"))
    n = e.groupBy("unit_id").agg(F.count_if(F.col("label") == "FP1").alias("a"), F.count_if(F.col("label") == "FP2").alias("b"), (F.count_if(F.col("label") == "TP") - F.count_if(F.col("label").startswith("FP"))).alias("q"))
    return n.groupBy(R.modular_label(F.col("a"), F.col("b"), F.col("q")).alias("label")).agg(F.count(F.lit(1)).alias("units"))


@query("k14_reconciled_labels", "SELECT row_id, CASE WHEN src = tgt AND l = 'TP' THEN 'TN' WHEN src = tgt AND l LIKE 'FP%' THEN 'FN' WHEN src <> tgt AND l = 'TN' THEN 'TP' ELSE l END AS label FROM (SELECT row_id, src, tgt, CASE WHEN upper(trim(tp_fp_label)) IN ('TP','FP1','FP2','FP3','TN','FN') THEN upper(trim(tp_fp_label)) ELSE 'Error' END AS l FROM ensemble)")
def k14_reconciled_labels(spark, d):
    e = table(spark, d, "ensemble", "row_id", "src", "tgt", "tp_fp_label").withColumn("l", L.normalized(F.col("tp_fp_label")))
    same = F.col("src") == F.col("tgt")
    return e.select("row_id", F.when(same & (F.col("l") == "TP"), F.lit("TN")).when(same & F.col("l").startswith("FP"), F.lit("FN")).when((F.col("src") != F.col("tgt")) & (F.col("l") == "TN"), F.lit("TP")).otherwise(F.col("l")).alias("label"))
