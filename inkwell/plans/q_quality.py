"""Queries over label quality, distributions and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import labels as L
from inkwell.functions import text as X
from inkwell.operators import agreement as A
from inkwell.operators import quality as Q
from inkwell.operators import votes as V
from inkwell.plans.q_votes import EDIT_MAJ, LONG, _votes
from inkwell.plans.registry import query
from inkwell.sources.tables import table

NORM = "CASE WHEN upper(trim({c})) IN ('TP','FP1','FP2','FP3','TN','FN') THEN upper(trim({c})) ELSE 'Error' END"
#: A judge's label as a class: failures stay, weak and strong TP are told apart, anything else unknown is FP2.
FOUR = "CASE WHEN tp_fp_label IS NULL OR lower(trim(tp_fp_label)) IN ('', 'nan', 'error') THEN 'Error' WHEN upper(trim(tp_fp_label)) = 'TP-S' THEN 'TP' WHEN upper(trim(tp_fp_label)) = 'TP-W' THEN 'FP3' WHEN upper(trim(tp_fp_label)) IN ('TP','FP1','FP2','FP3','TN','FN') THEN upper(trim(tp_fp_label)) ELSE 'FP2' END"
PREDS = f"preds AS (SELECT row_id, model, writing_type, {NORM.format(c='gold_specialized')} AS gold, {FOUR} AS pred FROM ensemble WHERE gold_specialized IS NOT NULL)"
GOOD = "good AS (SELECT * FROM preds WHERE pred <> 'Error' AND gold <> 'Error')"
METRICS = """tot AS (SELECT count(*) AS n FROM {src}), labs AS (SELECT {g} AS label FROM {src} UNION SELECT {p} FROM {src}),
m AS (SELECT label, (SELECT count(*) FROM {src} WHERE {g}=label AND {p}=label) AS tp, (SELECT count(*) FROM {src} WHERE {g}<>label AND {p}=label) AS fp, (SELECT count(*) FROM {src} WHERE {g}=label AND {p}<>label) AS fn FROM labs),
r AS (SELECT label, tp, fp, fn, (SELECT n FROM tot)-tp-fp-fn AS tn, tp+fn AS support, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0 END AS p, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0 END AS q FROM m),
met AS (SELECT label, tp, fp, fn, tn, support, round(p,6) AS precision, round(q,6) AS recall, round(CASE WHEN p+q>0 THEN 2*p*q/(p+q) ELSE 0.0 END,6) AS f1 FROM r)"""


def _preds(spark, d):
    e = table(spark, d, "ensemble", "row_id", "model", "writing_type", "gold_specialized", "tp_fp_label", "total_tokens", "total_cost_usd").where("gold_specialized is not null")
    return e.withColumns({"gold": L.normalized(F.col("gold_specialized")), "pred": L.judged_class(F.col("tp_fp_label"))})


def _good(spark, d):
    return _preds(spark, d).where("pred <> 'Error' and gold <> 'Error'")


@query("a19_class_metrics", f"WITH {PREDS}, {GOOD}, {METRICS.format(src='good', g='gold', p='pred')} SELECT * FROM met")
def a19_class_metrics(spark, d):
    return Q.class_metrics(Q.confusion(_good(spark, d), "gold", "pred"))


@query("a19_overall", f"WITH {PREDS}, {GOOD}, {METRICS.format(src='good', g='gold', p='pred')} SELECT (SELECT n FROM tot) AS n, (SELECT round(avg(CASE WHEN gold=pred THEN 1.0 ELSE 0.0 END),6) FROM good) AS accuracy, round(avg(precision),5) AS macro_precision, round(avg(recall),5) AS macro_recall, round(avg(f1),5) AS macro_f1 FROM met")
def a19_overall(spark, d):
    return Q.overall(Q.confusion(_good(spark, d), "gold", "pred"))


_BIN = f"bin AS (SELECT CASE WHEN gold IN ('TP','TN') THEN 'TP' ELSE 'FP' END AS gold, CASE WHEN pred IN ('TP','TN') THEN 'TP' ELSE 'FP' END AS pred FROM preds)"


@query("a20_binary_metrics", f"WITH {PREDS}, {_BIN}, {METRICS.format(src='bin', g='gold', p='pred')} SELECT * FROM met")
def a20_binary_metrics(spark, d):
    """Failed rows count as FP, as the binary map sends every unknown label there."""
    b = _preds(spark, d).select(L.binary(F.col("gold")).alias("gold"), L.binary(F.col("pred")).alias("pred"))
    return Q.class_metrics(Q.confusion(b, "gold", "pred"))


@query("a21_simplified_accuracy", f"WITH {PREDS} SELECT model, count(*) AS n, round(avg(CASE WHEN (gold IN ('TP','TN','FP3')) = (pred IN ('TP','TN','FP3')) THEN 1.0 ELSE 0.0 END),6) AS accuracy FROM preds GROUP BY model")
def a21_simplified_accuracy(spark, d):
    same = (L.simplified(F.col("gold")) == L.simplified(F.col("pred"))).cast("double")
    return _preds(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("accuracy"))


@query("a22_distribution", "SELECT coalesce(nullif(upper(trim(gold_specialized)),''),'Unknown') AS gold, CASE WHEN tp_fp_label IS NULL OR lower(trim(tp_fp_label)) IN ('','nan','none') THEN 'Error' ELSE trim(tp_fp_label) END AS pred, count(*) AS n FROM ensemble GROUP BY 1, 2")
def a22_distribution(spark, d):
    e = table(spark, d, "ensemble", "gold_specialized", "tp_fp_label")
    gold = F.coalesce(F.nullif(F.upper(F.trim("gold_specialized")), F.lit("")), F.lit("Unknown"))
    return Q.confusion(e.select(gold.alias("g"), F.coalesce(F.trim(L.clean_null(F.col("tp_fp_label"))), F.lit("Error")).alias("p")), "g", "p")


@query("a23_error_patterns", f"WITH {PREDS}, {GOOD} SELECT gold || ' -> ' || pred AS pattern, count(*) AS n FROM good WHERE gold <> pred GROUP BY 1")
def a23_error_patterns(spark, d):
    return _good(spark, d).where("gold <> pred").groupBy(F.concat_ws(" -> ", "gold", "pred").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


_LANG = "CASE WHEN lower(trim(language)) IN ('en','eng','english') THEN 'en' WHEN lower(trim(language)) IN ('de','deu','ger','german') THEN 'de' WHEN lower(trim(language)) IN ('uk','ua','ukr','ukrainian') THEN 'uk' WHEN lower(trim(language)) IN ('es','spa','spanish') THEN 'es' WHEN lower(trim(language)) IN ('it','ita','italian') THEN 'it' WHEN lower(trim(language)) IN ('ru','rus','russian') THEN 'ru' ELSE 'unknown' END"
SPELLINGS = {"en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "uk": ("uk", "ua", "ukr", "ukrainian"), "es": ("es", "spa", "spanish"), "it": ("it", "ita", "italian"), "ru": ("ru", "rus", "russian")}


def _language():
    return L.lookup(F.lower(F.trim("language")), {s: l for l, ss in SPELLINGS.items() for s in ss}, "unknown")


def _report(spark, d):
    return table(spark, d, "generate_report", "report_id", "llm_label", "human_label", "language").withColumn("lang", _language())


@query("a24_agreement", f"SELECT coalesce(lang,'all') AS lang, count(*) AS n, round(100.0*avg(CASE WHEN llm_label = human_label THEN 1.0 ELSE 0.0 END),4) AS agreement FROM (SELECT {_LANG} AS lang, llm_label, human_label FROM generate_report) GROUP BY ROLLUP(lang)")
def a24_agreement(spark, d):
    same = F.coalesce((F.col("llm_label") == F.col("human_label")).cast("double"), F.lit(0.0))
    return _report(spark, d).rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(same), 4).alias("agreement")).withColumn("lang", F.coalesce("lang", F.lit("all")))


@query("a25_retention", f"WITH {LONG}, {EDIT_MAJ}, t AS (SELECT unit_id, edit_no, max(m) AS m, count(*) FILTER (c = m) AS k FROM (SELECT cnt.*, max(c) OVER (PARTITION BY unit_id, edit_no) AS m FROM cnt) GROUP BY 1, 2), u AS (SELECT unit_id, max(k) = 1 AS no_ties, min(m) >= 3 AS is_strict FROM t GROUP BY 1) SELECT 'ALL' AS strategy, count(*) AS kept FROM u UNION ALL SELECT 'TIES', count(*) FILTER (no_ties) FROM u UNION ALL SELECT 'STRICT', count(*) FILTER (is_strict) FROM u")
def a25_retention(spark, d):
    s = V.edit_statistics(_votes(spark, d)).groupBy("unit_id").agg((~F.bool_or("tie")).alias("no_ties"), (F.min("dominant_votes") >= 3).alias("is_strict"))
    one = s.agg(F.count(F.lit(1)).alias("a"), F.count_if("no_ties").alias("t"), F.count_if("is_strict").alias("s"))
    return one.select(F.expr("stack(3, 'ALL', a, 'TIES', t, 'STRICT', s) as (strategy, kept)"))


_FLEISS = """cnt AS (SELECT {i}, label, count(*) AS c FROM long GROUP BY {i}, label), it AS (SELECT {i}, sum(c) AS n, sum(c*(c-1)) AS pairs FROM cnt GROUP BY {i}), ki AS (SELECT * FROM it WHERE {cond}),
kc AS (SELECT cnt.* FROM cnt JOIN ki USING ({i})), sh AS (SELECT label, sum(c) AS s FROM kc GROUP BY 1),
o AS (SELECT count(*) AS items, sum(CASE WHEN n>1 THEN pairs/(n-1) ELSE 0 END)/sum(n) AS p FROM ki), e AS (SELECT count(*) AS cats, sum(s*s)/(sum(s)*sum(s)) AS e FROM sh)
SELECT items, round(p,6) AS p_observed, round(e,6) AS p_expected, round(CASE WHEN items<2 OR cats<2 THEN 0 WHEN p>=1 THEN 1 WHEN e>=1 THEN 0 ELSE {k} END,6) AS kappa FROM o, e"""


@query("a26_fleiss_kappa", f"WITH {LONG}, " + _FLEISS.format(i="unit_id, edit_no", cond="n >= 2", k="greatest(0, least(1, (p-e)/(1-e)))"))
def a26_fleiss_kappa(spark, d):
    return A.fleiss(_votes(spark, d), "unit_id", "edit_no")


@query("a27_fleiss_modal", f"WITH {LONG}, " + _FLEISS.format(i="unit_id, edit_no", cond="n = (SELECT n FROM it GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)", k="(p-e)/(1-e)"))
def a27_fleiss_modal(spark, d):
    return A.fleiss(_votes(spark, d), "unit_id", "edit_no", modal=True, clamp=False)


@query("a28_fleiss_pooled", f"WITH {LONG}, " + _FLEISS.format(i="unit_id", cond="n >= 2", k="greatest(0, least(1, (p-e)/(1-e)))"))
def a28_fleiss_pooled(spark, d):
    return A.fleiss(_votes(spark, d), "unit_id")


@query("a29_cohen_kappa", f"WITH r AS (SELECT {_LANG} AS lang, llm_label AS a, human_label AS b FROM generate_report WHERE llm_label IS NOT NULL AND human_label IS NOT NULL), g AS (SELECT lang AS grp, a, b FROM r UNION ALL SELECT NULL, a, b FROM r), t AS (SELECT grp, count(*) AS n, avg(CASE WHEN a=b THEN 1.0 ELSE 0.0 END) AS po FROM g GROUP BY 1), x AS (SELECT grp, a AS l, count(*) AS na FROM g GROUP BY 1, 2), y AS (SELECT grp, b AS l, count(*) AS nb FROM g GROUP BY 1, 2), p AS (SELECT x.grp, sum(na*nb) AS ab FROM x JOIN y ON x.l=y.l AND x.grp IS NOT DISTINCT FROM y.grp GROUP BY 1) SELECT t.grp, n, round(po,6) AS agreement, round((po-coalesce(ab,0)/(n*n))/(1-coalesce(ab,0)/(n*n)),6) AS kappa FROM t LEFT JOIN p ON t.grp IS NOT DISTINCT FROM p.grp")
def a29_cohen_kappa(spark, d):
    return A.cohen(_report(spark, d).where("llm_label is not null and human_label is not null"), "llm_label", "human_label", "lang")


@query("a34_label_shares", f"WITH {PREDS} SELECT pred AS label, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM preds),2) AS percent FROM preds GROUP BY 1")
def a34_label_shares(spark, d):
    by = _preds(spark, d).groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("t"))
    return by.join(F.broadcast(total)).select("label", "n", F.round(100 * F.col("n") / F.col("t"), 2).alias("percent"))


@query("a34_label_by_writing_type", f"WITH {PREDS} SELECT coalesce(writing_type,'Unknown') AS writing_type, " + ", ".join(f"count(*) FILTER (pred='{l}') AS \"{l}\"" for l in ("TP", "FP1", "FP2", "FP3", "TN", "FN", "Error")) + " FROM preds GROUP BY 1")
def a34_label_by_writing_type(spark, d):
    p = _preds(spark, d).withColumn("writing_type", F.coalesce("writing_type", F.lit("Unknown")))
    return p.groupBy("writing_type").pivot("pred", ["TP", "FP1", "FP2", "FP3", "TN", "FN", "Error"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a35_problem_areas", f"WITH {PREDS}, n AS (SELECT greatest(5, floor(0.1*count(*))) AS least FROM preds), f AS (SELECT writing_type, pred, count(*) AS c FROM preds WHERE writing_type IS NOT NULL AND pred LIKE 'FP%' GROUP BY 1, 2), g AS (SELECT writing_type, count(*) AS n, round(100.0*count(*) FILTER (pred LIKE 'FP%')/count(*),4) AS fp_rate FROM preds WHERE writing_type IS NOT NULL GROUP BY 1) SELECT g.writing_type, g.n, g.fp_rate, (SELECT pred FROM f WHERE f.writing_type=g.writing_type ORDER BY c DESC, pred LIMIT 1) AS modal_fp FROM g, n WHERE g.n >= least")
def a35_problem_areas(spark, d):
    p = _preds(spark, d)
    c = p.where("writing_type is not null").groupBy("writing_type", "pred").agg(F.count(F.lit(1)).alias("c"))
    fp = F.col("pred").startswith("FP")
    rank = F.when(fp, F.struct(-F.col("c"), "pred"))
    g = c.groupBy("writing_type").agg(F.sum("c").alias("n"), F.round(100 * F.sum(F.when(fp, F.col("c")).otherwise(0)) / F.sum("c"), 4).alias("fp_rate"), F.min_by("pred", rank).alias("modal_fp"))
    least = p.agg(F.greatest(F.lit(5), F.floor(0.1 * F.count(F.lit(1)))).alias("least"))
    return g.join(F.broadcast(least)).where("n >= least").select("writing_type", "n", "fp_rate", "modal_fp")


@query("a37_mean_edits", r"SELECT source, round(avg(nullif(n,0)),6) AS mean_edits FROM (SELECT source, coalesce(len(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}')),0) AS n FROM gold_annotations) GROUP BY 1")
def a37_mean_edits(spark, d):
    g = table(spark, d, "gold_annotations", "source", "aligned").withColumn("n", X.count_edits(F.col("aligned")))
    return g.groupBy("source").agg(F.round(F.avg(F.nullif("n", F.lit(0))), 6).alias("mean_edits"))


@query("a38_label_tags", r"SELECT source, sum(len(regexp_extract_all(coalesce(alignment_labels_detailed,''), ':::FP1')))::BIGINT AS tags, count(*) FILTER (contains(alignment_labels_detailed, ':::FP1')) AS rows_with FROM gold_annotations GROUP BY 1")
def a38_label_tags(spark, d):
    g = table(spark, d, "gold_annotations", "source", "alignment_labels_detailed")
    n = F.coalesce(F.regexp_count("alignment_labels_detailed", F.lit(":::FP1")), F.lit(0))
    return g.groupBy("source").agg(F.sum(n).alias("tags"), F.count_if(n > 0).alias("rows_with"))


@query("a39_fixed_order", f"WITH {PREDS}, l AS (SELECT unnest(['TP','FP1','FP2','FP3','TN','FN']) AS label, unnest([1,2,3,4,5,6]) AS place) SELECT l.label, l.place, count(preds.row_id) AS n FROM l LEFT JOIN preds ON preds.pred = l.label GROUP BY 1, 2")
def a39_fixed_order(spark, d):
    order = spark.createDataFrame([(l, i) for i, l in enumerate(("TP", "FP1", "FP2", "FP3", "TN", "FN"), 1)], "label string, place int")
    by = _preds(spark, d).groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return order.join(by, "label", "left").select("label", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query("a40_language_vote", f"SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM (SELECT source, lower(trim(lang)) AS lang FROM documents WHERE trim(lang) <> '') GROUP BY 1, 2) WHERE rn = 1")
def a40_language_vote(spark, d):
    docs = table(spark, d, "documents", "source", "lang").where("trim(lang) <> ''")
    c = docs.groupBy("source", F.lower(F.trim("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source").agg(F.min_by(F.struct("lang", "n"), F.struct(-F.col("n"), "lang")).alias("x")).select("source", "x.lang", "x.n")


@query("a42_model_benchmark", f"WITH {PREDS} SELECT p.model, count(*) AS n, round(avg(CASE WHEN gold=pred THEN 1.0 ELSE 0.0 END),6) AS accuracy, round(1000*avg(e.total_cost_usd),6) AS cost_per_1k FROM preds p JOIN ensemble e USING (row_id) GROUP BY 1")
def a42_model_benchmark(spark, d):
    return _preds(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.round(1000 * F.avg("total_cost_usd"), 6).alias("cost_per_1k"))


@query("f8_successful", "SELECT model, count(*) FILTER (tp_fp_label IS NOT NULL AND lower(trim(tp_fp_label)) NOT IN ('error','nan','')) AS ok, count(*) AS n FROM ensemble GROUP BY 1")
def f8_successful(spark, d):
    bad = F.lower(F.trim("tp_fp_label")).isin("error", "nan", "")
    return table(spark, d, "ensemble", "model", "tp_fp_label").groupBy("model").agg(F.count_if(~bad).alias("ok"), F.count(F.lit(1)).alias("n"))


@query("f9_failed", "SELECT row_id FROM ensemble WHERE tp_fp_label IS NULL OR trim(tp_fp_label) IN ('','Error','error','nan','API_FAILED') OR reasoning IS NULL OR trim(reasoning) IN ('','Error')")
def f9_failed(spark, d):
    e = table(spark, d, "ensemble", "row_id", "tp_fp_label", "reasoning")
    no = F.col("tp_fp_label").isNull() | F.trim("tp_fp_label").isin("", "Error", "error", "nan", "API_FAILED") | F.col("reasoning").isNull() | F.trim("reasoning").isin("", "Error")
    return e.where(no).select("row_id")
