"""Queries over crowd votes and judge labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import labels as L
from inkwell.operators import votes as V
from inkwell.operators.lineage import numbered
from inkwell.plans.registry import query
from inkwell.sources.tables import table

_CASE = "CASE trim(raw) WHEN 'good_edit' THEN 'TP' WHEN 'optional_edit' THEN 'FP3' WHEN 'incorrect_grammar_edit' THEN 'FP2' WHEN 'hallucination_or_meaning_change' THEN 'FP1' WHEN 'TP' THEN 'TP' WHEN 'FP1' THEN 'FP1' WHEN 'FP2' THEN 'FP2' WHEN 'FP3' THEN 'FP3' END"
SEV = "CASE label WHEN 'FP1' THEN 4 WHEN 'FP2' THEN 3 WHEN 'FP3' THEN 2 WHEN 'TP' THEN 1 ELSE 0 END"
LONG = f"""long AS (SELECT unit_id, vote_id, edit_no, label FROM (
  SELECT trim(_unit_id) AS unit_id, vote_id, edit_no, {_CASE} AS label FROM (
    SELECT _unit_id, vote_id, unnest([1,2,3,4,5]) AS edit_no, unnest([id1_label1, id1_label2, id1_label3, id1_label4, id1_label5]) AS raw FROM annotations)
  WHERE trim(_unit_id) <> '') WHERE label IS NOT NULL)"""
JUDGES = f"""judges AS (SELECT trim(_unit_id) AS unit_id, vote_id,
  coalesce({_CASE.replace('raw', 'id1_label1')}, CASE WHEN llm_label IN ('TP','FP1','FP2','FP3','TN','FN') THEN llm_label END, 'Error') AS label
  FROM annotations WHERE trim(_unit_id) <> '')"""
MISSING = """missing AS (SELECT unit_id, (t + f > 0 AND t >= f) AS strict, (t >= n - t) AS blank_false FROM (
  SELECT trim(_unit_id) AS unit_id, count(*) FILTER (lower(trim(missed_error)) IN ('missed_error','true')) AS t,
         count(*) FILTER (lower(trim(missed_error)) = 'false') AS f, count(*) AS n
  FROM annotations WHERE trim(_unit_id) <> '' GROUP BY 1))"""
EDIT_MAJ = f"""cnt AS (SELECT unit_id, edit_no, label, count(*) AS c FROM long GROUP BY 1, 2, 3),
emaj AS (SELECT unit_id, edit_no, label, c AS n FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, edit_no ORDER BY c DESC, {SEV} DESC) AS rn FROM cnt) WHERE rn = 1)"""


def _votes(spark, d, edits=5):
    cols = ["_unit_id", "vote_id", *[f"id1_label{k}" for k in range(1, edits + 1)]]
    return V.long_votes(table(spark, d, "annotations", *cols), edits)


def _judges(spark, d):
    return V.judge_votes(table(spark, d, "annotations", "_unit_id", "vote_id", "id1_label1", "llm_label"))


def _missing(spark, d):
    return V.missing_error(table(spark, d, "annotations", "_unit_id", "missed_error"))


@query(
    "a1_unit_groups",
    "SELECT trim(_unit_id) AS unit_id, count(*) AS n_votes, count(DISTINCT _worker_id) AS n_workers, arg_min(llm_label, vote_id) FILTER (llm_label IS NOT NULL) AS first_label FROM annotations WHERE trim(_unit_id) <> '' GROUP BY 1",
)
def a1_unit_groups(spark, d):
    a = table(spark, d, "annotations", "_unit_id", "vote_id", "_worker_id", "llm_label").where("trim(_unit_id) <> ''")
    first = F.min_by("llm_label", F.when(F.col("llm_label").isNotNull(), F.col("vote_id")))
    return a.groupBy(F.trim("_unit_id").alias("unit_id")).agg(F.count(F.lit(1)).alias("n_votes"), F.countDistinct("_worker_id").alias("n_workers"), first.alias("first_label"))


@query("a2_unit_arrival", "SELECT unit_id, first_vote, row_number() OVER (ORDER BY first_vote) - 1 AS idx FROM (SELECT trim(_unit_id) AS unit_id, min(vote_id) AS first_vote FROM annotations WHERE trim(_unit_id) <> '' GROUP BY 1)")
def a2_unit_arrival(spark, d):
    """Units numbered in the order of their first vote, by ranges with offsets."""
    a = table(spark, d, "annotations", "_unit_id", "vote_id").where("trim(_unit_id) <> ''")
    return numbered(a.groupBy(F.trim("_unit_id").alias("unit_id")).agg(F.min("vote_id").alias("first_vote")), "idx", "first_vote")


@query("a3_missing_error", f"WITH {MISSING} SELECT unit_id, strict, blank_false FROM missing")
def a3_missing_error(spark, d):
    return _missing(spark, d)


@query("a4_edit_majority", f"WITH {LONG}, {EDIT_MAJ} SELECT unit_id, edit_no, label, n FROM emaj")
def a4_edit_majority(spark, d):
    return V.majority(_votes(spark, d), "unit_id", "edit_no")


_POOLED = f"pool AS (SELECT unit_id, label FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY c DESC, {SEV} DESC) AS rn FROM (SELECT unit_id, label, count(*) AS c FROM long GROUP BY 1, 2)) WHERE rn = 1)"
_WORST = f"pool AS (SELECT unit_id, label FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY {SEV} DESC) AS rn FROM emaj) WHERE rn = 1)"
_FINAL = "SELECT m.unit_id, CASE WHEN coalesce(p.label, 'TN') = 'TP' AND m.{policy} THEN 'FN' ELSE coalesce(p.label, 'TN') END AS label FROM missing m LEFT JOIN pool p USING (unit_id)"


@query("a5_sentence_pooled", f"WITH {LONG}, {MISSING}, {_POOLED} {_FINAL.format(policy='strict')}")
def a5_sentence_pooled(spark, d):
    return V.sentence_labels(_votes(spark, d), _missing(spark, d).select("unit_id", F.col("strict").alias("missing")), pooled=True)


@query("a6_sentence_worst", f"WITH {LONG}, {MISSING}, {EDIT_MAJ}, {_WORST} {_FINAL.format(policy='blank_false')}")
def a6_sentence_worst(spark, d):
    return V.sentence_labels(_votes(spark, d), _missing(spark, d).select("unit_id", F.col("blank_false").alias("missing")), pooled=False)


@query("a7_row_majority", f"WITH {LONG} SELECT vote_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vote_id ORDER BY c DESC, {SEV} DESC) AS rn FROM (SELECT vote_id, label, count(*) AS c FROM long GROUP BY 1, 2)) WHERE rn = 1")
def a7_row_majority(spark, d):
    return V.majority(_votes(spark, d), "vote_id").select("vote_id", "label")


@query("a8_edit_statistics", f"WITH {LONG}, {EDIT_MAJ}, tot AS (SELECT unit_id, edit_no, sum(c)::BIGINT AS votes, max(c) AS top FROM cnt GROUP BY 1, 2) SELECT e.unit_id, e.edit_no, e.label AS dominant, t.top AS dominant_votes, t.votes, (SELECT count(*) FROM cnt x WHERE x.unit_id = e.unit_id AND x.edit_no = e.edit_no AND x.c = t.top) > 1 AS tie FROM emaj e JOIN tot t USING (unit_id, edit_no)")
def a8_edit_statistics(spark, d):
    return V.edit_statistics(_votes(spark, d))


@query("a9_worst_edit", "SELECT row_id, coalesce(arg_max(l, s), 'Error') AS label FROM (SELECT row_id, l, CASE l WHEN 'FP1' THEN 4 WHEN 'FP2' THEN 3 WHEN 'FP3' THEN 2 WHEN 'TP' THEN 1 ELSE 0 END AS s FROM (SELECT row_id, unnest(CASE WHEN alignment_labels IS NULL OR len(regexp_extract_all(alignment_labels, ':::([A-Z0-9]+)\\}', 1)) = 0 THEN [NULL] ELSE regexp_extract_all(alignment_labels, ':::([A-Z0-9]+)\\}', 1) END) AS l FROM gold_annotations)) GROUP BY row_id")
def a9_worst_edit(spark, d):
    g = table(spark, d, "gold_annotations", "row_id", "alignment_labels")
    found = F.regexp_extract_all("alignment_labels", F.lit(r":::([A-Z0-9]+)\}"), F.lit(1))
    return g.select("row_id", F.coalesce(F.when(F.size(found) > 0, L.worst(found)), F.lit("Error")).alias("label"))


_COUNTS = "c AS (SELECT unit_id, count(*) FILTER (label='TP') AS tp, count(*) FILTER (label='FP1') AS f1, count(*) FILTER (label='FP2') AS f2, count(*) FILTER (label='FP3') AS f3, count(*) FILTER (label='TN') AS tn, count(*) FILTER (label='FN') AS fn FROM judges GROUP BY 1)"
_WEIGHTED = "WITH {j}, {c}, m AS (SELECT *, tp+f1+f2+f3 AS e, tn+fn AS p, {r}(CASE WHEN tp+f1+f2+f3 > 0 THEN (5.0*tp+f3-f2-3*f1)/(tp+f1+f2+f3) END{q}) AS a, {r}(CASE WHEN tn+fn > 0 THEN (1.0*tn-fn)/(tn+fn) END{q}) AS b FROM c) SELECT unit_id, CASE WHEN e+p=0 THEN 'Error' WHEN e>=p THEN CASE WHEN a>={w} THEN 'TP' WHEN a>=1 THEN 'FP3' WHEN a>=-1 THEN 'FP2' ELSE 'FP1' END ELSE CASE WHEN b>=1 THEN 'TN' ELSE 'FN' END END AS label FROM m"


@query("a10_weighted_strong", _WEIGHTED.format(j=JUDGES, c=_COUNTS, r="round", q=", 2", w=3))
def a10_weighted_strong(spark, d):
    return V.weighted_label(_judges(spark, d), strong=True)


@query("a11_weighted_plain", _WEIGHTED.format(j=JUDGES, c=_COUNTS, r="", q="", w=5))
def a11_weighted_plain(spark, d):
    return V.weighted_label(_judges(spark, d), strong=False)


@query("a12_consistent_label", f"WITH {JUDGES} SELECT unit_id, CASE WHEN bool_or(label='Error') THEN 'Error' ELSE arg_min(label, -1000*c + o) END AS label FROM (SELECT unit_id, label, count(*) AS c, CASE label WHEN 'FP1' THEN 1 WHEN 'FP2' THEN 2 WHEN 'FP3' THEN 3 WHEN 'FN' THEN 4 WHEN 'TP' THEN 5 WHEN 'TN' THEN 6 ELSE 7 END AS o FROM judges GROUP BY 1, 2) GROUP BY 1")
def a12_consistent_label(spark, d):
    return V.consistent_label(_judges(spark, d))


@query("a13_first_seen_mode", f"WITH {JUDGES}, k AS (SELECT unit_id, label, count(*) AS c, min(vote_id) AS f FROM judges WHERE label <> 'Error' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY c DESC, f) AS rn, sum(c) OVER (PARTITION BY unit_id) AS n FROM k) SELECT unit_id, label, c AS votes, c > n // 2 AS is_consistent FROM r WHERE rn = 1")
def a13_first_seen_mode(spark, d):
    return V.first_seen_mode(_judges(spark, d))


@query("a14_consensus", f"WITH {JUDGES}, {_COUNTS}, v AS (SELECT *, tp+f1+f2+f3+tn+fn AS n FROM c) SELECT unit_id, CASE WHEN n=0 THEN NULL WHEN 3*tp>=2*n AND 4*f2<=n AND 4*f1<=n THEN 'TP' WHEN 3*f1>=2*n AND 4*tp<=n AND 4*f3<=n THEN 'FP1' WHEN 3*f2>=2*n AND 4*tp<=n THEN 'FP2' WHEN 3*f3>=2*n AND 4*f1<=n THEN 'FP3' WHEN 3*tn>=2*n AND 4*fn<=n THEN 'TN' WHEN 3*fn>=2*n AND 4*tn<=n THEN 'FN' END AS label FROM v")
def a14_consensus(spark, d):
    return V.consensus(_judges(spark, d))


@query("a16_top_two", f"WITH {JUDGES} SELECT unit_id, label, c AS votes, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY c DESC, label) AS rn FROM (SELECT unit_id, label, count(*) AS c FROM judges WHERE label <> 'Error' GROUP BY 1, 2)) WHERE rn <= 2")
def a16_top_two(spark, d):
    return V.top_two(_judges(spark, d)).select("unit_id", "label", "votes", F.col("place").cast("bigint").alias("place"))


@query("a18_most_dominant_two", f"WITH {JUDGES} SELECT unit_id, label, c AS votes, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY s DESC) AS rn FROM (SELECT unit_id, label, count(*) AS c, {SEV} AS s FROM judges GROUP BY 1, 2) WHERE s > 0) WHERE rn <= 2")
def a18_most_dominant_two(spark, d):
    return V.most_dominant_two(_judges(spark, d)).select("unit_id", "label", "votes", F.col("place").cast("bigint").alias("place"))


@query("f10_without_ties", f"WITH {LONG}, {EDIT_MAJ}, t AS (SELECT unit_id, edit_no, count(*) AS k FROM (SELECT cnt.*, max(c) OVER (PARTITION BY unit_id, edit_no) AS m FROM cnt) WHERE c = m GROUP BY 1, 2) SELECT unit_id, count(*) AS edits FROM t GROUP BY 1 HAVING max(k) = 1")
def f10_without_ties(spark, d):
    s = V.edit_statistics(_votes(spark, d))
    return s.groupBy("unit_id").agg(F.count(F.lit(1)).alias("edits"), F.bool_or("tie").alias("t")).where("not t").select("unit_id", "edits")


@query("f11_strict", f"WITH {LONG}, {EDIT_MAJ} SELECT unit_id, min(n) AS least_votes FROM emaj GROUP BY 1 HAVING min(n) >= 3")
def f11_strict(spark, d):
    m = V.majority(_votes(spark, d), "unit_id", "edit_no")
    return m.groupBy("unit_id").agg(F.min("n").alias("least_votes")).where("least_votes >= 3")


@query("f12_cant_judge", "SELECT unit_id, max(c) AS most_cant FROM (SELECT trim(_unit_id) AS unit_id, e, count(*) FILTER (raw = 'cant_judge') AS c FROM (SELECT _unit_id, unnest([1,2,3,4,5]) AS e, unnest([id1_label1,id1_label2,id1_label3,id1_label4,id1_label5]) AS raw FROM annotations) WHERE trim(_unit_id) <> '' GROUP BY 1, 2) GROUP BY 1 HAVING max(c) < 2")
def f12_cant_judge(spark, d):
    cols = [f"id1_label{k}" for k in range(1, 6)]
    a = table(spark, d, "annotations", "_unit_id", *cols).where("trim(_unit_id) <> ''")
    by = a.groupBy(F.trim("_unit_id").alias("unit_id")).agg(*[F.count_if(F.col(c) == "cant_judge").alias(c) for c in cols])
    return by.select("unit_id", F.greatest(*cols).alias("most_cant")).where("most_cant < 2")
