"""Queries over judge cascades: the labels that the crowd gave a unit, in the order they came, are its judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import labels as L
from inkwell.operators import cascade as C
from inkwell.operators import votes as V
from inkwell.plans.q_votes import JUDGES
from inkwell.plans.registry import query
from inkwell.sources.tables import table

#: Labels of a unit that a cascade may ask for.
MOST = 9


def J(n):
    return f"coalesce(given[{n + 1}], 'Error')"


_UNITS = f"""{JUDGES}, o AS (SELECT unit_id, label, row_number() OVER (PARTITION BY unit_id ORDER BY vote_id) AS n FROM judges),
h AS (SELECT unit_id, list(label ORDER BY n) FILTER (n <= {MOST}) AS given FROM o GROUP BY 1),
p AS (SELECT unit_id, src, tgt FROM (SELECT trim(unit_id) AS unit_id, src, tgt, row_number() OVER (PARTITION BY trim(unit_id) ORDER BY row_id) AS n FROM gold_annotations) WHERE n = 1)"""


def _base(names):
    return f"{_UNITS}, v AS (SELECT h.unit_id, src, tgt, given, {', '.join(f'{J(n)} AS j{n}' for n in names)} FROM h JOIN p USING (unit_id))"


def _mode(cols):
    v = "list_filter([" + ", ".join(cols) + "], lambda l: l <> 'Error')"
    best = " ".join(f"WHEN len(list_filter({v}, lambda l: l = {c})) >= {k} AND {c} <> 'Error' THEN {c}" for k in range(len(cols), 0, -1) for c in cols)
    return f"CASE {best} ELSE 'Error' END"


def _units(spark, d):
    """Units with their pair and the labels given to them."""
    votes = V.judge_votes(table(spark, d, "annotations", "_unit_id", "vote_id", "id1_label1", "llm_label"))
    pairs = table(spark, d, "gold_annotations", "unit_id", "row_id", "src", "tgt").groupBy(F.trim("unit_id").alias("unit_id")).agg(F.min_by(F.struct("src", "tgt"), "row_id").alias("p"))
    return C.given_labels(votes, "unit_id", "vote_id", MOST).join(pairs.select("unit_id", "p.*"), "unit_id")


@query("c4_early_exit_ensemble", f"WITH {_base(range(3))} SELECT unit_id, CASE WHEN j0 = j1 AND j0 <> 'Error' THEN j0 ELSE {_mode(['j0', 'j1', 'j2'])} END AS final, CASE WHEN j0 = j1 AND j0 <> 'Error' THEN 2 ELSE 3 END AS calls FROM v")
def c4_early_exit_ensemble(spark, d):
    return C.early_exit_ensemble(_units(spark, d), C.given_judge).select("unit_id", "final", "calls")


_N3 = ", ".join(f"len(list_filter([j0,j1,j2], lambda l: l = '{l}')) AS {l.lower()}" for l in ("TP", "FP1", "FP2", "FP3", "TN", "FN"))


@query("c3_weighted_ensemble", f"WITH {_base(range(3))}, n AS (SELECT unit_id, j0, j1, {_N3} FROM v), m AS (SELECT *, tp+fp1+fp2+fp3 AS e, tn+fn AS p FROM n), w AS (SELECT *, (5.0*tp+fp3-fp2-3*fp1)/nullif(e,0) AS a, (1.0*tn-fn)/nullif(p,0) AS b FROM m) SELECT unit_id, CASE WHEN j0 = j1 AND j0 <> 'Error' THEN j0 WHEN e+p=0 THEN 'Error' WHEN e>=p THEN CASE WHEN a>=5 THEN 'TP' WHEN a>=1 THEN 'FP3' WHEN a>=-1 THEN 'FP2' ELSE 'FP1' END WHEN b>=1 THEN 'TN' ELSE 'FN' END AS final FROM w")
def c3_weighted_ensemble(spark, d):
    return C.early_exit_ensemble(_units(spark, d), C.given_judge, aggregate=C.weighted).select("unit_id", "final")


@query("c2_filter_candidates", f"WITH {_base(range(2))} SELECT unit_id, CASE WHEN tgt IS NOT NULL THEN j0 ELSE '' END AS first_label, CASE WHEN (tgt IS NULL OR j0 NOT IN ('TP','TN')) AND src IS NOT NULL THEN j1 ELSE '' END AS second_label FROM v")
def c2_filter_candidates(spark, d):
    x = C.filter_candidates(_units(spark, d).withColumn("second", F.col("src")), C.given_judge, ["tgt", "second"])
    return x.select("unit_id", F.col("tgt_label").alias("first_label"), F.col("second_label"))


def _consensus(labels):
    """SQL of the consensus over a list of labels."""
    n = f"len(list_filter({labels}, lambda l: l <> 'Error'))"
    count = lambda l: f"len(list_filter({labels}, lambda x: x = '{l}'))"
    cases = " ".join(f"WHEN {n} > 0 AND 3 * {count(l)} >= 2 * {n}" + "".join(f" AND 4 * {count(x)} <= {n}" for x in L.NON_ADJACENT[l]) + f" THEN '{l}'" for l in L.LABELS)
    return f"CASE {cases} END"


_ROUNDS = {k: f"[{', '.join(f'j{i}' for i in range(k))}]" for k in range(3, 7)}
_TIERS = [f"[{', '.join(f'j{3 * t + i}' for i in range(3))}]" for t in range(3)]


@query(
    "c5_iterative_critic",
    f"WITH {_base(range(6))}, r AS (SELECT unit_id, {', '.join(f'{_consensus(v)} AS c{k}' for k, v in _ROUNDS.items())}, {_mode([f'j{i}' for i in range(6)])} AS m FROM v) SELECT unit_id, coalesce(c3, c4, c5, c6, m) AS final, CASE WHEN c3 IS NOT NULL THEN 3 WHEN c4 IS NOT NULL THEN 4 WHEN c5 IS NOT NULL THEN 5 WHEN c6 IS NOT NULL THEN 6 ELSE 7 END AS calls FROM r",
)
def c5_iterative_critic(spark, d):
    """Rounds until consensus."""
    return C.iterative_critic(_units(spark, d), C.given_judge).select("unit_id", "final", "calls")


_ORD = "CASE {c} WHEN 'FP1' THEN 1 WHEN 'FP2' THEN 2 WHEN 'FP3' THEN 3 WHEN 'FN' THEN 4 WHEN 'TP' THEN 5 WHEN 'TN' THEN 6 ELSE 7 END"


@query("c6_inner_debate", f"WITH {_base(range(3))} SELECT unit_id, CASE WHEN j0=j1 AND j1=j2 THEN j0 ELSE coalesce(['FP1','FP2','FP3','FN','TP','TN'][least({', '.join(_ORD.format(c=c) for c in ('j0', 'j1', 'j2'))})], 'Error') END AS final FROM v")
def c6_inner_debate(spark, d):
    return C.inner_debate(_units(spark, d), C.given_judge).select("unit_id", "final")


@query("c7_escalation", f"WITH {_base(range(3))} SELECT unit_id, CASE WHEN j0 NOT IN ('FP1','FP2','Error') THEN j0 WHEN j0 = j1 THEN j1 ELSE j2 END AS final, CASE WHEN j0 NOT IN ('FP1','FP2','Error') THEN 1 WHEN j0 = j1 THEN 2 ELSE 3 END AS calls FROM v")
def c7_escalation(spark, d):
    return C.escalation(_units(spark, d), C.given_judge, lambda l: l.isin("FP1", "FP2", "Error")).select("unit_id", "final", "calls")


@query(
    "c8_tiered_votes",
    f"WITH {_base(range(9))}, t AS (SELECT unit_id, {_consensus(_TIERS[0])} AS c0, {_consensus(_TIERS[1])} AS c1, {_mode(['j6', 'j7', 'j8'])} AS c2 FROM v) SELECT unit_id, coalesce(c0, c1, c2) AS final, CASE WHEN c0 IS NOT NULL THEN 3 WHEN c1 IS NOT NULL THEN 6 ELSE 9 END AS calls FROM t",
)
def c8_tiered_votes(spark, d):
    """Votes of three tiers."""
    return C.tiered_votes(_units(spark, d), C.given_judge).select("unit_id", "final", "calls")


@query("c9_mixture_of_experts", f"WITH {_base(range(3))} SELECT unit_id, CASE WHEN src = tgt THEN j0 WHEN length(tgt) > length(src) THEN j1 ELSE j2 END AS final FROM v")
def c9_mixture_of_experts(spark, d):
    route = F.when(F.col("src") == F.col("tgt"), F.lit("same")).when(F.length("tgt") > F.length("src"), F.lit("longer")).otherwise(F.lit("other"))
    return C.mixture_of_experts(_units(spark, d), C.given_judge, route, {"same": 0, "longer": 1, "other": 2}).select("unit_id", "final")


@query("c10_debate_router", f"WITH {_base(range(4))} SELECT unit_id, CASE WHEN j0='TP' THEN j0 WHEN j0=j1 AND j0<>'Error' THEN j0 WHEN j2 IN (j0, j1) AND j2<>'Error' THEN j2 ELSE j3 END AS final, CASE WHEN j0='TP' THEN 1 WHEN j0=j1 AND j0<>'Error' THEN 2 WHEN j2 IN (j0, j1) AND j2<>'Error' THEN 3 ELSE 4 END AS calls FROM v")
def c10_debate_router(spark, d):
    return C.debate_router(_units(spark, d), C.given_judge).select("unit_id", "final", "calls")
