"""Queries over parsers of judges' answers, on answers as given and on answers made of the tables' own labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import answers as A
from inkwell.operators.cost import number_or_zero
from inkwell.plans.registry import query
from inkwell.sources.tables import table

_UP = "upper(reasoning)"
_KIND = "CASE WHEN contains(c, 'TP') THEN 'TP' WHEN contains(c, 'TN') THEN 'TN' WHEN contains(c, 'FN') THEN 'FN' WHEN contains(c, 'FP') THEN 'FP' END"
_GRADE = "CASE WHEN contains(s, 'FP1') OR contains(s, 'CRITICAL') THEN 'FP1' WHEN contains(s, 'FP2') OR contains(s, 'MEDIUM') THEN 'FP2' WHEN contains(s, 'FP3') OR contains(s, 'MINOR') THEN 'FP3' ELSE 'FP' END"
#: An answer in the form of classifications, of the label and the writing type of each row.
_LISTED = """'{"classifications": ["' || CASE WHEN tp_fp_label LIKE 'FP%' THEN 'FP' ELSE coalesce(tp_fp_label, '') END || '"], "fp_severity": "' || CASE WHEN tp_fp_label = 'FP1' THEN 'critical' WHEN tp_fp_label = 'FP2' THEN 'Medium' ELSE 'minor' END || '"}'"""


def _listed():
    label = F.coalesce("tp_fp_label", F.lit(""))
    kind = F.when(label.startswith("FP"), F.lit("FP")).otherwise(label)
    words = F.when(label == "FP1", F.lit("critical")).when(label == "FP2", F.lit("Medium")).otherwise(F.lit("minor"))
    return F.concat(F.lit('{"classifications": ["'), kind, F.lit('"], "fp_severity": "'), words, F.lit('"}'))


@query("pl5_severity_words", rf"""WITH t AS (SELECT row_id, {_LISTED} AS a FROM ensemble), p AS (SELECT row_id, upper(nullif(regexp_extract(a, '(?i)"classifications"\s*:\s*\[([^\]]*)\]', 1), '')) AS c, upper(regexp_extract(a, '(?i)"fp_severity"\s*:\s*"([^"]*)"', 1)) AS s FROM t), k AS (SELECT row_id, {_KIND} AS k, s FROM p) SELECT row_id, CASE WHEN k = 'FP' THEN {_GRADE} ELSE coalesce(k, 'Error') END AS label FROM k""")
def pl5_severity_words(spark, d):
    """Labels of answers that list classes and grade false positives in words."""
    e = table(spark, d, "ensemble", "row_id", "tp_fp_label")
    return e.select("row_id", A.severity_label(_listed()).alias("label"))


@query("pl11_feedback_labels", rf"""WITH g AS (SELECT row_id, reasoning AS r, trim(split_part(regexp_extract(reasoning, '(?i)"classification"\s*:\s*"([^"]+)"', 1), '/', 1)) AS g, {_UP} AS u FROM ensemble) SELECT row_id, CASE WHEN r IS NULL OR r = '' THEN 'Error' WHEN g IN ('TP','FP1','FP2','FP3') THEN g WHEN contains(u, 'FP1') THEN 'FP1' WHEN contains(u, 'FP2') THEN 'FP2' WHEN contains(u, 'FP3') THEN 'FP3' WHEN contains(u, 'TP') THEN 'TP' ELSE 'Error' END AS label FROM g""")
def pl11_feedback_labels(spark, d):
    return table(spark, d, "ensemble", "row_id", "reasoning").select("row_id", A.feedback_label(F.col("reasoning")).alias("label"))


_FIVE = "[id1_label1, id1_label2, id1_label3, id1_label4, llm_label]"


@query("pl10_votes", f"SELECT vote_id, array_to_string(list_filter(list_transform({_FIVE}, lambda v: upper(trim(v))), lambda v: v IN ('TP','FP1','FP2','FP3','TN','FN')), ',') AS votes FROM annotations")
def pl10_votes(spark, d):
    """Votes answers, written as JSON from a row's labels and read back."""
    cols = ["id1_label1", "id1_label2", "id1_label3", "id1_label4", "llm_label"]
    answer = F.to_json(F.struct(F.array(*cols).alias("votes")))
    return table(spark, d, "annotations", "vote_id", *cols).select("vote_id", F.array_join(A.votes(answer), ",").alias("votes"))


@query("pl9_batch_answers", "SELECT row_id, upper(coalesce(tp_fp_label, 'Error')) AS first_label, md5(left(coalesce(reasoning, ''), 200)) AS first_reasoning, 'Error' AS second_label, 'Batch parsing failed' AS second_reasoning FROM ensemble")
def pl9_batch_answers(spark, d):
    """A batch of two of which one answer came, inside other text: the second is an error."""
    e = table(spark, d, "ensemble", "row_id", "tp_fp_label", "reasoning")
    answer = F.concat(F.lit("Here you are: "), F.to_json(F.array(F.struct(F.col("tp_fp_label").alias("label"), F.col("reasoning")))), F.lit(" done"))
    b = A.batch_answers(answer, F.lit(2))
    return e.select("row_id", b[0]["label"].alias("first_label"), F.md5(b[0]["reasoning"].cast("binary")).alias("first_reasoning"), b[1]["label"].alias("second_label"), b[1]["reasoning"].alias("second_reasoning"))


_PARTS = r"regexp_extract_all(alignment_labels, '\{([^{}]*?=>[^{}]*?):::(?:TP|FP[123])\}', 1)"
_CLASSES = r"regexp_extract_all(alignment_labels, '\{[^{}]*?=>[^{}]*?:::(TP|FP[123])\}', 1)"


@query("pl8_salvaged_edits", rf"SELECT row_id, md5(array_to_string(list_distinct_in_order, chr(10))) AS edits FROM (SELECT row_id, list_filter(z, lambda x, i: list_position(z, x) = i) AS list_distinct_in_order FROM (SELECT row_id, list_transform(list_zip({_PARTS}, {_CLASSES}), lambda p: '{{' || p[1] || '}}' || p[2]) AS z FROM gold_annotations WHERE alignment_labels IS NOT NULL AND NOT contains(alignment_labels, chr(34))))")
def pl8_salvaged_edits(spark, d):
    """Edits of labelled alignments, written as JSON that lost its end, and salvaged (alignments with quotation marks aside: they end the key)."""
    g = table(spark, d, "gold_annotations", "row_id", "alignment_labels").where("alignment_labels is not null").where(~F.contains("alignment_labels", F.lit('"')))
    part = lambda k: F.regexp_extract_all("alignment_labels", F.lit(r"\{([^{}]*?=>[^{}]*?):::(TP|FP[123])\}"), F.lit(k))
    lines = F.zip_with(part(1), part(2), lambda e, c: F.concat(F.lit('  "{'), e, F.lit('}": "'), c, F.lit('",')))
    broken = F.concat(F.lit('{"writing_type": "x", "edits": {\n'), F.array_join(lines, "\n"))
    edits = F.transform(A.salvaged(broken)["edits"], lambda x: F.concat(x["edit"], x["label"]))
    return g.select("row_id", F.md5(F.array_join(edits, "\n").cast("binary")).alias("edits"))


_SUMS = ", ".join(f"sum(coalesce({c}, 0))::BIGINT AS {c}" for c in ("input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens"))


@query("a33_rolled_up_outputs", f"SELECT trim(idx) AS unit_id, count(*) AS outputs, {_SUMS}, round(sum(coalesce(total_cost_usd, 0)), 6) AS total_cost_usd, coalesce(arg_min(model, row_id) FILTER (model <> ''), 'ensemble') AS model FROM ensemble GROUP BY 1 HAVING sum(coalesce(total_cost_usd, 0)) > 0 OR sum(coalesce(input_tokens, 0)) > 0")
def a33_rolled_up_outputs(spark, d):
    """Tokens and cost of a unit's judge outputs in one row, with the first model; units without either are left out."""
    tokens = ["input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens"]
    e = table(spark, d, "ensemble", "idx", "row_id", "model", "total_cost_usd", *tokens)
    model = F.coalesce(F.min_by("model", F.when(F.col("model") != "", F.col("row_id"))), F.lit("ensemble"))
    cost = F.sum(number_or_zero("total_cost_usd"))
    by = e.groupBy(F.trim("idx").alias("unit_id")).agg(F.count(F.lit(1)).alias("outputs"), *[F.sum(number_or_zero(c)).alias(c) for c in tokens], cost.alias("total_cost_usd"), model.alias("model"))
    return by.where("total_cost_usd > 0 or input_tokens > 0").withColumn("total_cost_usd", F.round(F.col("total_cost_usd") * 1e6) / 1e6)  # the float is scaled, then rounded: 0.0039215 is a little less than its digits
