"""Queries over pair filters, joins, distinct rows, expansions and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import labels as L
from inkwell.functions import text as X
from inkwell.operators import pairs as P
from inkwell.plans.q_quality import NORM
from inkwell.plans.q_votes import _CASE
from inkwell.plans.registry import query
from inkwell.sources.tables import table

WORDS = r"len(list_filter(regexp_split_to_array(coalesce({c},''), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{0B}}]+'), lambda w: w <> ''))"
EDITS = r"coalesce(len(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}')),0)"


def _gold(spark, d, *cols):
    return table(spark, d, "gold_annotations", "row_id", *cols)


@query("f1_length_ok", f"SELECT row_id FROM gold_annotations WHERE {WORDS.format(c='src')} BETWEEN 10 AND 50 AND {WORDS.format(c='tgt')} BETWEEN 10 AND 50")
def f1_length_ok(spark, d):
    return _gold(spark, d, "src", "tgt").where(X.length_ok(F.col("src"), F.col("tgt"))).select("row_id")


@query("f2_edit_counts", f"SELECT row_id, {EDITS} AS edits FROM gold_annotations")
def f2_edit_counts(spark, d):
    return _gold(spark, d, "aligned").select("row_id", X.count_edits(F.col("aligned")).alias("edits"))


@query("f4_should_keep")
def f4_should_keep(spark, d):
    """The subsequence length has no plain SQL; tested against a brute-force version."""
    g = _gold(spark, d, "src", "tgt", "aligned")
    return P.kept_pairs(g).select("row_id")


@query("f5_sentence_pairs", r"WITH s AS (SELECT row_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(src, '([.!?])([A-ZА-ЯІЇЄҐ][a-zа-яіїєґ])', '\1 \2', 'g'), '([.!?])([0-9])', '\1 \2', 'g'), '([a-zа-яіїєґ])([A-ZА-ЯІЇЄҐ])', '\1. \2', 'g'), '([.!?])\s+([A-ZА-ЯІЇЄҐ])', '\1' || chr(9246) || '\2', 'g'), chr(9246)), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tgt, '([.!?])([A-ZА-ЯІЇЄҐ][a-zа-яіїєґ])', '\1 \2', 'g'), '([.!?])([0-9])', '\1 \2', 'g'), '([a-zа-яіїєґ])([A-ZА-ЯІЇЄҐ])', '\1. \2', 'g'), '([.!?])\s+([A-ZА-ЯІЇЄҐ])', '\1' || chr(9246) || '\2', 'g'), chr(9246)), lambda x: trim(x)), lambda x: x <> '') AS b FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL) SELECT row_id, len(a) AS sentences FROM s WHERE len(a) = len(b) AND len(a) > 1")
def f5_sentence_pairs(spark, d):
    """Rows whose sides have as many sentences, more than one."""
    g = _gold(spark, d, "src", "tgt").select("row_id", X.split_sentences(F.col("src")).alias("a"), X.split_sentences(F.col("tgt")).alias("b"))
    return g.where("size(a) = size(b) and size(a) > 1").select("row_id", F.size("a").alias("sentences"))


@query("f7_training_pairs", "SELECT row_id FROM gold_annotations WHERE aligned IS NOT NULL AND trim(aligned) <> '' AND src <> tgt AND aligned <> src")
def f7_training_pairs(spark, d):
    return _gold(spark, d, "src", "tgt", "aligned").where("trim(aligned) <> '' and src <> tgt and aligned <> src").select("row_id")


@query("f14_noop_edits", r"WITH e AS (SELECT row_id, unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 1)) AS o, unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 2)) AS n FROM gold_annotations) SELECT row_id, count(*) AS real_edits FROM e WHERE trim(o, ' ') <> trim(n, ' ') GROUP BY 1")
def f14_noop_edits(spark, d):
    real = F.filter(X.edits(F.col("aligned")), lambda e: e["old"] != e["new"])
    return _gold(spark, d, "aligned").select("row_id", F.size(real).cast("bigint").alias("real_edits")).where("real_edits > 0")


@query("f13_head", "SELECT row_id, source FROM gold_annotations ORDER BY row_id LIMIT 100")
def f13_head(spark, d):
    """The sample gate: the first hundred rows, by a top-k that keeps no more in any task."""
    return _gold(spark, d, "source").orderBy("row_id").limit(100)


@query("j1_gold_predictions", f"SELECT g.row_id, e.row_id AS row_id_pred, g.label, {NORM.format(c='e.tp_fp_label')} AS pred FROM gold_annotations g JOIN ensemble e ON trim(g.unit_id) = trim(e.idx)")
def j1_gold_predictions(spark, d):
    g = _gold(spark, d, "unit_id", "label").withColumn("key", F.trim("unit_id"))
    e = table(spark, d, "ensemble", "row_id", "idx", "tp_fp_label").select(F.trim("idx").alias("key"), F.col("row_id").alias("row_id_pred"), L.normalized(F.col("tp_fp_label")).alias("pred"))
    return g.join(e, "key").select("row_id", "row_id_pred", "label", "pred")


@query("j2_recovered_sources", "SELECT r.report_id, count(g.row_id) AS matches FROM generate_report r LEFT JOIN gold_annotations g ON trim(r.unit_id) = trim(g.unit_id) GROUP BY 1")
def j2_recovered_sources(spark, d):
    r = table(spark, d, "generate_report", "report_id", "unit_id").select("report_id", F.trim("unit_id").alias("key"))
    g = _gold(spark, d, "unit_id").groupBy(F.trim("unit_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return r.join(g, "key", "left").groupBy("report_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))


@query("j3_numeric_key", r"SELECT r.report_id, count(g.k) AS matches FROM (SELECT report_id, k - min(k) OVER () AS k FROM (SELECT report_id, TRY_CAST(regexp_extract(unit_id, '(\d+)\D*$', 1) AS BIGINT) AS k FROM generate_report)) r LEFT JOIN (SELECT DISTINCT k - (SELECT min(TRY_CAST(regexp_extract(unit_id, '(\d+)\D*$', 1) AS BIGINT)) FROM gold_annotations) AS k FROM (SELECT TRY_CAST(regexp_extract(unit_id, '(\d+)\D*$', 1) AS BIGINT) AS k FROM gold_annotations)) g USING (k) GROUP BY 1")
def j3_numeric_key(spark, d):
    """Keys rebased to the smallest of their side; the minimum is one aggregated row."""
    num = F.nullif(F.regexp_extract("unit_id", r"(\d+)\D*$", 1), F.lit("")).cast("bigint")

    def rebased(df):
        df = df.withColumn("k", num)
        return df.join(F.broadcast(df.agg(F.min("k").alias("low")))).withColumn("k", F.col("k") - F.col("low")).drop("low")

    r = rebased(table(spark, d, "generate_report", "report_id", "unit_id"))
    g = rebased(_gold(spark, d, "unit_id")).select("k").where("k is not null").distinct().withColumn("hit", F.lit(1))
    return r.join(g, "k", "left").groupBy("report_id").agg(F.count("hit").alias("matches"))


@query("j4_to_judge_again", f"SELECT g.row_id FROM gold_annotations g WHERE trim(g.unit_id) IN (SELECT trim(idx) FROM ensemble WHERE {NORM.format(c='tp_fp_label')} = 'Error' AND idx IS NOT NULL)")
def j4_to_judge_again(spark, d):
    bad = table(spark, d, "ensemble", "idx", "tp_fp_label").where(L.normalized(F.col("tp_fp_label")) == "Error").select(F.trim("idx").alias("key"))
    return _gold(spark, d, "unit_id").withColumn("key", F.trim("unit_id")).join(bad, "key", "left_semi").select("row_id")


@query("j5_upserted_labels", f"WITH u AS (SELECT trim(idx) AS k, arg_max(upper(trim(tp_fp_label)), row_id) AS l FROM ensemble WHERE {NORM.format(c='tp_fp_label')} <> 'Error' GROUP BY 1) SELECT g.row_id, coalesce(u.l, g.label) AS label FROM gold_annotations g LEFT JOIN u ON trim(g.unit_id) = u.k")
def j5_upserted_labels(spark, d):
    good = table(spark, d, "ensemble", "idx", "row_id", "tp_fp_label").withColumn("label", L.normalized(F.col("tp_fp_label"))).where("label <> 'Error'")
    last = good.groupBy(F.trim("idx").alias("key")).agg(F.max_by("label", "row_id").alias("label"))
    base = _gold(spark, d, "unit_id", "label").select("row_id", F.trim("unit_id").alias("key"), "label")
    return P.upsert(base, last, "key", "label").select("row_id", "label")


@query("j6_votes_by_source_text", "SELECT md5(src) AS text_id, count(*) AS n, count(DISTINCT label) AS labels FROM gold_annotations WHERE src IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def j6_votes_by_source_text(spark, d):
    """What rows of one source text say, from one grouping instead of a scan a row."""
    g = _gold(spark, d, "src", "label").where("src is not null").groupBy(F.md5(F.col("src").cast("binary")).alias("text_id"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels")).where("n > 1")


@query("j7_votes_on_edits", r"WITH first AS (SELECT trim(unit_id) AS unit_id, arg_min(aligned, row_id) AS aligned FROM gold_annotations WHERE aligned IS NOT NULL GROUP BY 1), e AS (SELECT unit_id, trim(o,' ') AS o, trim(n,' ') AS n, min(i) AS edit_no FROM (SELECT unit_id, unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 1)) AS o, unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 2)) AS n, unnest(range(len(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}')))) AS i FROM first) GROUP BY 1, 2, 3), v AS (SELECT trim(_unit_id) AS unit_id, vote_id, " + _CASE.replace("raw", "raw") + r" AS label, trim(split_part(a,'=>',1),' ') AS o, trim(substr(a, strpos(a,'=>')+2),' ') AS n FROM (SELECT _unit_id, vote_id, unnest([id1_label1,id1_label2,id1_label3,id1_label4,id1_label5]) AS raw, unnest([annotation_1,annotation_2,annotation_3,annotation_4,annotation_5]) AS a FROM annotations) WHERE contains(a,'=>')) SELECT e.unit_id, e.edit_no, v.label, count(*) AS votes FROM v JOIN e USING (unit_id, o, n) WHERE v.label IS NOT NULL GROUP BY 1, 2, 3")
def j7_votes_on_edits(spark, d):
    units = _gold(spark, d, "unit_id", "aligned").where("aligned is not null").groupBy(F.trim("unit_id").alias("unit_id")).agg(F.min_by("aligned", "row_id").alias("aligned"))
    cols = [f"{c}{k}" for k in range(1, 6) for c in ("id1_label", "annotation_")]
    a = table(spark, d, "annotations", "_unit_id", "vote_id", *cols)
    each = F.array(*[F.struct(F.col(f"annotation_{k}").alias("annotation"), L.crowd_label(F.col(f"id1_label{k}")).alias("label")) for k in range(1, 6)])
    votes = a.select(F.trim("_unit_id").alias("unit_id"), "vote_id", F.inline(each)).where("label is not null")
    hits = P.match_votes_to_edits(units.select("unit_id", X.edits(F.col("aligned")).alias("edits")), votes)
    return hits.groupBy("unit_id", F.col("edit_no").cast("bigint").alias("edit_no"), "label").agg(F.count(F.lit(1)).alias("votes"))


@query("j11_new_words", r"WITH s AS (SELECT row_id, unnest(list_distinct(regexp_extract_all(lower(src), '\p{L}+'))) AS w FROM gold_annotations), t AS (SELECT row_id, unnest(list_distinct(regexp_extract_all(lower(tgt), '\p{L}+'))) AS w FROM gold_annotations) SELECT row_id, count(*) AS new_words FROM t ANTI JOIN s USING (row_id, w) GROUP BY 1")
def j11_new_words(spark, d):
    """Words of the target that the source lacks: a set difference inside the row, no join."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("\\p{L}+"), F.lit(0)))
    none = F.array().cast("array<string>")
    new = F.array_except(F.coalesce(w("tgt"), none), F.coalesce(w("src"), none))
    return _gold(spark, d, "src", "tgt").select("row_id", F.size(new).cast("bigint").alias("new_words")).where("new_words > 0")


@query("j12_batch_answers", f"SELECT g.row_id, coalesce(e.l, 'Error') AS label FROM gold_annotations g LEFT JOIN (SELECT 'row-' || row_id AS custom_id, {NORM.format(c='tp_fp_label')} AS l FROM ensemble) e ON 'row-' || g.row_id = e.custom_id")
def j12_batch_answers(spark, d):
    answers = table(spark, d, "ensemble", "row_id", "tp_fp_label").select(F.concat(F.lit("row-"), "row_id").alias("custom_id"), L.normalized(F.col("tp_fp_label")).alias("l"))
    g = _gold(spark, d).withColumn("custom_id", F.concat(F.lit("row-"), "row_id"))
    return g.join(answers, "custom_id", "left").select("row_id", F.coalesce("l", F.lit("Error")).alias("label"))


@query("d1_first_pairs", "SELECT min(row_id) AS row_id FROM gold_annotations GROUP BY src, tgt")
def d1_first_pairs(spark, d):
    return P.keep_first(_gold(spark, d, "src", "tgt"), "row_id", "src", "tgt").select("row_id")


@query("d4_correct_and_missed", "SELECT row_id, label, md5(t) AS text_id FROM (SELECT row_id, src AS t, CASE WHEN src = tgt THEN 'TN' ELSE 'FN' END AS label FROM gold_annotations UNION ALL SELECT row_id, tgt, 'TN' FROM gold_annotations WHERE src IS DISTINCT FROM tgt)")
def d4_correct_and_missed(spark, d):
    x = P.expand_correct_and_missed(_gold(spark, d, "src", "tgt"), "row_id", "src", "tgt")
    return x.select("row_id", "label", F.md5(F.col("src").cast("binary")).alias("text_id"))


@query("u1_all_texts", "SELECT origin, count(*) AS n, sum(length(t))::BIGINT AS characters FROM (SELECT 'gold' AS origin, src AS t FROM gold_annotations UNION ALL SELECT 'report', src FROM generate_report UNION ALL SELECT 'ensemble', src FROM ensemble) GROUP BY 1")
def u1_all_texts(spark, d):
    part = lambda name, t: table(spark, d, t, "src").select(F.lit(name).alias("origin"), F.col("src").alias("t"))
    u = part("gold", "gold_annotations").unionByName(part("report", "generate_report")).unionByName(part("ensemble", "ensemble"))
    return u.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("characters"))


@query("t1_uniform_sample")
def t1_uniform_sample(spark, d):
    """A hundredth of the rows by the hash of their id: no sort, the same rows every time."""
    return _gold(spark, d, "source").where(F.pmod(F.xxhash64("row_id", F.lit(42)), F.lit(100)) == 0)


@query("t3_first_of_each_label", "SELECT label, row_id FROM (SELECT upper(trim(label)) AS label, row_id, row_number() OVER (PARTITION BY upper(trim(label)) ORDER BY row_id) AS rn FROM gold_annotations WHERE upper(trim(label)) IN ('TP','FP1','FP2','FP3','TN','FN')) WHERE rn <= 3")
def t3_first_of_each_label(spark, d):
    """Three per label; Spark limits each label's rows before the shuffle (group limit)."""
    g = _gold(spark, d, "label").select(F.upper(F.trim("label")).alias("label"), "row_id").where(F.col("label").isin(*L.LABELS))
    return g.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("row_id"))).where("rn <= 3").select("label", "row_id")


@query("c1_early_exit", f"WITH j AS (SELECT trim(idx) AS k, row_id, {NORM.format(c='tp_fp_label')} AS l, row_number() OVER (PARTITION BY trim(idx) ORDER BY row_id) AS i FROM ensemble), p AS (SELECT k, max(l) FILTER (i=1) AS a, max(l) FILTER (i=2) AS b, count(*) AS n FROM j GROUP BY 1) SELECT k AS unit_id, a AS first_label, CASE WHEN a = b AND a <> 'Error' THEN true ELSE false END AS settled, n FROM p")
def c1_early_exit(spark, d):
    """Units whose first two judges agree need no third; the rest go to the next stage."""
    e = table(spark, d, "ensemble", "idx", "row_id", "tp_fp_label").select(F.trim("idx").alias("unit_id"), F.struct("row_id", L.normalized(F.col("tp_fp_label")).alias("l")).alias("x"))
    j = F.array_sort(F.collect_list("x"))
    by = e.groupBy("unit_id").agg(j.alias("j"), F.count(F.lit(1)).alias("n"))
    a, b = F.get("j", F.lit(0))["l"], F.get("j", F.lit(1))["l"]
    return by.select("unit_id", a.alias("first_label"), F.coalesce((a == b) & (a != "Error"), F.lit(False)).alias("settled"), "n")


@query("c11_opinions", "SELECT trim(idx) AS unit_id, string_agg('Judge ' || i || ': ' || l, chr(10) ORDER BY i) AS opinions FROM (SELECT idx, coalesce(trim(tp_fp_label),'Error') AS l, row_number() OVER (PARTITION BY trim(idx) ORDER BY row_id) AS i FROM ensemble) GROUP BY 1")
def c11_opinions(spark, d):
    e = table(spark, d, "ensemble", "idx", "row_id", "tp_fp_label")
    by = e.groupBy(F.trim("idx").alias("unit_id")).agg(F.array_sort(F.collect_list(F.struct("row_id", F.coalesce(F.trim("tp_fp_label"), F.lit("Error")).alias("l")))).alias("j"))
    return by.select("unit_id", F.array_join(F.transform("j", lambda x, i: F.concat(F.lit("Judge "), (i + 1).cast("string"), F.lit(": "), x["l"])), "\n").alias("opinions"))


@query("c12_post_pass", f"WITH s AS (SELECT trim(unit_id) AS k, arg_max(upper(trim(human_label)), report_id) AS h FROM generate_report WHERE human_label IS NOT NULL GROUP BY 1) SELECT e.row_id, CASE WHEN {NORM.format(c='e.tp_fp_label')} = 'Error' THEN coalesce(s.h, 'Error') ELSE {NORM.format(c='e.tp_fp_label')} END AS label FROM ensemble e LEFT JOIN s ON trim(e.idx) = s.k")
def c12_post_pass(spark, d):
    """Failed rows are judged once more (here by the report's human label) and merged back."""
    second = table(spark, d, "generate_report", "unit_id", "report_id", "human_label").where("human_label is not null").groupBy(F.trim("unit_id").alias("key")).agg(F.max_by(F.upper(F.trim("human_label")), "report_id").alias("again"))
    e = table(spark, d, "ensemble", "row_id", "idx", "tp_fp_label").select("row_id", F.trim("idx").alias("key"), L.normalized(F.col("tp_fp_label")).alias("label"))
    failed = e.where("label = 'Error'").join(second, "key", "left").select("row_id", F.coalesce("again", F.lit("Error")).alias("label"))
    return e.where("label <> 'Error'").select("row_id", "label").unionByName(failed)
