"""Further queries: set operations, samples, buffers, filters' labels, rule retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import labels as L
from inkwell.functions import text as X
from inkwell.plans.q_quality import NORM
from inkwell.plans.q_votes import JUDGES, _judges
from inkwell.plans.registry import query
from inkwell.sources.tables import table


@query("a15_integer_consensus", f"WITH {JUDGES}, k AS (SELECT unit_id, label, count(*) AS c, min(vote_id) AS f FROM judges WHERE label <> 'Error' GROUP BY 1, 2), n AS (SELECT unit_id, sum(c) AS n FROM k GROUP BY 1), m AS (SELECT unit_id, label, c FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY c DESC, f) AS rn FROM k) WHERE rn = 1), far AS (SELECT m.unit_id, max(k.c) AS worst FROM m JOIN k ON m.unit_id = k.unit_id AND ((m.label='TP' AND k.label IN ('FP2','FP1')) OR (m.label='FP3' AND k.label='FP1') OR (m.label='FP2' AND k.label='TP') OR (m.label='FP1' AND k.label IN ('TP','FP3')) OR (m.label='TN' AND k.label='FN') OR (m.label='FN' AND k.label='TN')) GROUP BY 1) SELECT m.unit_id, CASE WHEN 3*c >= 2*n AND coalesce(worst,0) <= n // 4 THEN label END AS label FROM m JOIN n USING (unit_id) LEFT JOIN far USING (unit_id)")
def a15_integer_consensus(spark, d):
    """The mode (first seen on a tie) with ceil(2n/3) votes, far labels at most floor(n/4)."""
    counts = _judges(spark, d).where("label <> 'Error'").groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("c"), F.min("vote_id").alias("f"))
    by = counts.groupBy("unit_id").agg(F.max_by(F.struct("label", "c"), F.struct("c", -F.col("f"))).alias("m"), F.sum("c").alias("n"), F.collect_list(F.struct("label", "c")).alias("all"))
    far = F.create_map(*[x for l, o in L.NON_ADJACENT.items() for x in (F.lit(l), F.array(*map(F.lit, o)))])
    off = F.filter("all", lambda x: F.array_contains(F.element_at(far, F.col("m.label")), x["label"]))
    ok = (3 * F.col("m.c") >= 2 * F.col("n")) & (F.coalesce(F.array_max(F.transform(off, lambda x: x["c"])), F.lit(0)) <= F.floor(F.col("n") / 4))
    return by.select("unit_id", F.when(ok, F.col("m.label")).alias("label"))


@query("a17_top_two_by_buffer", f"WITH {JUDGES} SELECT unit_id, label, c AS votes FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY c DESC, CASE label WHEN 'TP' THEN 1 WHEN 'FP3' THEN 2 WHEN 'FP2' THEN 3 WHEN 'FP1' THEN 4 WHEN 'TN' THEN 5 ELSE 6 END) AS rn FROM (SELECT unit_id, label, count(*) AS c FROM judges WHERE label <> 'Error' GROUP BY 1, 2)) WHERE rn <= 2")
def a17_top_two_by_buffer(spark, d):
    """Two labels a unit: count down, then the gradation of labels."""
    order = {"TP": 1, "FP3": 2, "FP2": 3, "FP1": 4, "TN": 5}
    c = _judges(spark, d).where("label <> 'Error'").groupBy("unit_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("unit_id").orderBy(F.desc("votes"), L.lookup(F.col("label"), order, 6))
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("unit_id", "label", "votes")


@query("a36_filter_statistics", "SELECT candidate, label, count(*) AS n FROM (SELECT 'id1' AS candidate, trim(id1_label1) AS label FROM annotations UNION ALL SELECT 'id2', trim(id1_label2) FROM annotations UNION ALL SELECT 'id3', trim(id1_label3) FROM annotations) WHERE label <> '' GROUP BY 1, 2")
def a36_filter_statistics(spark, d):
    """Attempted labels of each candidate column."""
    a = table(spark, d, "annotations", "id1_label1", "id1_label2", "id1_label3")
    x = a.select(F.expr("stack(3, 'id1', trim(id1_label1), 'id2', trim(id1_label2), 'id3', trim(id1_label3)) as (candidate, label)"))
    return x.where("label <> ''").groupBy("candidate", "label").agg(F.count(F.lit(1)).alias("n"))


@query("a43_items_by_language", "SELECT lower(lang) AS lang, split_name, count(*) AS items, (SELECT count(*) FROM documents) AS documents FROM benchmark_items GROUP BY 1, 2")
def a43_items_by_language(spark, d):
    n = table(spark, d, "documents", "doc_id").agg(F.count(F.lit(1)).alias("documents"))
    by = table(spark, d, "benchmark_items", "lang", "split_name").groupBy(F.lower("lang").alias("lang"), "split_name").agg(F.count(F.lit(1)).alias("items"))
    return by.join(F.broadcast(n))


@query("d2_first_by_title", "SELECT md5(title) AS title_id, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, lower(trim(split_part(text, chr(10), 1), ' ')) AS title FROM documents WHERE text IS NOT NULL) WHERE length(title) >= 20 GROUP BY 1")
def d2_first_by_title(spark, d):
    """Documents by their first line, first occurrence kept."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("title")).where("length(title) >= 20")
    return docs.groupBy(F.md5(F.col("title").cast("binary")).alias("title_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("d3_token_sets", r"WITH t AS (SELECT row_id, list_distinct(regexp_extract_all(lower(src), '\p{L}+')) AS a, list_distinct(regexp_extract_all(lower(tgt), '\p{L}+')) AS b FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL) SELECT row_id, len(list_intersect(a,b)) AS common, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_src, len(list_distinct(list_concat(a,b))) AS either FROM t")
def d3_token_sets(spark, d):
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("\\p{L}+"), F.lit(0)))
    g = table(spark, d, "gold_annotations", "row_id", "src", "tgt").where("src is not null and tgt is not null").select("row_id", w("src").alias("a"), w("tgt").alias("b"))
    return g.select("row_id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_except("a", "b")).alias("only_src"), F.size(F.array_union("a", "b")).alias("either"))


@query("t2_hash_order", "SELECT label, row_id, place FROM (SELECT upper(trim(label)) AS label, row_id, row_number() OVER (PARTITION BY upper(trim(label)) ORDER BY md5(row_id || '|42'), row_id) AS place FROM gold_annotations WHERE upper(trim(label)) IN ('TP','FP1','FP2','FP3','TN','FN')) WHERE place <= 5")
def t2_hash_order(spark, d):
    """Five rows of each label in the order of a seeded digest: the same draw on every run and engine."""
    g = table(spark, d, "gold_annotations", "row_id", "label").select(F.upper(F.trim("label")).alias("label"), "row_id").where(F.col("label").isin(*L.LABELS))
    key = F.md5(F.concat(F.col("row_id").cast("string"), F.lit("|42")).cast("binary"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(key, "row_id")).cast("bigint")).where("place <= 5")


@query("t5_models_by_cost", "SELECT model, round(sum(total_cost_usd),4) AS cost FROM ensemble WHERE total_cost_usd IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def t5_models_by_cost(spark, d):
    """The three dearest models, sorted as numbers."""
    e = table(spark, d, "ensemble", "model", "total_cost_usd").where("total_cost_usd is not null")
    return e.groupBy("model").agg(F.round(F.sum("total_cost_usd"), 4).alias("cost")).orderBy(F.desc("cost")).limit(3)


@query("c13_strategy", "SELECT model, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'direct' ELSE 'batch' END AS strategy FROM ensemble GROUP BY 1")
def c13_strategy(spark, d):
    by = table(spark, d, "ensemble", "model").groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("strategy", F.when(F.col("n") < 1000, F.lit("direct")).otherwise(F.lit("batch")))


@query("s16_span_alignments", r"SELECT row_id, count(*) AS spans FROM (SELECT row_id, unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}')) FROM gold_annotations) GROUP BY 1")
def s16_span_alignments(spark, d):
    """Alignments whose replacements, taken as spans of the source side, give the target side back; counted by row."""
    from inkwell.functions.alignment import apply_spans

    g = table(spark, d, "gold_annotations", "row_id", "aligned").where(F.regexp_count("aligned", F.lit(X.EDIT)) > 0)
    parts = F.split("aligned", r"(?=\{[^{}]*=>[^{}]*\})|(?<=\})")
    piece = F.transform(parts, lambda p: F.when(p.rlike(r"^\{[^{}]*=>[^{}]*\}$"), F.struct(F.regexp_extract(p, X.EDIT, 1).alias("old"), F.regexp_extract(p, X.EDIT, 2).alias("new"), F.lit(True).alias("edit"))).otherwise(F.struct(p.alias("old"), p.alias("new"), F.lit(False).alias("edit"))))
    x = g.withColumn("p", piece)
    start = lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0), lambda acc, q: acc + F.length(q["old"]))
    spans = F.filter(F.transform("p", lambda q, i: F.when(q["edit"], F.struct(start(i).alias("begin"), (start(i) + F.length(q["old"])).alias("end"), q["new"].alias("repl")))), lambda s: s.isNotNull())
    x = x.withColumn("s", spans)
    src = F.array_join(F.transform("p", lambda q: q["old"]), "")
    tgt = F.array_join(F.transform("p", lambda q: q["new"]), "")
    same = apply_spans(src, F.col("s")) == tgt
    return x.select("row_id", F.when(same, F.size("s")).otherwise(-1).cast("bigint").alias("spans"))


@query("r4_keyword_index", "WITH k AS (SELECT subject, trim(unnest(string_split(lower(description), ',')),' ') AS kw FROM subject_areas), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS kw FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, subject, count(*) AS hits FROM w JOIN k USING (kw) GROUP BY 1, 2) SELECT doc_id, subject, hits, least(1.0::DOUBLE, hits/5) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, subject) AS rn FROM s) WHERE rn <= 3")
def r4_keyword_index(spark, d):
    """Inverted keyword index of the rules: equi-join on the word, top three a document."""
    k = table(spark, d, "subject_areas").select("subject", F.explode(F.split(F.lower("description"), ",")).alias("kw")).select("subject", F.trim("kw").alias("kw"))
    w = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0)))).alias("kw"))
    s = w.join(k, "kw").groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("hits"))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "subject"))).where("rn <= 3")
    return top.select("doc_id", "subject", "hits", F.least(F.lit(1.0), F.col("hits") / 5).alias("confidence"))


@query("r6_rule_matches", r"WITH e AS (SELECT source, trim(unnest(regexp_extract_all(aligned,'\{([^{}]*?)=>([^{}]*?)\}',1)),' ') AS o, trim(unnest(regexp_extract_all(aligned,'\{([^{}]*?)=>([^{}]*?)\}',2)),' ') AS n FROM gold_annotations), r AS (SELECT o, n, count(*) AS c FROM e WHERE o <> '' AND n <> '' AND o <> n GROUP BY 1, 2 HAVING count(*) >= 3), x AS (SELECT row_id, trim(unnest(regexp_extract_all(aligned_sentence,'\{([^{}]*?)=>([^{}]*?)\}',1)),' ') AS o, trim(unnest(regexp_extract_all(aligned_sentence,'\{([^{}]*?)=>([^{}]*?)\}',2)),' ') AS n FROM (SELECT report_id AS row_id, aligned_sentence FROM generate_report)) SELECT 'exact' AS kind, count(*) AS hits FROM x JOIN r USING (o, n) UNION ALL SELECT 'reversed', count(*) FROM x JOIN r ON x.o = r.n AND x.n = r.o")
def r6_rule_matches(spark, d):
    """Frequent gold edits as rules: report edits that follow one, or undo one."""
    e = table(spark, d, "gold_annotations", "aligned").select(F.inline(X.edits(F.col("aligned")))).where("old <> '' and new <> '' and old <> new")
    r = e.groupBy("old", "new").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").select("old", "new")
    x = table(spark, d, "generate_report", "aligned_sentence").select(F.inline(X.edits(F.col("aligned_sentence"))))
    count = lambda kind, y: x.join(y, ["old", "new"]).agg(F.count(F.lit(1)).alias("hits")).select(F.lit(kind).alias("kind"), "hits")
    return count("exact", r).unionByName(count("reversed", r.select(F.col("new").alias("old"), F.col("old").alias("new"))))


@query("r9_hint_labels", "SELECT hint, count(*) AS n FROM (SELECT CASE WHEN contains(lower(reasoning),'meaning') AND contains(lower(reasoning),'shifts') THEN 'FP1' WHEN contains(lower(reasoning),'spelling slip') THEN 'TP' WHEN contains(lower(reasoning),'matter of taste') THEN 'FP3' WHEN contains(lower(reasoning),'new mistake') THEN 'FP2' ELSE 'TP?' END AS hint FROM ensemble WHERE reasoning IS NOT NULL) GROUP BY 1")
def r9_hint_labels(spark, d):
    """Keyword hints of an answer as a label, a weak one without a hint."""
    r = F.lower("reasoning")
    hint = F.when(F.contains(r, F.lit("meaning")) & F.contains(r, F.lit("shifts")), F.lit("FP1")).when(F.contains(r, F.lit("spelling slip")), F.lit("TP")).when(F.contains(r, F.lit("matter of taste")), F.lit("FP3")).when(F.contains(r, F.lit("new mistake")), F.lit("FP2")).otherwise(F.lit("TP?"))
    return table(spark, d, "ensemble", "reasoning").where("reasoning is not null").groupBy(hint.alias("hint")).agg(F.count(F.lit(1)).alias("n"))


@query("k12_fused_votes", f"WITH v AS (SELECT trim(idx) AS unit_id, {NORM.format(c='tp_fp_label')} AS l, CASE WHEN model LIKE '%large%' THEN 0.4::DOUBLE WHEN model LIKE 'argus%' THEN 0.3::DOUBLE WHEN model LIKE 'lumen%' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS w FROM ensemble), s AS (SELECT unit_id, l, round(sum(w),4) AS s FROM v WHERE l <> 'Error' GROUP BY 1, 2) SELECT unit_id, l AS label, least(0.99::DOUBLE, s) AS score FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY s DESC, l) AS rn FROM s) WHERE rn = 1")
def k12_fused_votes(spark, d):
    """Labels of several tools fused by weight, the sum capped below one."""
    m = F.col("model")
    w = F.when(m.contains("large"), 0.4).when(m.startswith("argus"), 0.3).when(m.startswith("lumen"), 0.2).otherwise(0.1)
    v = table(spark, d, "ensemble", "idx", "tp_fp_label", "model").select(F.trim("idx").alias("unit_id"), L.normalized(F.col("tp_fp_label")).alias("label"), w.alias("w")).where("label <> 'Error'")
    s = v.groupBy("unit_id", "label").agg(F.round(F.sum("w"), 4).alias("s"))
    return s.groupBy("unit_id").agg(F.min_by(F.struct("label", "s"), F.struct(-F.col("s"), "label")).alias("x")).select("unit_id", "x.label", F.least(F.lit(0.99), F.col("x.s")).alias("score"))


@query("k13_word_pair_patterns", r"WITH e AS (SELECT trim(unnest(regexp_extract_all(aligned,'\{([^{}]*?)=>([^{}]*?)\}',1)),' ') AS o, trim(unnest(regexp_extract_all(aligned,'\{([^{}]*?)=>([^{}]*?)\}',2)),' ') AS n FROM gold_annotations) SELECT CASE WHEN o <> n AND translate(o,'áéíóúüñ','aeiouun') = translate(n,'áéíóúüñ','aeiouun') THEN 'accent' WHEN lower(o) = lower(n) THEN 'case' WHEN lower(o) IN ('a','an','the') AND lower(n) IN ('a','an','the') THEN 'article' WHEN lower(o[1:1]) = lower(n[1:1]) AND abs(length(o) - length(n)) <= 2 THEN 'spelling' ELSE 'other' END AS pattern, count(*) AS edits FROM e GROUP BY 1")
def k13_word_pair_patterns(spark, d):
    """Edits by the pattern of their two sides."""
    bare = lambda c: F.translate(c, "áéíóúüñ", "aeiouun")
    e = table(spark, d, "gold_annotations", "aligned").select(F.inline(X.edits(F.col("aligned"))))
    o, n = F.col("old"), F.col("new")
    article = F.lower(o).isin("a", "an", "the") & F.lower(n).isin("a", "an", "the")
    kind = F.when((o != n) & (bare(o) == bare(n)), F.lit("accent")).when(F.lower(o) == F.lower(n), F.lit("case")).when(article, F.lit("article")).when((F.lower(F.left(o, F.lit(1))) == F.lower(F.left(n, F.lit(1)))) & (F.abs(F.length(o) - F.length(n)) <= 2), F.lit("spelling")).otherwise(F.lit("other"))
    return e.groupBy(kind.alias("pattern")).agg(F.count(F.lit(1)).alias("edits"))


@query("snk8_outcomes", f"SELECT model, CASE WHEN {NORM.format(c='tp_fp_label')} = 'Error' THEN 'fail' WHEN {NORM.format(c='tp_fp_label')} = {NORM.format(c='gold_specialized')} THEN 'correct' ELSE 'error' END AS outcome, count(*) AS n FROM ensemble WHERE gold_specialized IS NOT NULL GROUP BY 1, 2")
def snk8_outcomes(spark, d):
    """Rows by outcome, as the outcome writer partitions them."""
    from inkwell.sources.sinks import outcome

    e = table(spark, d, "ensemble", "model", "tp_fp_label", "gold_specialized").where("gold_specialized is not null")
    o = outcome(L.normalized(F.col("gold_specialized")), L.normalized(F.col("tp_fp_label")))
    return e.groupBy("model", o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


