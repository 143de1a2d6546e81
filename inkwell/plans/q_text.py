"""Queries over text, alignment and answer-parsing functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import labels as L
from inkwell.functions import text as X
from inkwell.plans.registry import query
from inkwell.sources.tables import table


def _gold(spark, d, *cols):
    return table(spark, d, "gold_annotations", "row_id", *cols)


def _answers(spark, d, *cols):
    return table(spark, d, "ensemble", "row_id", *cols)


def _md5(c):
    return F.md5(c.cast("binary"))


_UP, _LO = "A-ZА-ЯІЇЄҐ", "a-zа-яіїєґ"


@query("s1_punctuation_spacing", f"SELECT row_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(src, '([.!?])([{_UP}][{_LO}])', '\\1 \\2', 'g'), '([.!?])([0-9])', '\\1 \\2', 'g'), '([{_LO}])([{_UP}])', '\\1. \\2', 'g'), ' ')) AS fixed FROM gold_annotations")
def s1_punctuation_spacing(spark, d):
    return _gold(spark, d, "src").select("row_id", _md5(X.fix_punctuation_spacing(F.col("src"))).alias("fixed"))


_FIXED = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])([{_UP}][{_LO}])', '\\1 \\2', 'g'), '([.!?])([0-9])', '\\1 \\2', 'g'), '([{_LO}])([{_UP}])', '\\1. \\2', 'g'), ' ')"


@query("s2_sentences", f"SELECT doc_id, n, md5(s) AS sentence FROM (SELECT doc_id, unnest(range(1, len(ss) + 1)) AS n, unnest(ss) AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_FIXED}, '([.!?])\\s+([{_UP}])', '\\1' || chr(9246) || '\\2', 'g'), chr(9246)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM documents WHERE text IS NOT NULL))")
def s2_sentences(spark, d):
    """The sentences of every document, by their digests."""
    s = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("n", "s"))
    return s.select("doc_id", (F.col("n") + 1).cast("bigint").alias("n"), _md5(F.col("s")).alias("sentence"))


@query("s3_tokens", r"SELECT row_id, len(regexp_extract_all(src, '[ \t\n.,;:!?()]|[^ \t\n.,;:!?()]+')) AS tokens, array_to_string(regexp_extract_all(src, '[ \t\n.,;:!?()]|[^ \t\n.,;:!?()]+'), '') = src AS whole FROM gold_annotations WHERE src IS NOT NULL")
def s3_tokens(spark, d):
    """Tokens that keep their delimiters; joined they give the text again."""
    t = F.regexp_extract_all("src", F.lit(r"[ \t\n.,;:!?()]|[^ \t\n.,;:!?()]+"), F.lit(0))
    return _gold(spark, d, "src").where("src is not null").select("row_id", F.size(t).alias("tokens"), (F.array_join(t, "") == F.col("src")).alias("whole"))


@query("s12_edits", r"SELECT row_id, unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 1)) AS old, unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 2)) AS new FROM gold_annotations")
def s12_edits(spark, d):
    old, new = (F.regexp_extract_all("aligned", F.lit(X.EDIT), F.lit(g)) for g in (1, 2))
    return _gold(spark, d, "aligned").select("row_id", F.inline(F.arrays_zip(old.alias("old"), new.alias("new"))))


@query("s13_projections", r"SELECT row_id, md5(trim(regexp_replace(aligned, '\{([^{}]*?)=>([^{}]*?)\}', '\1', 'g'), ' ')) AS src_side, md5(trim(regexp_replace(aligned, '\{([^{}]*?)=>([^{}]*?)\}', '\2', 'g'), ' ')) AS tgt_side FROM gold_annotations")
def s13_projections(spark, d):
    return _gold(spark, d, "aligned").select("row_id", _md5(X.project_src(F.col("aligned"))).alias("src_side"), _md5(X.project_tgt(F.col("aligned"))).alias("tgt_side"))


@query("s14_bare_edits", r"SELECT row_id, md5(regexp_replace(alignment_labels, ':::[A-Z0-9:]*\}', '}', 'g')) AS bare FROM gold_annotations WHERE alignment_labels IS NOT NULL")
def s14_bare_edits(spark, d):
    return _gold(spark, d, "alignment_labels").where("alignment_labels is not null").select("row_id", _md5(F.regexp_replace("alignment_labels", r":::[A-Z0-9:]*\}", "}")).alias("bare"))


@query("s15_edit_types", r"WITH e AS (SELECT source, trim(unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 1)),' ') AS o, trim(unnest(regexp_extract_all(aligned, '\{([^{}]*?)=>([^{}]*?)\}', 2)),' ') AS n FROM gold_annotations) SELECT source, CASE WHEN o='' AND n<>'' THEN 'insertion' WHEN o<>'' AND n='' THEN 'deletion' WHEN o=n THEN 'no_change' ELSE 'substitution' END AS kind, count(*) AS edits FROM e GROUP BY 1, 2")
def s15_edit_types(spark, d):
    e = table(spark, d, "gold_annotations", "source", "aligned").select("source", F.inline(X.edits(F.col("aligned"))))
    return e.groupBy("source", X.edit_type(F.col("old"), F.col("new")).alias("kind")).agg(F.count(F.lit(1)).alias("edits"))


@query("s19_detailed_votes", r"WITH e AS (SELECT row_id, unnest(regexp_extract_all(alignment_labels_detailed, '\{[^{}]*?=>[^{}]*?:::([A-Z0-9:]+)\}', 1)) AS v FROM gold_annotations) SELECT row_id, unnest(string_split(v, ':::')) AS label, count(*) AS votes FROM e GROUP BY 1, 2")
def s19_detailed_votes(spark, d):
    v = F.explode(F.regexp_extract_all("alignment_labels_detailed", F.lit(r"\{[^{}]*?=>[^{}]*?:::([A-Z0-9:]+)\}"), F.lit(1)))
    x = _gold(spark, d, "alignment_labels_detailed").select("row_id", v.alias("v")).select("row_id", F.explode(F.split("v", ":::")).alias("label"))
    return x.groupBy("row_id", "label").agg(F.count(F.lit(1)).alias("votes"))


@query("s20_missing_counts", r"SELECT report_id, TRY_CAST(nullif(regexp_extract(aligned_sentence, '\(missing_errors:(\d+)/(\d+)\)', 1),'') AS INT) AS missed, TRY_CAST(nullif(regexp_extract(aligned_sentence, '\(missing_errors:(\d+)/(\d+)\)', 2),'') AS INT) AS votes FROM generate_report WHERE contains(aligned_sentence, '(missing_errors:')")
def s20_missing_counts(spark, d):
    r = table(spark, d, "generate_report", "report_id", "aligned_sentence").where(F.contains("aligned_sentence", F.lit("(missing_errors:")))
    part = lambda g: F.nullif(F.regexp_extract("aligned_sentence", r"\(missing_errors:(\d+)/(\d+)\)", g), F.lit("")).cast("int")
    return r.select("report_id", part(1).alias("missed"), part(2).alias("votes"))


@query("s23_middle_word_edits", r"SELECT row_id, len(regexp_extract_all(aligned, '[\p{L}\p{N}]\{[^}]*=>[^}]*\}[\p{L}\p{N}]')) > 0 AS inside FROM gold_annotations WHERE aligned IS NOT NULL")
def s23_middle_word_edits(spark, d):
    return _gold(spark, d, "aligned").where("aligned is not null").select("row_id", (X.middle_word_spans(F.col("aligned")) > 0).alias("inside"))


@query("s25_clean_markup", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '<[^>]*>|\[/?[a-z-]+\]', '', 'g'), '[ \t\n\r\f\x{0B}]+', ' ', 'g'), ' ')) AS clean FROM documents WHERE text IS NOT NULL")
def s25_clean_markup(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", _md5(X.strip_markup(F.col("text"))).alias("clean"))


@query("s27_short_reasoning", r"WITH f AS (SELECT row_id, trim(regexp_replace(reasoning, '[ \t\n\r\f\x{0B}]+', ' ', 'g'), ' ') AS t FROM ensemble WHERE reasoning IS NOT NULL) SELECT row_id, md5(CASE WHEN length(t) > 500 THEN substr(t,1,500) || '...' ELSE t END) AS short FROM f")
def s27_short_reasoning(spark, d):
    return _answers(spark, d, "reasoning").where("reasoning is not null").select("row_id", _md5(X.clean_reasoning(F.col("reasoning"))).alias("short"))


@query("s29_numbered_prompt", "SELECT row_id, md5('{\"source\": \"' || src || '\", \"target\": \"' || tgt || '\"}') AS prompt FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL")
def s29_numbered_prompt(spark, d):
    """Placeholders {0} and {1} filled without touching the braces of JSON."""
    template = F.lit('{"source": "{0}", "target": "{1}"}')
    head = F.split_part(template, F.lit("{0}"), F.lit(1))
    rest = F.split_part(template, F.lit("{0}"), F.lit(2))
    filled = F.concat(head, F.col("src"), F.split_part(rest, F.lit("{1}"), F.lit(1)), F.col("tgt"), F.split_part(rest, F.lit("{1}"), F.lit(2)))
    return _gold(spark, d, "src", "tgt").where("src is not null and tgt is not null").select("row_id", _md5(filled).alias("prompt"))


@query("s32_token_estimate", r"SELECT model, sum(len(list_filter(regexp_split_to_array(reasoning, '[ \t\n\r]+'), lambda w: w <> '')))::BIGINT AS words FROM ensemble WHERE reasoning IS NOT NULL GROUP BY 1")
def s32_token_estimate(spark, d):
    words = F.size(F.filter(F.split("reasoning", r"[ \t\n\r]+"), lambda w: w != ""))
    return table(spark, d, "ensemble", "model", "reasoning").where("reasoning is not null").groupBy("model").agg(F.sum(words).alias("words"))


@query("pl1_normalized_labels", "SELECT row_id, CASE WHEN upper(trim(tp_fp_label)) IN ('TP','FP1','FP2','FP3','TN','FN') THEN upper(trim(tp_fp_label)) ELSE 'Error' END AS label FROM ensemble")
def pl1_normalized_labels(spark, d):
    return _answers(spark, d, "tp_fp_label").select("row_id", L.normalized(F.col("tp_fp_label")).alias("label"))


_IN6 = "('TP','FP1','FP2','FP3','TN','FN')"
_SCAN = "CASE " + " ".join(f"WHEN contains(' ' || up, ' {l}') THEN '{l}'" for l in ("TP", "TN", "FN", "FP1", "FP2", "FP3")) + " END"


@query("pl2_parsed_labels", rf"""WITH u AS (SELECT row_id, upper(reasoning) AS up FROM ensemble), p AS (SELECT row_id, up, regexp_extract(up, '"CLASSIFICATION"\s*:\s*"([A-Z0-9]+)"', 1) AS one, nullif(regexp_extract(regexp_extract(up, '"CLASSIFICATIONS"\s*:\s*\[(.*?)\]', 1), '"?(TP|TN|FN|FP1|FP2|FP3|FP)"?', 1),'') AS many, nullif(regexp_extract(up, '"FP_SEVERITY"\s*:\s*"?(FP[123])', 1),'') AS sev, nullif(regexp_extract(up, '"LABEL"\s*:\s*"(TP|TN|FN|FP1|FP2|FP3)"', 1),'') AS lab FROM u)
SELECT row_id, coalesce(CASE WHEN one IN {_IN6} THEN one END, CASE WHEN many = 'FP' THEN coalesce(sev, many) ELSE many END, lab, {_SCAN}, 'Error') AS label FROM p""")
def pl2_parsed_labels(spark, d):
    return _answers(spark, d, "reasoning").select("row_id", L.parsed_label(F.col("reasoning")).alias("label"))


@query("pl3_parsed_tnfn", r"""SELECT row_id, CASE WHEN reasoning IS NULL OR reasoning = '' THEN 'FN' ELSE coalesce(nullif(regexp_extract(upper(reasoning), '"CLASSIFICATION"\s*:\s*"(TN|FN)"', 1),''), CASE WHEN contains(' ' || upper(reasoning), ' TN') THEN 'TN' ELSE 'FN' END) END AS label FROM ensemble""")
def pl3_parsed_tnfn(spark, d):
    return _answers(spark, d, "reasoning").select("row_id", L.parsed_tnfn(F.col("reasoning")).alias("label"))


@query("pl4_writing_types", r"""SELECT row_id, CASE WHEN regexp_matches(reasoning, '(?i)"(type_of_writing|writing_type)"') THEN trim(regexp_extract(reasoning, '(?i)"(type_of_writing|writing_type)"\s*:\s*"([^"]+)"', 2)) ELSE '' END AS writing_type FROM ensemble""")
def pl4_writing_types(spark, d):
    return _answers(spark, d, "reasoning").select("row_id", L.parsed_writing_type(F.col("reasoning")).alias("writing_type"))


@query("pl6_baseline_labels", rf"""WITH u AS (SELECT row_id, reasoning, upper(reasoning) AS up FROM ensemble) SELECT row_id, CASE WHEN reasoning IS NULL OR reasoning = '' THEN 'TN' WHEN regexp_matches(up, '"CLASSIFICATION"\s*:\s*"[^"]*"') THEN CASE WHEN regexp_extract(up, '"CLASSIFICATION"\s*:\s*"([^"]*)"', 1) IN {_IN6} THEN regexp_extract(up, '"CLASSIFICATION"\s*:\s*"([^"]*)"', 1) ELSE 'TN' END WHEN contains(up,'FP1') THEN 'FP1' WHEN contains(up,'FP2') THEN 'FP2' WHEN contains(up,'FP3') THEN 'FP3' WHEN contains(up,'TP') THEN 'TP' WHEN contains(up,'TN') THEN 'TN' WHEN contains(up,'FN') THEN 'FN' ELSE 'TN' END AS label FROM u""")
def pl6_baseline_labels(spark, d):
    return _answers(spark, d, "reasoning").select("row_id", L.parsed_baseline(F.col("reasoning")).alias("label"))


@query("pl7_json_answers", r"SELECT row_id, json_extract_string(reasoning, '$.label') AS label FROM ensemble WHERE starts_with(trim(reasoning), '{') AND json_valid(reasoning)")
def pl7_json_answers(spark, d):
    """Answers given as JSON objects; malformed ones are left out."""
    v = F.try_parse_json("reasoning")
    rows = _answers(spark, d, "reasoning").where(F.startswith(F.trim("reasoning"), F.lit("{"))).withColumn("v", v).where("v is not null")
    return rows.select("row_id", F.try_variant_get("v", "$.label", "string").alias("label"))


@query("pl12_empty_label_lists", "SELECT count(*) FILTER (contains(replace(reasoning, chr(34)||chr(34), chr(34)), 'labels\":[]') OR contains(replace(reasoning, chr(34)||chr(34), chr(34)), 'labels\": []')) AS empty_lists, count(*) AS n, model FROM ensemble GROUP BY model")
def pl12_empty_label_lists(spark, d):
    r = F.replace(F.col("reasoning"), F.lit('""'), F.lit('"'))
    return table(spark, d, "ensemble", "model", "reasoning").groupBy("model").agg(F.count_if(F.contains(r, F.lit('labels":[]')) | F.contains(r, F.lit('labels": []'))).alias("empty_lists"), F.count(F.lit(1)).alias("n"))


@query("s10_inline_alignments", "SELECT row_id, true AS src_kept, true AS tgt_kept FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL AND NOT regexp_matches(src || tgt, '[{}]|=>')")
def s10_inline_alignments(spark, d):
    """Own alignments of all pairs, and whether their projections give the texts back (texts with edit marks aside)."""
    from inkwell.functions.alignment import inline_alignment

    g = _gold(spark, d, "src", "tgt").where("src is not null and tgt is not null").where(~F.concat("src", "tgt").rlike(r"[{}]|=>"))
    g = g.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id")  # a small file is one task's work else
    a = g.withColumn("a", inline_alignment("src", "tgt"))
    side = lambda g: F.regexp_replace("a", r"(?s)\{([^{}]*?)=>([^{}]*?)\}", f"${g}")
    return a.select("row_id", (side(1) == F.col("src")).alias("src_kept"), (side(2) == F.col("tgt")).alias("tgt_kept"))


@query("s6_diff_bounds", "SELECT row_id, true AS bounded FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL")
def s6_diff_bounds(spark, d):
    """That the word diff bounds the edit distance of every pair from above (the distance itself is a built-in)."""
    from inkwell.functions.alignment import word_diff_distance

    g = _gold(spark, d, "src", "tgt").where("src is not null and tgt is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id")
    x = g.select("row_id", F.levenshtein("src", "tgt").alias("n"), word_diff_distance("src", "tgt").alias("w"))
    return x.select("row_id", (F.col("w") >= F.col("n")).alias("bounded"))



@query("s17_labelled_edits", r"WITH e AS (SELECT row_id, aligned, regexp_extract_all(alignment_labels, ':::([A-Z0-9]+)\}', 1) AS l FROM gold_annotations WHERE aligned IS NOT NULL AND alignment_labels IS NOT NULL) SELECT row_id, least(len(l), len(regexp_extract_all(aligned, '\}'))) AS labelled FROM e")
def s17_labelled_edits(spark, d):
    """Edits that got their label, counted in the rewritten alignment."""
    from inkwell.functions.alignment import labelled

    g = _gold(spark, d, "aligned", "alignment_labels").where("aligned is not null and alignment_labels is not null")
    l = F.regexp_extract_all("alignment_labels", F.lit(r":::([A-Z0-9]+)\}"), F.lit(1))
    return g.select("row_id", F.regexp_count(labelled(F.col("aligned"), l), F.lit(r":::[A-Z0-9]+\}")).alias("labelled"))


@query("s22_word_differences", r"SELECT row_id, len(list_filter(list_zip(string_split(src,' '), string_split(tgt,' ')), lambda p: coalesce(p[1],'') <> coalesce(p[2],''))) AS differing FROM gold_annotations WHERE src IS NOT NULL AND tgt IS NOT NULL")
def s22_word_differences(spark, d):
    """Words that differ by position."""
    pairs = F.zip_with(F.split("src", " "), F.split("tgt", " "), lambda x, y: F.coalesce(x, F.lit("")) != F.coalesce(y, F.lit("")))
    return _gold(spark, d, "src", "tgt").where("src is not null and tgt is not null").select("row_id", F.size(F.filter(pairs, lambda p: p)).alias("differing"))
