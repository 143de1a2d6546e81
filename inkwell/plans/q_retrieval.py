"""Queries over retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import retrieval as R
from inkwell.operators import risk
from inkwell.plans.registry import query
from inkwell.sources.tables import table


@query("r2_cosine_top_k", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, round(list_cosine_similarity(q.e, v.e),6) AS score FROM q JOIN v ON q.vec_id <> v.vec_id) SELECT query_id, neighbour_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS place FROM s) WHERE place <= 10")
def r2_cosine_top_k(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    top = R.cosine_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return top.select("query_id", "neighbour_id", F.col("place").cast("bigint").alias("place"))


@query("k5_centroid_distance", "WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY 1) SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], m.c),4) AS distance FROM embeddings JOIN m USING (label)")
def k5_centroid_distance(spark, d):
    """Distance of every vector to the mean of its label."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    x = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = x.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", F.transform("c", lambda p: p["x"]).alias("c"))
    return e.join(m, "label").select("vec_id", F.round(1 - risk.cosine(F.col("embedding"), F.col("c")), 4).alias("distance"))


@query("r3_token_overlap", r"WITH s AS (SELECT subject, list_distinct(regexp_extract_all(lower(description), '\p{L}{4,}')) AS w FROM subject_areas), t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\p{L}{4,}')) AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, subject, len(list_intersect(t.w, s.w)) AS score FROM t, s WHERE len(list_intersect(t.w, s.w)) >= 2")
def r3_token_overlap(spark, d):
    """Rules (subject descriptions) that share two and more words with a document."""
    w = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("\\p{L}{4,}"), F.lit(0)))
    rules = table(spark, d, "subject_areas").select("subject", F.explode(w("description")).alias("w"))
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(w("text")).alias("w"))
    return docs.join(rules, "w").groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("score")).where("score >= 2")


@query("r5_field_weighted_rules", "WITH q AS (SELECT row_id, lower(src) AS s FROM gold_annotations WHERE src IS NOT NULL), r AS (SELECT subject, lower(subject) AS n, string_split(lower(description), ', ') AS ds FROM subject_areas), x AS (SELECT row_id, subject, 3 * contains(s, n)::INT + 2 * len(list_filter(ds, lambda k: contains(s, k))) AS score FROM q, r) SELECT row_id, subject, score FROM x WHERE score > 0")
def r5_field_weighted_rules(spark, d):
    """Rules scored by name (3) and key phrases (2) found in the text; the rule table has a checked size."""
    rules = table(spark, d, "subject_areas")
    few = rules.limit(10_001).count() <= 10_000
    q = table(spark, d, "gold_annotations", "row_id", "src").where("src is not null").select("row_id", F.lower("src").alias("s"))
    r = rules.select("subject", F.explode(F.concat(F.array(F.struct(F.lower("subject").alias("k"), F.lit(3).alias("p"))), F.transform(F.split(F.lower("description"), ", "), lambda k: F.struct(k.alias("k"), F.lit(2).alias("p"))))).alias("x"))
    hits = q.join(F.broadcast(r) if few else r, F.contains("s", F.col("x.k")))
    return hits.groupBy("row_id", "subject").agg(F.sum("x.p").alias("score"))


@query("r1_tfidf_top_k", """WITH t AS (SELECT row_id AS id, lower(src) AS t FROM gold_annotations WHERE src IS NOT NULL), g AS (SELECT id, gram, count(*) AS tf FROM (SELECT id, substr(t, unnest(range(1, length(t) - n + 2)), n) AS gram FROM t, (SELECT unnest([3,4,5]) AS n) WHERE length(t) >= n) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM t), i AS (SELECT gram, ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) + 1.0 AS idf FROM g GROUP BY 1), w AS (SELECT id, g.gram, tf*idf AS w FROM g JOIN i ON g.gram = i.gram), m AS (SELECT id, sqrt(sum(w*w)) AS norm FROM w GROUP BY 1), u AS (SELECT w.id, gram, w/norm AS w FROM w JOIN m ON w.id = m.id),
s AS (SELECT q.id AS query_id, u.id AS neighbour_id, round(sum(q.w*u.w),4) AS score FROM u q JOIN u ON q.gram = u.gram WHERE q.id % 50 = 0 AND q.id <> u.id GROUP BY 1, 2) SELECT query_id, count(*) AS hits, max(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id) AS place FROM s) WHERE place <= 5 GROUP BY 1""")
def r1_tfidf_top_k(spark, d):
    """Every fiftieth gold source against all of them: number of hits and best score."""
    g = table(spark, d, "gold_annotations", "row_id", "src")
    top = R.tfidf_top_k(g, g.where("row_id % 50 = 0"), "row_id", "src", 5)
    return top.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"))
