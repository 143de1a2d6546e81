"""Operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import alignment as A
from inkwell.functions import labels as L
from inkwell.functions import text as X
from inkwell.operators import agreement, cascade, cost, pairs, quality, retrieval, risk, votes


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_common_subsequence(a, b):
    assert X._common(a, b) == brute_lcs(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("ab cdé.,\n", max_size=25), st.text("ab cdé.,\n", max_size=25))
def test_alignment_round_trip(a, b):
    pieces = A.smoothed(A.merged(A.diff(a, b)))
    assert "".join(o for o, _ in pieces) == a
    assert "".join(n for _, n in pieces) == b
    assert A.diff_distance(a, b) >= abs(len(a) - len(b))


def test_alignment_merges_and_smooths():
    assert A.inline("He go to home now.", "He goes home now.") == "He {go to=>goes} home now."
    assert A.inline("a b", "a b") == "a b"


def test_kept_pairs(spark):
    long = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame(
        [(1, long, long, long), (2, long, "x " * 12, long), (3, long + "\nmore", long, long), (4, None, long, long), (5, "short", "short", "short"), (6, long, long, "{a=>b}" * 5)],
        "row_id int, src string, tgt string, aligned string",
    )
    assert [r.row_id for r in pairs.kept_pairs(df).collect()] == [1]


def test_majority_prefers_more_severe_on_tie(spark):
    v = spark.createDataFrame([("u", 1, "TP"), ("u", 2, "FP1"), ("w", 3, "TP"), ("w", 4, "TP"), ("w", 5, "FP1")], "unit_id string, vote_id int, label string")
    assert rows(votes.majority(v, "unit_id")) == [("u", "FP1", 1), ("w", "TP", 2)]
    assert votes.majority(v.limit(0), "unit_id").count() == 0


def test_missing_error_tie_means_yes(spark):
    a = spark.createDataFrame([("u", "True"), ("u", "False"), ("w", None), ("w", "missed_error"), ("", "True"), (None, "True"), ("x", None)], "_unit_id string, missed_error string")
    assert rows(votes.missing_error(a)) == [("u", True, True), ("w", True, True), ("x", False, False)]


def test_weighted_forms_differ(spark):
    v = spark.createDataFrame([("u", 1, "TP"), ("u", 2, "FP3")], "unit_id string, vote_id int, label string")
    assert rows(votes.weighted_label(v, strong=True)) == [("u", "TP")]
    assert rows(votes.weighted_label(v, strong=False)) == [("u", "FP3")]


def test_upsert_and_keep_first(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, label string, other string")
    upd = spark.createDataFrame([(1, "new"), (2, None)], "k int, label string")
    assert rows(pairs.upsert(base, upd, "k", "label")) == [(1, "new", "x"), (2, "b", None)]
    d = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", "c")], "row_id int, src string, tgt string")
    assert rows(pairs.keep_first(d, "row_id", "src", "tgt")) == [(1, "a", None), (2, "b", "c")]


def test_fleiss_all_equal_and_empty(spark):
    v = spark.createDataFrame([(i, k, l) for i, l in enumerate("AABB") for k in range(3)], "item int, vote_id int, label string")
    assert agreement.fleiss(v, "item").collect()[0].kappa == 1.0
    assert agreement.fleiss(v.limit(0), "item").collect()[0].kappa == 0.0


def test_quality_on_empty_and_zero_denominators(spark):
    df = spark.createDataFrame([("TP", "FP1")], "gold string, pred string")
    got = {r.label: r for r in quality.class_metrics(quality.confusion(df, "gold", "pred")).collect()}
    assert got["TP"].f1 == 0 and got["FP1"].support == 0
    assert quality.class_metrics(quality.confusion(df.limit(0), "gold", "pred")).count() == 0


def test_price_match_prefers_exact_then_longest(spark):
    p = spark.createDataFrame([("m", 1.0, 1.0, 1.0, 1.0), ("m-big", 2.0, 2.0, 2.0, 1.0)], "model string, input double, output double, reasoning double, cached double")
    u = spark.createDataFrame([(m, 1_000_000, 0, 0, 0) for m in ("m", "m-big-2", "other", None)], "model string, input_tokens int, output_tokens int, reasoning_tokens int, cached_tokens int")
    assert {r.model: r.cost for r in cost.with_cost(u, p).collect()} == {"m": 1.0, "m-big-2": 2.0, "other": 0.0, None: 0.0}


def test_cosine_top_k_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((60, 5))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<float>")
    got = rows(retrieval.cosine_top_k(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 3).select("query_id", "place", "neighbour_id"))
    n = x.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    want = []
    for q in (0, 20, 40):
        s = np.round(n @ n[q], 6)
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:3]
        want += [(q, k + 1, i) for k, i in enumerate(order)]
    assert got == sorted(want, key=repr)


#: Labels of the stub judge by the first hexadecimal digit of a digest.
STUB = ("TP", "TP", "TP", "TP", "TP", "TP", "FP3", "FP3", "FP2", "FP2", "FP1", "FP1", "TN", "TN", "FN", "Error")


def stub_judge(src, tgt, number):
    """A label from a digest of the pair and the judge's number."""
    digit = F.substring(F.md5(F.concat_ws("|", F.coalesce(src, F.lit("")), F.coalesce(tgt, F.lit("")), F.lit(str(number))).cast("binary")), F.lit(1), F.lit(1))
    return F.get(F.array(*map(F.lit, STUB)), F.instr(F.lit("0123456789abcdef"), digit) - 1)


def _stub(src, tgt, n):
    import hashlib

    return STUB[int(hashlib.md5(f"{src or ''}|{tgt or ''}|{n}".encode()).hexdigest()[0], 16)]


def _consensus(ls):
    v = [x for x in ls if x != "Error"]
    c = Counter(v)
    for l in L.LABELS:
        if v and 3 * c[l] >= 2 * len(v) and all(4 * c[x] <= len(v) for x in L.NON_ADJACENT[l]):
            return l
    return None


def _mode(ls):
    v = [x for x in ls if x != "Error"]
    return max(v, key=lambda x: (v.count(x), -v.index(x))) if v else "Error"


def test_iterative_critic_and_tiers(spark):
    data = [(i, f"s{i}", f"t{i}") for i in range(150)] + [(150, None, "t"), (151, "s", None)]
    df = spark.createDataFrame(data, "row_id int, src string, tgt string")
    want, tiers = {}, {}
    for i, s, t in data:
        ls = [_stub(s, t, k) for k in range(3)]
        while (f := _consensus(ls)) is None and len(ls) < 6:
            ls.append(_stub(s, t, len(ls)))
        want[i] = (f, len(ls)) if f else (_mode(ls) if any(x != "Error" for x in ls) else _stub(s, t, 99), len(ls) + 1)
        for k in range(3):
            ls = [_stub(s, t, n) for n in range(3 * k, 3 * k + 3)]
            f = _mode(ls) if k == 2 else _consensus(ls)
            if f:
                tiers[i] = (f, 3 * k + 3)
                break
    assert {r.row_id: (r.final, r.calls) for r in cascade.iterative_critic(df, stub_judge).collect()} == want
    assert {r.row_id: (r.final, r.calls) for r in cascade.tiered_votes(df, stub_judge).collect()} == tiers


def test_information_loss(spark):
    df = spark.createDataFrame([("a b c d e f g h", "x"), ("same words here", "same words here"), (None, "x"), ("", "")], "src string, tgt string")
    assert [r[0] for r in df.select(risk.information_loss(F.col("src"), F.col("tgt"))).collect()] == [True, False, False, False]


@pytest.mark.parametrize(
    ("text", "label"),
    [('{"classification": "fp1"}', "FP1"), ('{"classifications": ["FP"], "fp_severity": "FP3"}', "FP3"), ('{"classifications": ["FP"]}', "FP"), ('"label": "TN"', "TN"), ("so TP it is", "TP"), ("none", "Error"), ("", "Error"), (None, "Error")],
)
def test_parsed_label(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(L.parsed_label(F.col("t"))).collect()[0][0] == label


def test_label_and_span_rewriting(spark):
    df = spark.createDataFrame([("a {b=>c} d {e=>f} {g=>h}", ["TP", "FP1"])], "a string, l array<string>")
    assert df.select(A.labelled(F.col("a"), F.col("l"))).collect()[0][0] == "a {b=>c:::TP} d {e=>f:::FP1} {g=>h}"
    s = spark.sql("select 'hello world' t, array(named_struct('begin', 0, 'end', 5, 'repl', 'HI'), named_struct('begin', 6, 'end', 11, 'repl', 'you')) s")
    assert s.select(A.apply_spans(F.col("t"), F.col("s"))).collect()[0][0] == "HI you"


def test_tfidf_top_k_against_brute_force(spark):
    import math
    import random

    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 14)))) for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(texts, "row_id long, src string")
    got = {(r.query_id, r.neighbour_id): r.score for r in retrieval.tfidf_top_k(df, df.where("row_id % 20 = 0"), "row_id", "src", 4).collect()}
    grams = {i: Counter(t[j : j + n] for n in (3, 4, 5) for j in range(len(t) - n + 1)) for i, t in texts if t is not None}
    n = len(grams)
    idf = {g: math.log((1 + n) / (1 + c)) + 1 for g, c in Counter(g for c in grams.values() for g in c).items()}
    vec = {i: {g: c * idf[g] for g, c in x.items()} for i, x in grams.items()}
    norm = {i: math.sqrt(sum(w * w for w in x.values())) or 1 for i, x in vec.items()}
    want = {}
    for q in (0, 20, 40):
        if q in vec:
            s = {i: round(sum(w * vec[i].get(g, 0) for g, w in vec[q].items()) / norm[q] / norm[i], 4) for i in vec if i != q}
            for i in sorted((i for i in s if s[i] > 0), key=lambda i: (-s[i], i))[:4]:
                want[q, i] = s[i]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_balance_reads_a_stack(spark):
    texts = {"()": 0, ")(": 2, "([)]": 2, 'say "yes': 1, "it's 'fine'": 1, "«a» “b”": 0, "": 0, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", risk.unbalanced(F.col("t")).alias("n")).collect()} == texts


def test_numbers_run_over_all_parts(spark):
    from inkwell.operators.lineage import numbered

    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("v")).repartition(5)
    got = sorted(map(tuple, numbered(df, "idx", "v").collect()))
    assert [i for _, i in got] == list(range(1000))


def test_tfidf_in_small_parts_and_blocks(spark, monkeypatch):
    import math

    for name, small in (("PART_CHARS", 40), ("TFIDF_BLOCK", 2), ("SCORED_CHARS", 20), ("CANDIDATES", 3)):
        monkeypatch.setattr(retrieval, name, small)
    texts = [(i, w) for i, w in enumerate(["the cat sat", "a cat sat on it", "Кіт сів", "кіт ліг", "dogs run far", "the dog ran", "it sat", "no", "on the mat"])]
    texts += [(0, "cats run"), (None, "the cat"), (9, None), (10, "x" * 99), (11, "x" * 99)]
    df = spark.createDataFrame(texts, "row_id long, src string")
    got = {(r.query_id, r.neighbour_id): r.score for r in retrieval.tfidf_top_k(df, df.where("row_id <> 7"), "row_id", "src", 3).collect()}
    grams: dict = {}
    for i, t in texts:
        if t is not None:
            grams.setdefault(i, Counter()).update(t.lower()[j : j + n] for n in (3, 4, 5) for j in range(len(t) - n + 1))
    n = sum(t is not None for _, t in texts)
    idf = {g: math.log((1 + n) / (1 + c)) + 1 for g, c in Counter(g for c in grams.values() for g in c).items()}
    vec = {i: {g: c * idf[g] for g, c in x.items()} for i, x in grams.items() if x and i is not None}
    norm = {i: math.sqrt(sum(w * w for w in x.values())) for i, x in vec.items()}
    want = {}
    for q in vec:
        s = {i: round(sum(w * vec[i].get(g, 0) for g, w in vec[q].items()) / norm[q] / norm[i], 4) for i in vec if i != q and vec[q].keys() & vec[i].keys()}
        want |= {(q, i): s[i] for i in sorted(s, key=lambda i: (-s[i], i))[:3]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)


def test_rolled_up_costs_round_as_sql_does(spark, tmp_path):
    from inkwell.plans import catalog

    costs = [0.0039215, 0.0019855, 0.0040205, 0.0000005, 0.25, None]
    rows = [(i, f"u{i} ", "m", c, 1, 1, 1, 1) for i, c in enumerate(costs)] + [(9, "v", None, 0.0054582, 1, 1, 1, 1), (10, "v", "m", 0.0014883, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "row_id long, idx string, model string, total_cost_usd double, input_tokens long, output_tokens long, reasoning_tokens long, cached_tokens long")
    df.write.parquet(f"{tmp_path}/ensemble.parquet")
    con = duckdb.connect()
    con.execute(f"create view ensemble as select * from '{tmp_path}/ensemble.parquet/*.parquet'")
    want = dict(con.execute(f"select unit_id, total_cost_usd from ({catalog.oracle_sql()['a33_rolled_up_outputs']})").fetchall())
    got = {r.unit_id: r.total_cost_usd for r in catalog.queries()["a33_rolled_up_outputs"](spark, str(tmp_path)).collect()}
    assert got == want
