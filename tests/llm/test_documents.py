"""Leaks, subjects, cuts, answers, languages: brute force, held-out accuracy and odd tables."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import answers, bigru, cuts, langs, leaks, shingles, subjects
from inkwell.llm.samples import LANGS

SF = "/root/testdata/sf0.01"


def plain_texts(spark, items):
    rows = leaks.plain_items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    return dict(map(tuple, rows))


def test_instructions(spark):
    twice = "The old mill is known for one thing: it ground flour day and night"
    got = plain_texts(spark, [(1, twice), (2, twice), (3, "Q: one"), (4, "Q: two"), (5, "He left. Then: no"), (6, "He left. Then: yes"), (7, None)])
    assert got == {1: twice, 2: twice, 3: " one", 4: " two", 5: "He left. Then: no", 6: "He left. Then: yes"}


def test_items_with_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(12))
    dd = spark.createDataFrame([("d", text), (None, text)], "doc_id string, text string")
    ii = spark.createDataFrame([("i", text)], "item_id string, text string")
    assert sorted(map(tuple, leaks.leaked_spans(dd, ii).collect()), key=repr) == [("d", "i", 0, 11), (None, "i", 0, 11)]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, ("Correct the text below please: " if i % 2 else "") + " ".join(rnd.choice(vocab) for _ in range(25))) for i in range(8)] + [(90, None), (91, ""), (92, "too short")]
    plain = plain_texts(spark, items)
    docs = []
    for d in range(120):
        w = [rnd.choice(vocab + ["other"]) for _ in range(rnd.randint(0, 60))]
        if d % 3 == 0:
            x = leaks.words(plain[rnd.randrange(8)])
            a = rnd.randrange(len(x) - 9)
            w[len(w) // 2 : len(w) // 2] = [y.upper() for y in x[a : a + rnd.randint(8, 14)]]
        docs.append((d, ",  ".join(w)))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    grams: dict = {}
    for i, t in plain.items():
        w = leaks.words(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = {(d, i) for d, t in docs if t for w in [leaks.words(t)] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    dd = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    ii = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    spans = leaks.leaked_spans(dd.repartition(3), ii)
    assert {(r.doc_id, r.item_id) for r in spans.collect()} == want and want
    assert leaks.leaked_spans(dd, ii.limit(0)).count() == 0 and leaks.leaked_spans(dd.limit(0), ii).count() == 0


def test_index_finds_and_locates_everything():
    rng = np.random.default_rng(1)
    seq = np.concatenate((rng.integers(1, 6, 700), [0]))
    index = leaks.FMIndex(seq, 6)
    for k in (1, 2, 4):
        phrase = seq[100 : 100 + k]
        lo, hi = index.search(phrase[None, :])
        got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert got == [i for i in range(len(seq) - k + 1) if (seq[i : i + k] == phrase).all()]


def test_subjects_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "doc_labels"))
    some = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rules = subjects.mine_rules(some, labels.where("pmod(hash(doc_id), 5) > 0"))
    held = labels.where("pmod(hash(doc_id), 5) = 0").groupBy("doc_id").agg(F.collect_set("subject").alias("s")).join(docs, "doc_id").where("text is not null")
    tp = fp = fn = 0
    for r in held.select("text", "s").collect():
        got, want = set(rules.decide(*rules.counts(r.text))), set(r.s)
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    assert 2 * tp / (2 * tp + fp + fn) > 0.75
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "...")], "doc_id long, text string").withColumn("subject", F.lit("clash"))
    assert subjects.assign_subjects(odd, labels, rules).count() == 0
    assert subjects.assign_subjects(docs.limit(5), labels.limit(0)).count() == 0


@pytest.mark.parametrize("text,finished", [("All is well.", True), ("All is well", False), ("All is we...", False), ('{"reasoning": "fine.", "label": "TP"}', True), ('{"reasoning": "fin', False), ("He said “no.”", True), ("...", True), ("zum 34.", False)])
def test_endings(text, finished):
    assert (cuts.ending(text) is None) == finished


def test_cut_texts(spark):
    whole = "The tone stays neutral and the register does not move. The surrounding words confirm this reading."
    rows = [("e", i, whole, None) for i in range(40)] + [("e", 100, whole[:-12], None), ("e", 101, whole[:-10] + "...", None), ("e", 102, whole[:-1], None), ("e", 103, None, None), ("e", 104, "  ", None)]
    pair = "The night train loses {an=>the} luggage again and that isn’t new."
    rows += [("g", 1, pair, [cuts.project(pair, 1), cuts.project(pair, 2)]), ("g", 2, pair[:30], [cuts.project(pair, 1), None]), ("g", 3, pair[:24], [None, cuts.project(pair, 2)])]
    df = spark.createDataFrame(rows, "tbl string, row_id long, text string, own array<string>")
    assert {(r.tbl, r.row_id) for r in cuts.cut_texts(df).collect()} == {("e", 100), ("e", 101), ("g", 2), ("g", 3)}
    assert cuts.cut_texts(df.limit(0)).count() == 0


def test_near_copy_that_ends_early(spark):
    words = [f"{a}{b}" for a in "abcdefg" for b in "qrstuvw"]
    full = " ".join(words[:40]) + "."
    df = spark.createDataFrame([("e", 1, full, None), ("e", 2, full, None), ("e", 3, " ".join(words[:37]), None)], "tbl string, row_id long, text string, own array<string>")
    assert [r.row_id for r in cuts.cut_texts(df).collect()] == [3]


def test_near_copies_that_differ_early_or_end_in_the_same_word(spark):
    words = [f"{a}{b}" for a in "abcdefg" for b in "qrstuvw"] + ["unmistakably"]
    full, longer = words[:39] + ["unmistakably"], words[:20] + ["other"] + words[21:46]
    rows = [(1, " ".join(full) + "."), (2, " ".join(longer) + "."), (3, " ".join(["another"] + words[1:36])), (4, " ".join(full)[:-4]), (5, " ".join(words[:33])), (6, " ".join(full))]
    rows += [(7, " ".join(words[32:21:-1])), (8, "lead " + " ".join(words[32:21:-1]) + ". " + " ".join(words[8::-1]) + ".")]  # a whole sentence
    # elsewhere their last words end sentences, so only a near-copy tells
    rows += [(100 + 10 * k + i, f"no{k} no{i} " + " ".join(t.split()[-3:]) + ".") for k, (_, t) in enumerate(rows[2:5]) for i in range(5)]
    df = spark.createDataFrame([("e", i, t, None) for i, t in rows], "tbl string, row_id long, text string, own array<string>")
    assert sorted(r.row_id for r in cuts.cut_texts(df).collect()) == [3, 4, 5]


def test_a_pair_of_several_buckets_is_compared_once(monkeypatch):
    asked = []
    goes_on_in = cuts.Asking.goes_on_in
    monkeypatch.setattr(cuts.Asking, "goes_on_in", lambda self, full: asked.append(full.text) or goes_on_in(self, full))
    words = [f"{a}{b}" for a in "abcdefg" for b in "qrstuvw"]
    full, cut = " ".join(words[:40]) + ".", " ".join(words[:37])
    other = " ".join(words[40:] + words[30:37] + words[:3]) + "."  # has the last words, not those before
    rows = [("e", band, 0, 0, i, asks, t) for band in (1, 2, 3) for i, t, asks in [(1, other, False), (2, cut, True), *([(3, full, False)] if band == 3 else [])]]
    frame = cuts.pd.DataFrame(rows, columns=["tbl", "band", "a", "b", "text_id", "asks", "text"])
    got = [tuple(r) for f in cuts._early_in_cells(iter([frame[:3], frame[3:]])) for r in f.itertuples(index=False)]
    assert got == [("e", 2)] and asked == [other, full]


@pytest.mark.parametrize("text", ["", "It's a_b 12.", "Це — слово, пpaвда", "ｗｉｔｈ ﬁnds, días!", "Ünï_ço\u0301de — ½ ß ẞ 漢", "naïve “quoted” text a\u00a0b"])
def test_letters_of_a_text(text):
    assert cuts.letters(text) == "".join(c for c in cuts.consistent(text).casefold() if c.isalnum())


def test_what_is_made_of_a_part_of_a_text_is_remembered(monkeypatch):
    asked = []
    monkeypatch.setattr(cuts, "consistent", lambda t, one_form=cuts.consistent: asked.append(t) or one_form(t))
    first, again = "Це “слoво” erwähnt días", "días erwähnt “слoво”"
    assert cuts.letters(first) == "цесловоerwähntdías"
    del asked[:]
    assert cuts.letters(again) == "díaserwähntслово" and not asked
    for odd in ("cafe \u0301x", "ﬁn Ⅳ x", "a\u200b b é", "x" * 50 + "é й"):  # what stands beside it counts, or it is long
        assert cuts.letters(odd) == "".join(c for c in cuts.consistent(odd).casefold() if c.isalnum())
    assert cuts._words("ΟΔΟΣ a_b  c’d\tΣ. é") == ["οδος", "a_b", "c", "d", "σ", "é"]


@pytest.mark.parametrize("text", ["", "a.", "a..", "a. .", "a ... \n", "a…", "a .. …\t", "..", "a… b.", "…\u200b"])
def test_dots_that_stand_for_more(text):
    assert cuts._undotted(text) == cuts._DOTS.sub("", text)


def test_bands_do_not_depend_on_the_block(monkeypatch):
    rnd = random.Random(3)
    texts = [[f"w{rnd.randrange(50)}" for _ in range(n)] for n in (0, 4, 5, 6, 90, 5, 30, 7, 200)]
    want = shingles.bands(texts)
    monkeypatch.setattr(shingles, "AT_ONCE", 20)
    assert shingles.bands(texts) == want == [shingles.bands([t])[0] for t in texts]
    assert [len(b) for b in want[:3]] == [0, 0, shingles.BANDS]


def test_kinds_of_answers(spark):
    src, tgt = "The old bus driver of Kepo waits at teh window", "The old bus driver of Kepo waits at the window"
    fine = "The edit changes “teh” to “the”, which removes a plain spelling slip. Final label: TP"
    de = "Die Änderung ersetzt „teh“ durch „the“ und das ist nicht ohne Grund. Das spricht für das Label „TP“."
    cases = [
        (1, fine, "TP", "en", None), (2, None, "TP", "en", "empty"), (3, fine, " ", "en", "empty"), (4, "n/a.", "TP", "en", "empty"), (5, "Error", "TP", "en", "empty"), (6, fine, "Error", "en", None),
        (7, "I’m sorry, but I can’t help with rating this sentence.", "Error", "en", "refusal"), (8, "The writer says sorry in the first clause, and I cannot agree with the edit. Final label: FP1", "FP1", "en", None),
        (9, src, "TP", "en", "copy"), (10, f"Original: {src}\nCorrected: {tgt}", "TP", "de", "copy"), (11, f"Final label: TP. Sentence in question: “{src}”", "TP", "en", None), (12, de, "TP", "en", "other_language"), (13, de, "TP", "de", None), (14, de, "TP", None, None),
    ]
    padding = [(100 + i, fine, "TP", "en", None) for i in range(30)] + [(200 + i, de, "TP", "de", None) for i in range(30)]
    df = spark.createDataFrame([(i, src, tgt, r, l, a) for i, r, l, a, _ in cases + padding], "row_id long, src string, tgt string, reasoning string, tp_fp_label string, answer_lang string").withColumn("defect", F.lit("clash"))
    got = {r.row_id: r.defect for r in answers.defective_answers(df).collect()}
    assert got == {i: k for i, *_, k in cases if k}
    assert answers.defective_answers(df.limit(0)).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(0)
    m = bigru.BiGRU(3, 4)
    for d in (m.forward, m.backward):
        d.table, d.u = d.table.astype(float), d.u.astype(float)
    x, y = rng.integers(0, 256, (6, 3)).astype(np.uint8), rng.integers(-1, 3, (6, 3))
    _, grads = m.loss_and_grads(x, y)
    for p, g in zip(m.params(), grads, strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        at = (x[1, 1], at[1]) if p.shape[0] == 256 else at
        old, e = p[at], 1e-2
        p[at] = old + e
        up, _ = m.loss_and_grads(x, y)
        p[at] = old - e
        down, _ = m.loss_and_grads(x, y)
        p[at] = old
        assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def test_languages_on_held_out_text(spark):
    report = spark.read.parquet(f"{SF}/generate_report.parquet").select("report_id", "src", "language")
    tagger = langs.train_tagger(report.where("report_id % 3 > 0"), "src", "language", steps=120)
    held = report.where("report_id % 3 = 0").where("src is not null")
    got = {r.row_id: r.lang for r in langs.label_texts(held, "report_id", "src", tagger).collect()}
    from inkwell.llm.samples import profile

    known = [(r.report_id, p) for r in held.collect() if (p := profile(r.src))]
    assert sum(got[i] == p for i, p in known) > 0.93 * len(known)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "?"), (4, "?"), (5, "слово " * 20_000)], "row_id long, src string").withColumn("lang", F.lit("clash"))
    out = {r.row_id: (r.lang, r.segments) for r in langs.label_texts(odd, "row_id", "src", tagger).collect()}
    assert out[1] == out[2] == out[3] == (None, []) and out[4][0] in LANGS and out[5][0] in ("uk", "ru")
    assert langs.label_texts(odd.limit(0), "row_id", "src", tagger).count() == 0


def test_the_network_is_trained_on_all_labelled_texts(spark):
    rare = "äöüßàáâãåæçèéêëìíîïñòóôõøùúûý"
    texts = [f"The old house near the {a}{b} is not for sale because of that." for a in "bcdfghjklm" for b in "aeioubcdfg"]
    texts += [f"The word {c}{c} is in the dictionary and that was it." for c in rare]
    df = spark.createDataFrame([(t, " EN") for t in texts for _ in range(2)], "src string, language string")
    tagger = langs.train_tagger(df, "src", "language", size=12, steps=2)
    before = bigru.BiGRU(len(LANGS), langs.HIDDEN, 5).forward.table
    assert all((tagger.model.forward.table[langs.to_bytes(c)[0]] != before[langs.to_bytes(c)[0]]).any() for c in rare)


def test_batches_hold_every_byte_once():
    rnd = random.Random(1)
    texts = [("en", "ab cd " * rnd.randrange(60)) for _ in range(500)] + [("uk", "слово " * 40_000), ("de", "")]
    got = np.zeros((len(LANGS), 256), int)
    for x, y in langs.strung(texts, rnd):
        assert x.shape == y.shape and len(x) == langs.LENGTH
        np.add.at(got, (y[y >= 0], x[y >= 0]), 1)
    want = np.zeros_like(got)
    for l, t in texts:
        np.add.at(want[LANGS.index(l)], langs.to_bytes(t), 1)
    assert (got == want).all()


def test_the_decoder_counts_the_texts_of_both_tables(spark, tmp_path):
    report = [(i, f"The wharf number {i} is near the old house.", "en") for i in range(40)]
    spark.createDataFrame(report, "report_id long, src string, language string").write.parquet(f"{tmp_path}/generate_report.parquet")
    spark.createDataFrame([(1, "The jetty is old."), (2, "The jetty is not old."), (3, "A jetty it was.")], "row_id long, src string").write.parquet(f"{tmp_path}/gold_annotations.parquet")
    decoder = langs._tables(spark, str(tmp_path))[3]
    assert "wharf" in decoder.vocab and "jetty" in decoder.vocab


def test_labels_of_languages(spark):
    df = spark.createDataFrame([("EN",), (" ua ",), ("deu",), ("und",), ("",), (None,)], "l string")
    assert [r[0] for r in df.select(langs.known_label(F.col("l"))).collect()] == ["en", "uk", "de", None, None, None]


def test_long_texts_are_read_in_windows():
    tagger = langs.Tagger(bigru.BiGRU(len(langs.LANGS), 4))
    long = "the cat sat on the mat " * 45_000  # a million characters beside a short one
    p = tagger.read([long, "short one"])
    assert [x.shape for x in p] == [(len(long), len(langs.LANGS)), (9, len(langs.LANGS))]
    assert np.allclose(p[0].sum(axis=1), 1, atol=1e-3)


def test_a_batch_of_the_network_takes_no_fresh_memory_for_its_steps():
    m, rng = bigru.BiGRU(6), np.random.default_rng(0)
    x, y = rng.integers(32, 99, (96, 256)).astype(np.uint8), rng.integers(-1, 6, (96, 256))
    first = m.loss_and_grads(x, y)
    tracemalloc.start()
    again = m.loss_and_grads(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and all((a == b).all() for a, b in zip(first[1], again[1], strict=True))


def test_only_texts_with_some_doubt_are_read_by_clause(monkeypatch):
    rng, asked, clauses = np.random.default_rng(2), [], langs.Tagger.clauses
    tagger = langs.Tagger(bigru.BiGRU(len(LANGS), 4))
    text = "the cat sat down, der Hund schlief dort ein. The cat sat up again!"
    probs = []
    for share in (0.001, 0.01, 0.03, 0.3):
        for a, b in ((0, len(text)), (18, 43)):
            other = np.zeros(len(text))
            other[a:b] = share * rng.random(b - a) * 2
            probs.append(np.stack([1 - other, other, *np.zeros((4, len(text)))], axis=1).astype(np.float32))
    probs.append(np.eye(6, dtype=np.float32)[[0] * 18 + [1] * 14 + [0] * (len(text) - 32)])
    monkeypatch.setattr(tagger, "read", lambda texts: [np.tile(np.eye(6, dtype=np.float32)[1], (len(t), 1)) for t in texts])
    monkeypatch.setattr(langs.Tagger, "clauses", staticmethod(lambda t, p: asked.append(p) or clauses(t, p)))
    got = tagger.segments([text] * len(probs), probs, tagger.pooled(probs))
    assert 0 < len(asked) < len(probs)
    doubted = [any(mean[0] < 1 - langs.DOUBT for _, _, mean in clauses(text, p)) for p in probs]
    assert all(any(p is q for q in asked) for p, doubt in zip(probs, doubted, strict=True) if doubt) and sum(doubted) > 1
    assert [s for s in got[:6] if s] == [] and [s[2] for s in got[-1]] == [0, 1, 0]


def test_rules_of_a_long_sentence():
    words = [f"w{i}" for i in range(5000)]
    table = {(i,): (0.5, 0.5) for i in range(5000)} | {(i, i + 1, i + 2): (0.9, 0.1) for i in range(0, 4000, 3)}
    rules = subjects.Rules(["a", "b"], {w: i for i, w in enumerate(words)}, table)
    assert np.allclose(rules.belief(frozenset(range(5000))), (0.9, 0.1))
    assert rules.belief(frozenset([1, 7])) == (0.5, 0.5) and rules.belief(frozenset()) is None
