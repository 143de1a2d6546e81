"""Encodings, look-alikes, formatting copies, tokens: nulls, blanks, long texts, ties, repeats, empty and odd tables."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import bpe, confusables, encoding, refine

SF = "/root/testdata/sf0.001"
EN = ["The night nurse near {} lowers the dose of the painkiller — and that’s “all”.", "In my opinion, the café on {} Square offers a room for £{}.", "The comma rule in {} forbids the double negative before the end of May."]
DE = ["Die Prüferin aus {} lehnt den Kredit ab für {} €.", "Der Biologe bei {} misst die Wellenlänge des Lichts trotz großer Mühe."]
UK = ["Учителька з району {} пояснює довге речення дуже обережно.", "Місцева газета з міста {} знаходить давній лист до кінця травня."]


def corpus():
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice("bdfgklm") + rnd.choice("aeiou") for _ in range(3)).title()
    return [t.format(name(), rnd.randint(2, 99)) for t in (EN + DE + UK) * 60]


@pytest.fixture(scope="module")
def decoder():
    return encoding.Decoder(corpus(), sorted({encoding._inner(w) for t in corpus() for w in t.split()}))


@pytest.mark.parametrize("shown,really", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8")])
def test_restores_what_was_shown_wrongly(decoder, shown, really):
    for clean in (EN[0].format("Kemipo"), DE[0].format("Fabeki", 7), UK[0].format("Галите")):
        back = {b: c for c, b in encoding._bytes_of(shown).items()}
        garbled = "".join(back[b] for b in clean.encode(really))
        text, hit, steps = decoder.restore(garbled)
        assert hit and steps >= 1 and text == clean
        twice = "".join(back[b] for b in garbled.encode("utf-8")) if shown == "cp1252" else None
        if twice:
            assert decoder.restore(twice)[0] == clean


def test_one_byte_pairs_and_lost_letters(decoder):
    clean = UK[1].format("Мирово")
    assert decoder.restore(clean.encode("cp1251").decode("latin-1"))[0] == clean
    assert decoder.restore(clean.encode("koi8_u").decode("cp1251"))[1]
    assert decoder.restore("The caf� on Biko Square.")[1:] == (True, 0)


@pytest.mark.parametrize("text", [None, "", "   ", "plain ascii", "The letter Â never stands in English words.", "¡Ñandú y AÑO se escriben con Ñ!", "Р. С. Дякую!", "½ № § é"])
def test_correct_text_is_left_alone(decoder, text):
    assert decoder.restore(text) == (text, False, 0)


def test_restore_fields_on_odd_tables(spark, decoder):
    df = spark.createDataFrame([(1, None, "", "x"), (2, "cafÃ© on Kepo Square", None, "x"), (2, "cafÃ© on Kepo Square", None, "x"), (3, "é" * 50_000, "ok", None)], "row_id long, src string, tgt string, field string")
    got = encoding.restore_fields(df, "row_id", "src", "tgt", decoder=decoder)
    assert sorted((r.row_id, r.field) for r in got.collect()) == [(2, "src"), (2, "src")]
    assert encoding.restore_fields(df.limit(0), "row_id", "src", "tgt").count() == 0


@pytest.mark.parametrize(
    "text,form",
    [("ｗｉｔｈ care", "with care"), ("𝐨𝐟 it", "of it"), ("ﬁnds", "finds"), ("días", "días"), ("h​ikers", "hikers"), ("a b", "a b"), ("аbout", "about"), ("пpaвда", "правда"), ("﻿Text", "Text")],
)
def test_disguised(text, form):
    assert confusables.consistent(text) == form
    assert confusables.skeleton(text) == confusables.skeleton(form)


@pytest.mark.parametrize("text", ["tab\tand\nline", "“quotes” — …", "№ 5 ½", "За́мок", "👩‍💻 works", "слово word слово", "68.ª vez", "naïve café", ""])
def test_not_disguised(text):
    assert confusables.consistent(text) == text and not confusables.odd_words(text)


def test_disguised_fields_on_odd_tables(spark, decoder):
    df = spark.createDataFrame([(1, None, None, None), (2, "ｗ", "cafÃ© on Kepo Square", None), (3, "a b", "a b", "a b"), (3, "a b", "a b", None)], "row_id long, src string, tgt string, aligned string").withColumn("field", F.lit(1))
    got = confusables.disguised_fields(df, "row_id", "src", "tgt", "aligned", decoder=decoder)
    assert sorted((r.row_id, r.field) for r in got.collect()) == [(3, "aligned"), (3, "src")]
    classes = confusables.lookalike_classes(df, "row_id", "src", "tgt", "aligned").collect()
    assert [(r.spellings, r.fields) for r in classes] == [(2, 5)]
    assert confusables.disguised_fields(df.limit(0), "row_id", "src", decoder=decoder, check_garbled=()).count() == 0


def test_formatting_sets_against_brute_force(spark):
    rnd = random.Random(2)
    base = [("Ab cd", "Ef gh."), ("Straße 1", "x"), ("é", "e"), ("", "?!"), (None, None), (None, "ab")]
    rows = []
    for i in range(300):
        a, b = rnd.choice(base)
        twist = lambda t: None if t is None else rnd.choice((str.upper, str.lower, lambda s: s.replace(" ", "  "), lambda s: f"“{s}”!"))(t)
        a, b = twist(a), twist(b)
        rows.append((i, b, a) if rnd.random() < 0.5 else (i, a, b))
    df = spark.createDataFrame(rows, "row_id long, src string, tgt string").withColumn("set_id", F.lit("clash"))
    bare = lambda t: "".join(c for c in (t or "").casefold() if c.isalnum())
    sets: dict = {}
    for i, a, b in rows:
        if bare(a) or bare(b):
            sets.setdefault(tuple(sorted((bare(a), bare(b)))), []).append(i)
    want = {(m[0], i, len(m)) for m in sets.values() if len(m) > 1 for i in m}
    assert {tuple(r) for r in refine.formatting_sets(df, "row_id", "src", "tgt").collect()} == want
    kept = refine.collapse(df.drop("set_id"), "row_id", "src", "tgt")
    assert kept.count() == len(rows) - sum(len(m) - 1 for m in sets.values())
    assert refine.formatting_sets(df.limit(0), "row_id", "src", "tgt").count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aabcd  eé€іїThesting\n\t'!-.0123漢👩‍") , max_size=60))
def test_same_ids_as_the_library(text):
    from tokenizers import Tokenizer

    t = _LIB.setdefault("t", Tokenizer.from_file(bpe.default_path()))
    t.encode_special_tokens = True
    a = bpe.automaton(bpe.default_path())
    ids = [i for w in bpe._SPLIT.findall(text) for i in a.encode_word(w)]
    assert ids == t.encode(text, add_special_tokens=False).ids
    assert a.decode(ids) == text


_LIB: dict = {}


def test_runs_and_specials(library):
    a = bpe.automaton(bpe.default_path())
    for s in ["a" * 57, " " * 40, "!" * 33, "-" * 70, "<|endoftext|>", "haha" * 30]:
        assert [i for w in bpe._SPLIT.findall(s) for i in a.encode_word(w)] == library.encode(s, add_special_tokens=False).ids


def test_documents_encode_whole(spark, library):
    long = "Das Gewächshaus liest. " * 20_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, long), (4, "x"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()]
    assert sorted((d, len(i)) for d, i in got if d)[:3] == [(1, 0), (2, 0), (3, 1)]
    assert (4, library.encode(long, add_special_tokens=False).ids) in got and len(got) == 6
    assert bpe.encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,form", [("Ꭰog", "Dog"), ("ꓐank", "Bank"), ("ցood", "good"), ("ⅽat", "cat"), ("ɡood", "good")])
def test_letters_of_rare_scripts(text, form):
    assert confusables.consistent(text) == form and confusables.skeleton(text) == form


def test_class_decides_an_undecided_word(spark, decoder):
    df = spark.createDataFrame([(1, "a ԍооd day"), (2, "a good day"), (3, "a good one"), (4, "Ⅳ. Kapitel")], "row_id long, src string")
    got = confusables.disguised_fields(df, "row_id", "src", decoder=decoder)
    assert [(r.row_id, r.form) for r in got.collect()] == [(1, "a good day")]


@pytest.mark.parametrize("fields", [("src", "tgt"), ("src",)], ids=["p1_p5", "p6"])
def test_a_decoder_counts_all_texts(spark, fields):
    rnd = random.Random(6)
    name = lambda: "".join(rnd.choice("bdfgklm") + rnd.choice("aeiou") for _ in range(4)).title()
    texts = [(EN + DE + UK)[i % 7].format(name(), i) for i in range(12_000)]
    texts += [f"The façade of {name()} is near the old house." for _ in range(100)] + [None, " "]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "row_id long, src string, tgt string")
    got = encoding.fit_decoder(df, *fields)
    want = encoding.Decoder({t for t in texts if t and t.strip()}, [])
    assert got.letters == want.letters and got.code.one == want.code.one
    assert "ç" in got.letters["en"] and "façade" in got.vocab and "facade" not in got.vocab


@pytest.mark.parametrize("fields", [("src", "tgt"), ("src",)], ids=["p1_p5", "p6"])
def test_a_dictionary_holds_what_is_frequent_over_all_texts(spark, fields):
    rnd = random.Random(7)
    name = lambda: "".join(rnd.choice("bdfgklm") + rnd.choice("aeiou") for _ in range(5)).title()
    texts = [(EN + DE + UK)[i % 7].format(name(), i) for i in range(12_000)]
    texts += [f"The {w} of {name()} is near the old house." for w in "wharf quay jetty mooring towpath sluice weir lock canal barge skiff punt".split() for _ in range(4)]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "row_id long, src string, tgt string")
    got = encoding.fit_decoder(df, *fields)
    assert got.raw == encoding.Decoder(set(texts), []).raw
    assert all(got.code.encode(f" {w} ") in got.raw["en"] for w in "wharf quay jetty mooring towpath sluice weir lock canal barge skiff punt".split())


def test_a_vocabulary_has_no_upper_size():
    words = encoding.Words.of(f"w{i}" for i in range(250_000))
    assert "w0" in words and "w249999" in words and "w250000" not in words
    assert "w0" not in encoding.Words.of([])


def test_counts_of_a_block_against_brute_force():
    texts = [(k * 7919 % 1009, t) for k, t in enumerate(corpus() + ["A 漢 is in the house and a is a letter.", "The the THE the of", "and  of\u00a0the 😀 is"])]
    counts, first = encoding.defaultdict(encoding.Counter), encoding.defaultdict(dict)
    encoding.tally(texts, counts, first)
    want, least = encoding.defaultdict(encoding.Counter), encoding.defaultdict(dict)
    for key, t in texts:
        if l := encoding.profile(t):
            want[l, "text"][""] += 1
            for kind, held in (("letter", set(t)), ("word", set(t.split()))):
                want[l, kind].update(held)
                least[l] |= {x: min(key, least[l].get(x, key)) for x in held}
    assert counts == want and first == least
    for read in (encoding._letters_in, encoding._words_in):
        assert all(isinstance(x, list) for x in read([""]))


def test_only_chains_that_may_be_supported_are_read(decoder, monkeypatch):
    words = [w.encode(a).decode(b) for w in ("Учителька", "Prüferin", "жабові", "ßtraße") for a, b in (("cp1251", "cp1252"), ("cp1252", "cp1250"), ("koi8_u", "cp1251"), ("cp1251", "cp866"), ("utf-8", "cp437")) if w.encode(a, "ignore").decode(a) == w and w.encode(a).decode(b, "ignore").encode(b) == w.encode(a)]
    asked = []
    by_chain = encoding._by_chain
    monkeypatch.setattr(encoding, "_by_chain", lambda w, k: asked.append(k) or by_chain(w, k))
    n = len(encoding.UTF8_SHOWN)
    other = 0
    for w in (w for w in words if encoding._inner(w) not in decoder.vocab):
        every = {k: r for k, (e, f) in enumerate(encoding.ONE_BYTE, n) if (r := encoding.reread(w, e, f)) not in (None, w)}
        other += len(every)
        assert [k for k, _ in decoder._readings(w)[1]] == list(every) and all(by_chain(w, k) == r for k, r in every.items())
        for lang in ("en", "de", "uk", ""):
            letters = decoder.letters.get(lang, set())
            known = {k for k, r in every.items() if len(x := encoding._inner(r)) > 1 and decoder.everywhere.issuperset(x) and x in decoder.vocab}
            assert {k for k in decoder._supported(w, lang) if k >= n} == known | {k for k, r in every.items() if encoding._fits(w, r, letters)}
    assert len(words) > 5 and 0 < len(asked) < 2 * other
