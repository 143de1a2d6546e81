"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from inkwell.sources import corpora as C
from inkwell.sources import sinks as S

TEN = "one two three four five six seven eight nine ten"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_char_edits(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", json.dumps({"id": "1", "text": "He go home now", "edits": [[0, [[3, 5, "goes"], [11, 14, None]]], [1, [[0, 2, "X"]]]]}) + "\nnot json\n" + json.dumps({"id": "2", "text": "Fine", "edits": []}) + "\n")
    assert rows(C.read_char_edits(spark, p)) == [("1", "He go home now", "He goes home "), ("2", "Fine", "Fine")]


def test_token_blocks(spark, tmp_path):
    p = write(tmp_path / "t.tsv", "He\tc\ngo\tV\tgoes\nto\tX\t\nhome\t-\n\nOk\tc\n")
    assert rows(C.read_token_blocks(spark, p).select("src", "tgt")) == [("He go to home", "He goes home"), ("Ok", "Ok")]


def test_flagged_tokens(spark, tmp_path):
    good = "\n".join(f"{w}\tc" for w in TEN.split()) + "\n.\tc"
    bad = "\n".join(f"{w}\t{'i' if w == 'two' else 'c'}" for w in TEN.split())
    p = write(tmp_path / "f.tsv", good + "\n\n" + bad + "\n")
    assert rows(C.read_flagged_tokens(spark, p).select("src", "tgt")) == [(TEN + ".", TEN + ".")]


def test_parallel_files(spark, tmp_path):
    write(tmp_path / "s/7.src.txt", f"{TEN}\n\nshort line\n{TEN} more\n")
    write(tmp_path / "t/7.a1.txt", f"{TEN}!\nshort line\n")
    got = C.read_parallel_files(spark, str(tmp_path / "s/*.src.txt"), str(tmp_path / "t/*.a1.txt"), r"/(\d+)\.[^/]*$")
    assert rows(got) == [("7-0", TEN, TEN + "!")]


def test_essay_blocks(spark, tmp_path):
    a = write(tmp_path / "o.md", "### essay_id = 1\nHello wrld\n\n### essay_id = 2\nsame\n")
    b = write(tmp_path / "r.md", "### essay_id = 1\nHello world\n\n### essay_id = 2\nsame\n")
    assert rows(C.read_essay_blocks(spark, a, b)) == [("1", "Hello wrld", "Hello world")]


def test_journal_arrays(spark, tmp_path):
    line = json.dumps(["j", "u", "Japanese", "English", ["Title", TEN + " bad"], [["Title"], [TEN + " <b>good</b>", "second"]]])
    other = json.dumps(["k", "u", "x", "Spanish", ["T", TEN], [["T"], [TEN + " a"]]])
    p = write(tmp_path / "j.dat", line + "\n" + other + "\n{broken\n")
    assert rows(C.read_journal_arrays(spark, p, "English").select("src", "tgt")) == [(TEN + " bad", TEN + " good")]


def test_pair_tsv(spark, tmp_path):
    p = write(tmp_path / "p.tsv", f"{TEN}\t{TEN}!\n{TEN}\t{TEN}\nshort\tshorter\n{TEN}\ta\tb\n")
    assert rows(C.read_pair_tsv(spark, p).select("src", "tgt")) == [(TEN, TEN + "!")]


def test_sgml(spark, tmp_path):
    p = write(tmp_path / "n.sgml", '<DOC nid="9"><TEXT><TITLE>T</TITLE><P>First one. Second one.</P><P>Third.</P></TEXT></DOC>')
    assert rows(C.read_sgml_documents(spark, p)) == [("9-0", "First one.", "First one."), ("9-1", "Second one.", "Second one."), ("9-2", "Third.", "Third.")]


def test_essay_versions(spark, tmp_path):
    write(tmp_path / "e/12.txt", "essay")
    write(tmp_path / "c/12.b.txt", "second")
    write(tmp_path / "c/12.a.txt", "first")
    assert rows(C.read_essay_versions(spark, str(tmp_path / "e"), str(tmp_path / "c"))) == [("12", "essay", "first")]


def test_alternating_lines(spark, tmp_path):
    p = write(tmp_path / "u.txt", "a\nb\nc\nd\n")
    assert rows(C.read_alternating_lines(spark, p).select("src", "tgt")) == [("a", "b"), ("c", "d")]


def test_lexicon(spark, tmp_path):
    p = write(tmp_path / "w.jsonl", "\n".join(json.dumps(x) for x in [{"word": "a", "lang_code": "EN", "pos": "n", "senses": [{"glosses": ["g1", "g2"], "examples": ["plain"]}]}, {"word": "b", "lang_code": "de", "pos": "v", "senses": [{"glosses": ["g"], "examples": [{"text": "obj"}]}]}, {"word": "c", "senses": [{}]}]))
    assert rows(C.read_lexicon(spark, p)) == [("a", "en", "n", "g1", "plain"), ("b", "de", "v", "g", "obj")]


def test_html_and_code_points(spark, tmp_path):
    df = spark.createDataFrame([("<html><style>x{}</style><p>A &amp; B</p><script>no</script></html>",)], "h string")
    assert df.select(C.html_text(F.col("h"))).collect()[0][0] == "A & B"
    p = write(tmp_path / "n.txt", "# comment\n@Part0\n00E9;00E9;0065 0301;00E9;0065 0301; # x\n")
    assert rows(C.read_code_points(spark, p)) == [("\u00e9", "\u00e9", "e\u0301", "\u00e9", "e\u0301")]


def test_csv_and_resolve(spark, tmp_path):
    p = write(tmp_path / "x.csv", 'idx,src\n1,"two\nlines ""q"""\n')
    df = C.read_pairs_csv(spark, p)
    assert rows(df.select("idx", "src", C.resolve(df, "nope", "idx"), C.resolve(df, "nope"))) == [("1", 'two\nlines "q"', "1", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "s", "t", "en", "d"), ("2", "u\nv", None, "de", "d")], "id string, src string, tgt string, language string, dataset string")
    rows_ = S.instruction_rows(df, "Fix")
    assert rows_.collect()[0].asDict() == {"instruction": "Fix", "input": "s", "output": "t", "aligned": "t", "dataset": "d", "id": "1"}
    S.write_jsonl(rows_, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    S.write_json_array(rows_, str(tmp_path / "a"))
    assert len(json.loads(spark.read.text(str(tmp_path / "a")).collect()[0][0])) == 2
    S.write_parallel(df, str(tmp_path / "p"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "p/src")).collect()] == ["s", "u v"]
    assert rows(S.write_by_language(df, str(tmp_path / "l"))) == [("d", "de", 1), ("d", "en", 1)]
    out = df.select(F.lit("TP").alias("gold"), F.when(F.col("id") == "1", "TP").alias("pred"))
    assert rows(out.select(S.outcome(F.col("gold"), F.col("pred")))) == [("correct",), ("fail",)]
    req = S.batch_requests(df.withColumnRenamed("id", "row_id"), "m", F.col("src")).collect()[0][0]
    assert json.loads(req)["custom_id"] == "row-1"
    assert S.filtered_projection(df.withColumn("a_label", F.lit("TP")).withColumn("b_label", F.lit("x")), ["a"]).columns == ["id", "src", "language", "dataset", "b_label", "a_label"]


def test_parallel_lines_belong_together(spark, tmp_path):
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).alias("id")).select("id", F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("t"), "id").alias("tgt"))
        S.write_parallel(df.repartition(8), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    parts = [sorted((tmp_path / "out" / side).glob("part-*")) for side in ("src", "tgt")]
    assert len(parts[0]) == len(parts[1]) > 1
    for a, b in zip(*parts, strict=True):
        x, y = a.read_text().split(), b.read_text().split()
        assert [i[1:] for i in x] == [i[1:] for i in y]


def test_essay_blocks_of_several_files(spark, tmp_path):
    for name, word in (("en", "wrld"), ("de", "Wlt")):
        write(tmp_path / f"in/{name}-orig-train.md", f"### essay_id = 1\nHello {word}\n")
        write(tmp_path / f"in/{name}-ref1-train.md", f"### essay_id = 1\nHello {name}\n")
    got = C.read_essay_blocks(spark, str(tmp_path / "in/*orig*"), str(tmp_path / "in/*ref1*"))
    assert rows(got) == [("1", "Hello Wlt", "Hello de"), ("1", "Hello wrld", "Hello en")]
