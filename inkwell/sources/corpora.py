"""Readers of correction corpora: every format becomes ``id, src, tgt`` rows.

Records are cut by the reader (``lineSep``, ``wholetext``) and taken apart with column
expressions; malformed records are skipped, not fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X

_NONE = "array<string>"


def read_pairs_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header; all columns are strings unless a schema is given; texts may hold newlines."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r.option("inferSchema", False)).csv(path)


def resolve(df: DataFrame, *candidates: str) -> Column:
    """The first of the candidate columns that exists; null when none does."""
    return next((F.col(c) for c in candidates if c in df.columns), F.lit(None).cast("string"))


def read_char_edits(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines ``text, edits = [[annotator, [[start, end, replacement], ...]], ...]``.

    The first annotator's edits are applied from right to left; a null replacement deletes.
    """
    rows = spark.read.text(list(paths)).select(F.try_parse_json("value").alias("v")).where("v is not null")
    x = rows.select(F.expr("try_variant_get(v, '$.id', 'string')").alias("id"), F.expr("try_variant_get(v, '$.text', 'string')").alias("src"), F.expr("try_variant_get(v, '$.edits[0][1]', 'array<array<string>>')").alias("e"))
    edits = F.transform(F.coalesce("e", F.array().cast("array<array<string>>")), lambda t: F.struct(F.get(t, F.lit(0)).cast("int").alias("a"), F.get(t, F.lit(1)).cast("int").alias("b"), F.coalesce(F.get(t, F.lit(2)), F.lit("")).alias("r")))
    back = F.reverse(F.array_sort(edits))
    tgt = F.aggregate(back, F.col("src"), lambda acc, t: F.concat(F.substring(acc, F.lit(1), t["a"]), t["r"], F.substring(acc, t["b"] + 1, F.lit(2**30))))
    return x.where("src is not null").select("id", "src", tgt.alias("tgt"))


def _tokens(c: Column) -> Column:
    """Lines of a token block as array of (token, tag, replacement)."""
    lines = F.filter(F.split(c, "\n"), lambda l: F.trim(l) != "")
    return F.transform(lines, lambda l: F.struct(F.get(F.split(l, "\t"), F.lit(0)).alias("t"), F.coalesce(F.get(F.split(l, "\t"), F.lit(1)), F.lit("")).alias("g"), F.get(F.split(l, "\t"), F.lit(2)).alias("r")))


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated ``token<TAB>tag<TAB>replacement``; an empty replacement deletes."""
    b = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("id"), _tokens(F.col("value")).alias("k")).where("size(k) > 0")
    keep = lambda t: t["g"].isin("", "-", "c")
    fixed = F.filter(F.transform("k", lambda t: F.when(keep(t), t["t"]).otherwise(F.coalesce(t["r"], F.lit("")))), lambda w: w != "")
    return b.select("id", F.array_join(F.transform("k", lambda t: t["t"]), " ").alias("src"), F.array_join(fixed, " ").alias("tgt"))


def read_flagged_tokens(spark: SparkSession, path: str, least_words: int = 10) -> DataFrame:
    """``token<TAB>c|i`` blocks; sentences with an incorrect token are dropped, so tgt is src."""
    b = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("id"), _tokens(F.col("value")).alias("k"))
    good = b.where(F.size("k") >= least_words).where(~F.exists("k", lambda t: t["g"] == "i"))
    s = german_detokenized(F.array_join(F.transform("k", lambda t: t["t"]), " "))
    return good.select("id", s.alias("src"), s.alias("tgt"))


def german_detokenized(c: Column) -> Column:
    """Ordered literal replacements, then single spaces."""
    for a, b in ((" .", "."), (" ,", ","), (" ;", ";"), (" :", ":"), (" !", "!"), (" ?", "?"), ("( ", "("), (" )", ")"), ("„ ", "„"), (" “", "“")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def read_parallel_files(spark: SparkSession, src_glob: str, tgt_glob: str, id_pattern: str, least_words: int = 10) -> DataFrame:
    """Files matched by the id in their names; their non-empty lines are paired by position."""

    def side(glob: str, name: str) -> DataFrame:
        t = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("file"), "value")
        lines = F.filter(F.transform(F.split("value", "\n"), lambda l: F.trim(l)), lambda l: l != "")
        return t.select("file", F.posexplode(lines).alias("line", name))

    both = side(src_glob, "src").join(side(tgt_glob, "tgt"), ["file", "line"])
    return both.where(X.n_words(F.col("src")) >= least_words).select(F.concat_ws("-", "file", "line").alias("id"), "src", "tgt")


def read_essay_blocks(spark: SparkSession, src_path: str, tgt_path: str, side_name: str = r"(?i)orig|ref\d*") -> DataFrame:
    """Markdown blocks ``### essay_id = X``, paired by file and by position in it; equal pairs are dropped.

    Files belong together whose names are equal without what matches ``side_name``; a
    side of one file needs no such name.
    """

    def side(path: str, name: str) -> DataFrame:
        files = spark.read.text(path, wholetext=True).select("value", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), side_name, "").alias("file"))
        several = files.select("file").distinct().limit(2).count() > 1
        t = files.select(F.col("file") if several else F.lit("").alias("file"), F.posexplode(F.filter(F.split("value", "### essay_id = "), lambda b: F.trim(b) != "")).alias("place", "b"))
        return t.select("file", "place", F.trim(F.split_part("b", F.lit("\n"), F.lit(1))).alias(f"{name}_id"), F.regexp_replace(F.regexp_replace("b", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias(name))

    x = side(src_path, "src").join(side(tgt_path, "tgt"), ["file", "place"]).where("src <> tgt")
    return x.select(F.when(F.col("src_id") == F.col("tgt_id"), F.col("src_id")).otherwise(F.concat_ws("|", "src_id", "tgt_id")).alias("id"), "src", "tgt")


def read_journal_arrays(spark: SparkSession, path: str, language: str, least_words: int = 10) -> DataFrame:
    """JSON-array lines ``[id, user, native, learning, [title, s...], [[t, [c...]...]]]``.

    Rows of one learning language; the title is skipped; the first correction counts.
    """
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda p, t: F.expr(f"try_variant_get(v, '{p}', '{t}')")
    x = v.where(get("$[3]", "string") == language).select(get("$[0]", "string").alias("id"), get("$[4]", _NONE).alias("s"), get("$[5]", "array<array<string>>").alias("c"))
    pairs = F.arrays_zip(F.slice("s", 2, 2**20).alias("src"), F.transform(F.slice("c", 2, 2**20), lambda a: F.get(a, F.lit(0))).alias("tgt"))
    y = x.select("id", F.posexplode(pairs).alias("n", "p")).select(F.concat_ws("-", "id", "n").alias("id"), X.strip_markup(F.col("p.src")).alias("src"), X.strip_markup(F.col("p.tgt")).alias("tgt"))
    return y.where("tgt is not null and src <> tgt").where(X.n_words(F.col("src")) >= least_words)


def read_pair_tsv(spark: SparkSession, path: str, low: int = 10, high: int = 50) -> DataFrame:
    """Lines of exactly two tab-separated fields that differ, the source of ``low`` to ``high`` words."""
    f = F.split("value", "\t")
    x = spark.read.text(path).where(F.size(f) == 2).select(F.monotonically_increasing_id().alias("id"), f[0].alias("src"), f[1].alias("tgt"))
    return x.where("src <> tgt").where(X.n_words(F.col("src")).between(low, high))


def read_sgml_documents(spark: SparkSession, path: str) -> DataFrame:
    """``<DOC nid=..>`` with ``<TEXT>`` and ``<P>``: sentences of the paragraphs, tgt is src."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<DOC .*?</DOC>)"), F.lit(1))).alias("doc"))
    paras = F.regexp_extract_all("doc", F.lit(r"(?s)<P>(.*?)</P>"), F.lit(1))
    text = F.array_join(F.transform(paras, lambda p: X.strip_markup(p)), " ")
    x = whole.select(F.regexp_extract("doc", r'nid="?([^">\s]+)', 1).alias("nid"), F.posexplode(X.split_sentences(X.fix_punctuation_spacing(text))).alias("n", "src"))
    return x.select(F.concat_ws("-", "nid", "n").alias("id"), "src", F.col("src").alias("tgt"))


def read_essay_versions(spark: SparkSession, essays: str, corrected: str) -> DataFrame:
    """Essays and corrected files joined on the number their names begin with, first version only."""

    def side(path: str) -> DataFrame:
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        return spark.read.text(path, wholetext=True).select(F.regexp_extract(name, r"^(\d+)", 1).alias("id"), name.alias("file"), F.trim("value").alias("text"))

    first = side(corrected).groupBy("id").agg(F.min_by("text", "file").alias("tgt"))
    return side(essays).join(first, "id").select("id", F.col("text").alias("src"), "tgt")


def read_alternating_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files whose odd lines are sources and even lines their corrections."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("l"))
    n = F.sequence(F.lit(0), F.floor(F.size("l") / 2).cast("int") - 1)
    x = t.where("size(l) > 1").select("file", F.explode(n).alias("i"), "l")
    return x.select(F.concat_ws("#", "file", "i").alias("id"), F.get("l", F.col("i") * 2).alias("src"), F.get("l", F.col("i") * 2 + 1).alias("tgt"))


def adapt_columns(df: DataFrame) -> DataFrame:
    """Any table with a source-like and a correction-like column as id, src, tgt."""
    find = lambda *keys: next((c for k in keys for c in df.columns if k in c.lower()), None)
    src, tgt = find("src", "source", "text", "input"), find("tgt", "target", "correction", "output")
    return df.select((F.col(find("id")) if find("id") else F.monotonically_increasing_id()).cast("string").alias("id"), F.col(src).alias("src"), F.col(tgt).alias("tgt"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary dump lines: lemma, lang, pos, first gloss, first example (string or object); no gloss, no entry."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda p, t="string": F.expr(f"try_variant_get(v, '{p}', '{t}')")
    example = F.coalesce(get("$.senses[0].examples[0].text"), get("$.senses[0].examples[0]"))
    x = v.select(get("$.word").alias("lemma"), F.lower(get("$.lang_code")).alias("lang"), get("$.pos").alias("pos"), get("$.senses[0].glosses[0]").alias("gloss"), example.alias("example"))
    return x.where("gloss is not null")


def html_text(c: Column) -> Column:
    """Visible text of an HTML page."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def read_code_points(spark: SparkSession, path: str) -> DataFrame:
    """Normalisation test lines: semicolon fields of hexadecimal code points as strings."""
    rows = spark.read.text(path).where("value not like '#%' and value not like '@%' and trim(value) <> ''")
    text = lambda i: F.array_join(F.transform(F.split(F.split("value", ";")[i], " "), lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")), "")
    return rows.select(*[text(i).alias(n) for i, n in enumerate(("source", "nfc", "nfd", "nfkc", "nfkd"))])


def row_counts(**frames: DataFrame) -> DataFrame:
    """Rows of each named source."""
    out = None
    for name, df in frames.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        out = c if out is None else out.unionByName(c)
    return out
