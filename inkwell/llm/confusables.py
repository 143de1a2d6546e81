"""Text that looks alike but differs in its characters, brought to one form.

The *skeleton* of a text: decompose, replace every character by its prototype from the
look-alike table, decompose again.  Texts with equal skeletons look the same; they form
one class.  The members of a word's class that are spelled in one script with plain
joint characters are its *forms*; a word that is none of them is disguised, and its form
is the one of its class, in the script most of it is in, that the corpus uses most.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.encoding import Decoder, fit_decoder


def _pairs(text: str) -> dict[str, str]:
    return {x[0]: x[1] for x in text.split()}


#: Letters of other scripts, each beside the Latin prototype it looks like.
LOOKALIKES = {
    "CYRILLIC": dict(zip("аеорсухіјѕһԁԛԝґАВЕКМНОРСТУХІЈЅЗкмнтвгпьбдлиз", "aeopcyxijshdqwrABEKMHOPCTYXIJS3kmhtBrnb6dnu3", strict=True)),
    "GREEK": dict(zip("αοινρυκτχγεωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoivpuktxyewABEZHIKMNOPTYX", strict=True)) | _pairs("ϲc ϳj ϹC ͿJ σo ηn"),
    "ARMENIAN": _pairs("օo ոn սu հh ցg զq յj ՏS ԼL ՍU ՕO վu ւi"),
    "CHEROKEE": _pairs("ᎠD ᎡR ᎢT Ꭵi ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG Ꮒh ᏃZ Ꮟb ᏒR ᏔW ᏚS ᏙV ᏞL ᏟC ᏢP ᏦK ᏴB Ꮷd Ꭹy"),
    "LISU": _pairs("ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"),
    "COPTIC": _pairs("ⲟo ⲞO ⲣp ⲢP ⲥc ⲤC ⲬX ⲒI ⲔK ⲕk ⲘM ⲎH ⲚN ⲦT ⲨY ⲩy ⲂB"),
}
#: Letters in no alphabet of the corpus's languages; that one looks like a letter says nothing about the letter.
RARE = _pairs("ԌG ԍg ѵv ѴV ѡw үy ҮY ӏl ӀI ҽe ԚQ ԜW ғf")
#: Latin letters that look like plain ones.
LATIN_TWINS = {"ɡ": "g", "ɑ": "a"}
_TABLE = {c: p for pairs in LOOKALIKES.values() for c, p in pairs.items()} | RARE | LATIN_TWINS
#: Names of signs that show a Latin letter, styled: small capitals, squared, negative circled, tags and so on.
_NAMED = re.compile(r"(?:.* )?(?:LATIN )?(?:LETTER )?(CAPITAL|SMALL|SMALL CAPITAL) (?:LETTER )?([A-Z])")
#: Characters that show nothing.
INVISIBLE = "​‌‍⁠⁡⁢⁣⁤﻿­᠎‎‏‪‫‬‭‮⁦⁧⁨⁩͏؜ᅟᅠㅤ"
_INVISIBLE = set(INVISIBLE)
_STYLES = ("<wide>", "<narrow>", "<font>", "<circle>")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")


@lru_cache(None)
def _plain_style(c: str) -> str | None:
    """The plain letters or digits of a full-width, styled or ligature one; else None."""
    kind = unicodedata.decomposition(c).partition(" ")[0]
    if kind not in _STYLES and kind != "<compat>":
        return None
    plain = unicodedata.normalize("NFKC", c)
    if kind == "<compat>" and not (unicodedata.category(c).startswith("L") and len(plain) > 1 and plain.isalpha()):
        return None
    # a full-width punctuation mark beside full-width letters follows them, alone it is no case
    return plain if plain.isalnum() or kind == "<wide>" else None


@lru_cache(None)
def script(c: str) -> str:
    """LATIN, CYRILLIC, GREEK, another script's name, or '' for a common character."""
    if c in "ªºµ":
        return ""
    name = unicodedata.name(c, "")
    return name.partition(" ")[0] if unicodedata.category(c).startswith("L") else ""


@lru_cache(None)
def prototype(c: str) -> str:
    """What a character looks like: by its decomposition, the table, or the letter its name tells.

    The rule runs over all of Unicode: compatibility forms (full-width, mathematical,
    circled, roman numerals, ligatures) decompose, and what they decompose to is looked up.
    """
    if c in _INVISIBLE:
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    parts = unicodedata.normalize("NFKD", c)
    if parts != c:
        return "".join(p if p == c else prototype(p) for p in parts)
    if c in _TABLE:
        return _TABLE[c]
    name = unicodedata.name(c, "")
    if not c.isascii() and "LATIN" in name and (m := _NAMED.fullmatch(name)):
        return m.group(2) if m.group(1) == "CAPITAL" else m.group(2).lower()
    return c


@lru_cache(None)
def _reverse(home: str) -> dict[str, str]:
    """The letters of a script by the prototype they look like."""
    out: dict[str, str] = {}
    for c, p in LOOKALIKES.get(home, {}).items():
        out.setdefault(p, c)
    return out


def _joins_emoji(text: str, i: int) -> bool:
    before = text[i - 1] if i else ""
    after = text[i + 1] if i + 1 < len(text) else ""
    pictorial = lambda c: bool(c) and (unicodedata.category(c) in ("So", "Sk", "Cn") or c == "️")
    return text[i] == "‍" and pictorial(before) and pictorial(after)


def home_scripts(word: str) -> list[str]:
    """The scripts a word may be in, the likeliest first.

    Letters that look like none of the word's other scripts' decide; where there are
    none, every script of the word is possible: the one of most letters first, then Latin.
    """
    scripts = Counter(s for c in word if (s := script(c)))
    if len(scripts) < 2:
        return list(scripts)
    shared = {p for s in scripts for p in LOOKALIKES.get(s, {}).values()}
    own = Counter(s for c in word if (s := script(c)) and (c not in shared if s == "LATIN" else c not in _TABLE))
    order = sorted(scripts, key=lambda s: (own[s], scripts[s], s == "LATIN"), reverse=True)
    return order[:1] if own[order[0]] > own[order[1]] else order


@lru_cache(100_000)
def spelled(word: str) -> str:
    """The word in its home script as far as the table goes."""
    if any(c in LATIN_TWINS for c in word) and all(ord(c) < 0x180 or c in LATIN_TWINS for c in word):
        return "".join(LATIN_TWINS.get(c, c) for c in word)
    if len({s for c in word if (s := script(c))}) < 2:
        return word
    home = home_scripts(word)[0]
    if home == "LATIN":
        return "".join(c if script(c) in ("", home) else prototype(c) for c in word)
    table = _reverse(home)
    return "".join(c if script(c) in ("", home) else table.get(prototype(c), c) for c in word)


@lru_cache(None)
def _roman(c: str) -> bool:
    return unicodedata.category(c) == "Nl" and unicodedata.normalize("NFKC", c).isascii()


@lru_cache(None)
def _sort_of(c: str) -> str:
    """'!' for a character that may be a case by itself, else its script."""
    if not c.isascii() and (c in _INVISIBLE or c in LATIN_TWINS or unicodedata.category(c) == "Zs" or unicodedata.combining(c) or _plain_style(c) is not None or _roman(c)):
        return "!"
    return script(c)


class _Sorts(dict):
    """What _sort_of tells of each character."""

    def __missing__(self, c: str) -> str:
        got = self[c] = _sort_of(c)
        return got


_SORTS = _Sorts()


def _may_hold_case(text: str) -> bool:
    sorts = set(map(_SORTS.__getitem__, set(text)))
    return "!" in sorts or len(sorts) > 1 + ("" in sorts)


def stands_alone(text: str) -> bool:
    """The one form of each word is the same whatever stands beside the text."""
    return all(_sort_of(c) != "!" for c in set(text))


def plain_characters(text: str) -> str:
    """Joint, visible, unstyled characters and plain spaces; letters stay in their scripts."""
    if text.isascii() or not any(_sort_of(c) == "!" for c in set(text)):
        return text
    out: list[str] = []
    for i, c in enumerate(text):
        if c.isascii():
            out.append(c)
        elif c in _INVISIBLE:
            if _joins_emoji(text, i):
                out.append(c)
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        elif (plain := _plain_style(c)) is not None:
            out.append(plain)
        elif _roman(c) and (text[i - 1 : i].isalpha() or text[i + 1 : i + 2].isalpha()):
            out.append(unicodedata.normalize("NFKC", c))  # a numeral by itself is a sign
        elif unicodedata.combining(c) and out and len(joint := unicodedata.normalize("NFC", out[-1] + c)) == 1:
            out[-1] = joint
        else:
            out.append(c)
    return "".join(out)


def consistent(text: str) -> str:
    """The text in the one form, word by word; a text that holds no case comes back unchanged."""
    if text.isascii() or not _may_hold_case(text):
        return text
    plain = plain_characters(text)
    if all(w.isascii() or spelled(w) == w for w in set(_WORD.findall(plain))):
        return plain
    return _WORD.sub(lambda m: w if (w := m.group()).isascii() else spelled(w), plain)


def odd_words(text: str) -> list[str]:
    """Words that are no form of their class: two scripts, or twins of plain letters."""
    return [w for w in dict.fromkeys(_WORD.findall(text)) if not w.isascii() and (spelled(w) != w or len({s for c in w if (s := script(c))}) > 1)]


def skeleton(text: str) -> str:
    """Equal for texts that look the same: decompose, take prototypes, decompose again."""
    if text.isascii():
        return text
    visible = "".join(c for i, c in enumerate(text) if c not in _INVISIBLE or _joins_emoji(text, i))
    return unicodedata.normalize("NFD", "".join(map(prototype, unicodedata.normalize("NFD", visible))))


_LOOKS = T.StructType([T.StructField("form", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("script", T.StringType())])


@F.pandas_udf(_LOOKS)
def looks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        rows = [(None, None, None) if t is None else (consistent(t), skeleton(t), next(iter(home_scripts(t)), None)) for t in s]
        yield pd.DataFrame(rows, columns=["form", "skeleton", "script"])


def _disguised_texts(df: DataFrame, id_col: str, fields: tuple[str, ...], decoder: Decoder | None, check_garbled: tuple[str, ...]) -> DataFrame:
    """``row_id, field, original, plain, words``: texts that are none of their class's forms, and the words in question."""
    any_rare = F.exists(F.array(*[F.col(f) for f in fields]), lambda t: t.rlike(r"[^\x00-\x7f]"))
    rows = df.select(F.col(id_col).alias("row_id"), *fields).where(any_rare)
    checked = [f for f in check_garbled if f in fields]
    shared = df.sparkSession.sparkContext.broadcast(decoder or fit_decoder(df, *checked)) if checked else None

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                texts = dict(zip(fields, row[1:], strict=True))
                cases = []
                for f, t in texts.items():
                    if t is not None and not t.isascii() and _may_hold_case(t):
                        bare = plain_characters(t)
                        words = odd_words(bare)
                        if words or bare != t:
                            cases.append((row[0], f, t, bare, [{"word": w, "skeleton": skeleton(w), "scripts": home_scripts(w), "near": spelled(w)} for w in words]))
                # decoding is looked into for the few rows that hold a case
                if cases and not any(shared.value.restore(texts[f])[1] for f in checked):
                    out += cases
            yield pd.DataFrame(out, columns=["row_id", "field", "original", "plain", "words"])

    id_type = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInPandas(look, f"row_id {id_type}, field string, original string, plain string, words array<struct<word:string,skeleton:string,scripts:array<string>,near:string>>")


def class_forms(df: DataFrame, fields: tuple[str, ...], wanted: DataFrame) -> DataFrame:
    """``skeleton, forms``: of each wanted class of words, its most frequent form in each script with its count.

    Words are counted first; only the different ones get a skeleton, and only those of
    wanted classes are grouped.
    """
    text = F.explode(F.array(*[F.col(f) for f in fields]))
    word = F.explode(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    words = df.select(text.alias("t")).where("t is not null").select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = words.withColumn("l", looks("word")).where("l.form = word").select("word", "n", "l.skeleton", "l.script")
    best = seen.join(wanted, "skeleton", "left_semi").groupBy("skeleton", "script").agg(F.max(F.struct("n", F.col("word").alias("form"))).alias("top"))
    return best.groupBy("skeleton").agg(F.collect_list(F.struct("script", "top.n", "top.form")).alias("forms"))  # a few scripts


@F.pandas_udf(T.StringType())
def _with_forms(plain: pd.Series, forms: pd.Series) -> pd.Series:
    out = []
    for t, pairs in zip(plain, forms, strict=True):
        table = {p["word"]: p["form"] for p in pairs}
        out.append(_WORD.sub(lambda m: table.get(m.group(), m.group()), t) if table else t)  # noqa: B023
    return pd.Series(out, dtype=object)


def disguised_fields(df: DataFrame, id_col: str, *fields: str, decoder: Decoder | None = None, check_garbled: tuple[str, ...] = ("src", "tgt")) -> DataFrame:
    """``row_id, field, original, form``: every field whose text is not the form of its skeleton class.

    Disguised words are looked up by skeleton among the words of the corpus; a class
    without a member in the word's own script is spelled out by the table.  A letter of
    another script that looks like no letter of the word's own stays, and the text is
    still a case.  Rows of which a field of ``check_garbled`` is garbled are left out:
    what stands there is a matter of decoding.  Null, empty and ASCII texts are never
    cases; equal rows give one row; other columns are not read.
    """
    cases = _disguised_texts(df, id_col, fields, decoder, check_garbled)
    each = cases.select("row_id", "field", "original", "plain", F.explode_outer("words").alias("w")).select("row_id", "field", "original", "plain", "w.*")
    wanted = each.where("skeleton is not null").select("skeleton").distinct()
    named = each.join(class_forms(df, fields, wanted), "skeleton", "left")
    here = F.transform(F.filter("forms", lambda x: F.array_contains("scripts", x["script"])), lambda x: F.struct(x["n"], x["form"]))
    pair = F.when(F.col("word").isNotNull(), F.struct("word", F.coalesce(F.array_max(here)["form"], "near").alias("form")))
    texts = named.groupBy("row_id", "field", "original", "plain").agg(F.collect_set(pair).alias("forms"))
    return texts.select("row_id", "field", "original", _with_forms("plain", "forms").alias("form"))


def lookalike_classes(df: DataFrame, id_col: str, *fields: str) -> DataFrame:
    """Classes of different originals with equal skeletons.

    One row a class with several spellings: ``skeleton_id``, ``form`` (the consistent
    form of its smallest member), ``spellings`` (different originals) and ``fields``
    (occurrences).  Spellings are counted before classes are, so that a text that fills
    a third of all rows is one row when classes meet.
    """
    x = F.explode(F.array(*[F.col(f) for f in fields]))
    texts = df.select(x.alias("t")).where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    seen = texts.withColumn("l", looks("t"))
    classes = seen.groupBy(F.md5(F.col("l.skeleton").cast("binary")).alias("skeleton_id"))
    return classes.agg(F.min("l.form").alias("form"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("fields")).where("spellings > 1")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold fields that hold characters in disguise."""
    gold = spark.read.parquet(f"{sf_dir}/gold_annotations.parquet").select("row_id", "src", "tgt", "aligned")
    return disguised_fields(gold, "row_id", "src", "tgt", "aligned").select("row_id", "field")


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every affected gold field."""
    gold = spark.read.parquet(f"{sf_dir}/gold_annotations.parquet").select("row_id", "src", "tgt", "aligned")
    return disguised_fields(gold, "row_id", "src", "tgt", "aligned").select("row_id", "field", "form")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold texts that look the same and are not."""
    gold = spark.read.parquet(f"{sf_dir}/gold_annotations.parquet").select("row_id", "src", "tgt", "aligned")
    return lookalike_classes(gold, "row_id", "src", "tgt", "aligned")
