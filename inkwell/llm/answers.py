"""Prompt and response pairs without a usable response.

Kinds, in order of precedence: ``empty``, ``refusal``, ``copy``, ``truncated``,
``other_language``.  Copies are found by containment of five-word shingles and verified
by the longest common subsequence of words with the prompt; refusals by aligning each
sentence, slot by slot, with refusal templates (module ``refusals``); cut answers by the
operator for cut texts, whose pass over the texts is shared; the language by words as
they are used in the answers asked for in each language.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.cuts import answer_records, cut_texts, text_states
from inkwell.llm.refusals import refuses
from inkwell.llm.samples import FUNCTION_WORDS
from inkwell.llm.shingles import SHINGLE, SIMILARITY
from inkwell.operators.lineage import cut as stored

#: Answers the word use of each language is counted on, at most.
SAMPLE = 16384
#: Share of an answer's words that the alignment with the prompt must cover.
ALIGNED = 0.9
#: What stands for an answer that is not there, without punctuation.
PLACEHOLDERS = {"", "null", "none", "nan", "na", "n a", "nil", "error", "no response", "no answer", "empty", "undefined", "unknown", "missing", "todo", "tbd", "not available", "leer", "vacío", "порожньо", "keine antwort", "sin respuesta", "немає відповіді"}
#: Words of the prompt around the pair.
FRAME = set("original corrected correction source target sentence sentences suggested suggestion classify the following is src tgt label text input output pair edit classification оригінал виправлено речення джерело satz korrigiert frase corregida oración".split())
_FUNCTION_SETS = {l: frozenset(ws) for l, ws in FUNCTION_WORDS.items()}
_FUNCTION_WORDS = {w: tuple(l for l, ws in _FUNCTION_SETS.items() if w in ws) for ws in _FUNCTION_SETS.values() for w in ws}
_WORD = re.compile(r"\w+")
_VERDICT = re.compile(r"\b(?:TP|TN|FN|FP[123]?)\b")
_LABEL_WORDS = {"tp", "tn", "fn", "fp", "fp1", "fp2", "fp3"}
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“]*“|\"[^\"]*\"")
_SPOKEN = re.compile(r"\b(?!\d+\b)\w+")
_KEY = re.compile(r"\"\w+\"\s*:")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one machine word of bits for a run of ``a``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        if hit := row & places.get(y, 0):
            row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def blank(value: str | None) -> bool:
    """Null, blank, without a letter or digit, or only a placeholder."""
    return value is None or (len(value) < 60 and " ".join(_words(value)) in PLACEHOLDERS) or not any(map(str.isalnum, value))


def no_label(value: str | None) -> bool:
    """As ``blank``; the sentinels Error and API_FAILED are labels."""
    return blank(value) and (value or "").strip().lower() != "error"


def plain(reasoning: str) -> str:
    """The answer's words, out of its JSON where it is one."""
    t = reasoning.strip()
    if t[:1] in "{[":
        try:
            data = json.loads(t)
        except ValueError:
            return _KEY.sub(" ", t)
        if isinstance(data, dict):
            data = [data]
        return " ".join(str(v) for d in data for v in (d.values() if isinstance(d, dict) else [d]) if v is not None)
    return t


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; a shorter text is one shingle."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def _covered(words: list[str], have: set[tuple[str, ...]]) -> int:
    """Words that lie in a shingle of the prompt."""
    lengths = sorted({len(x) for x in have})
    end = n = 0
    for i in range(len(words)):
        for k in lengths:
            if tuple(words[i : i + k]) in have:
                n += i + k - max(end, i)
                end = max(end, i + k)
    return n


def copies(text: str, *prompt: str | None) -> bool:
    """Nothing but the prompt.

    Without the words that frame a prompt, 0.8 of the answer's words lie in shingles of
    the prompt's sides, and the longest common subsequence with the sides, one behind the
    other and again, leaves a tenth of them at most; a label is no copy of anything.  A
    text of fewer than five words is one shingle, so it must stand there as a whole.
    """
    raw, around = _words(text), " ".join(p.lower() for p in prompt if p)
    strange, most = 0, (1 - SIMILARITY) * len(raw)
    for x in raw:  # a word that is nowhere in the prompt's letters is none of its words
        if x not in around and x not in FRAME:
            strange += 1
            if strange > most:
                return False
    sides = [w for p in prompt if p and (w := _words(p))]
    known = {x for s in sides for x in s}
    words = [x for x in raw if x in known or x not in FRAME]
    if not words or not sides:
        return False
    if sum(x in known for x in words) < SIMILARITY * len(words):
        return False  # shingles cover no more than their words do
    if _covered(words, {x for s in sides for x in _shingles(s)}) < SIMILARITY * len(words):
        return False
    twice = [x for s in (*sides, *sides) for x in s]
    rest = len(words) - common_length(words, twice)
    return rest <= max(1, (1 - ALIGNED) * len(words)) and not any(x in _LABEL_WORDS for x in words if x not in known)


@dataclass
class WordUse:
    """Log share of each word in the answers of each language asked for."""

    langs: list[str]
    score: dict[str, tuple[float, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> WordUse:
        langs = sorted({l for l, _ in rows if l})
        counts: dict[str, Counter] = {l: Counter() for l in langs}
        for l, text in rows:
            if l:
                counts[l].update(set(_speech(text)))
        for l in langs:  # function words keep small samples sane
            for w in FUNCTION_WORDS.get(l, ()):
                counts[l][w] += 3
        texts = Counter(l for l, _ in rows if l)
        use = cls(langs)
        for w in {w for c in counts.values() for w in c}:
            share = [(counts[l][w] + 0.02) / (texts[l] + 3) for l in langs]
            use.score[w] = tuple(max(-4.0, math.log(s / max(share))) for s in share)
        return use

    def language(self, text: str, asked: str) -> str | None:
        """A language that speaks for the text clearly more than the one asked for."""
        words = _speech(text)
        foreign = dict.fromkeys(_FUNCTION_SETS, 0)
        for w in filter(_FUNCTION_WORDS.__contains__, words):
            for l in _FUNCTION_WORDS[w]:
                foreign[l] += 1
        total = [sum(x) for x in zip(*filter(None, map(self.score.get, words)), strict=True)] or [0.0] * len(self.langs)
        strange = max((l for l in foreign if l not in self.langs), key=foreign.get, default=None)
        if strange and asked in foreign and foreign[strange] >= 3 and all(foreign[strange] > 1.5 * foreign[l] for l in self.langs if l in foreign):
            return strange
        if asked not in self.langs or not words:
            return None
        best = max(range(len(self.langs)), key=total.__getitem__)
        return self.langs[best] if total[best] - total[self.langs.index(asked)] > 3.0 else None


def _speech(text: str) -> list[str]:
    """Words of the judge's own speech: without quotations, labels and names."""
    own = _VERDICT.sub(" ", _QUOTED.sub(" ", plain(text)))
    return _SPOKEN.findall(own.lower())


def word_use(answers: DataFrame, size: int = SAMPLE) -> WordUse:
    """Word use counted on at most ``size`` answers for each language, one of each cell of the hash space."""
    rows = answers.select("answer_lang", "reasoning").where("trim(reasoning) <> '' and answer_lang is not null")
    cell = F.pmod(F.xxhash64("reasoning"), F.lit(size // 4))
    picked = rows.groupBy("answer_lang", cell.alias("cell")).agg(F.min_by("reasoning", F.xxhash64(F.lit(3), "reasoning")).alias("reasoning"))
    return WordUse.of([(r.answer_lang, r.reasoning) for r in picked.select("answer_lang", "reasoning").collect()])


def defective_answers(answers: DataFrame, use: WordUse | None = None) -> DataFrame:
    """``row_id, defect``: one row for each defective answer.

    Reads ``row_id, src, tgt, tp_fp_label, reasoning, answer_lang``; other columns are
    left alone.  A null reasoning or label is ``empty``; a null prompt side is not
    compared; a null or unknown ``answer_lang`` is never ``other_language``; repeated
    rows are judged alike.  One narrow pass reads the texts for all kinds and for the
    operator of cut texts; only short rows are joined.
    """
    shared = answers.sparkSession.sparkContext.broadcast(use or word_use(answers))

    def judge(src: str | None, tgt: str | None, label: str | None, reasoning: str | None, lang: str | None) -> str | None:
        if no_label(label) or blank(reasoning) or blank(text := plain(reasoning)):
            return "empty"
        if not _VERDICT.search(text) and refuses(text):
            return "refusal"
        if copies(text, src, tgt):
            return "copy"
        return "other_language" if lang and shared.value.language(reasoning, lang.strip().lower()) else None

    prompt = answers.select("row_id", "src", "tgt", "tp_fp_label", "answer_lang", "reasoning")
    records = answer_records(prompt, "src", "tgt", "tp_fp_label", "reasoning", "answer_lang")
    states = stored(text_states(records, judge, "src", "tgt", "tp_fp_label", "reasoning", "answer_lang"))
    kinds = states.where("kind is not null").select("row_id", "kind")
    cut = cut_texts(records, states).select("row_id", F.lit(True).alias("cut"))
    both = kinds.join(cut, "row_id", "full")
    defect = F.when(F.col("kind").isin("empty", "refusal", "copy"), F.col("kind")).when(F.col("cut"), "truncated").otherwise(F.col("kind"))
    return both.select("row_id", defect.alias("defect")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective answers of the judges with their kind of defect."""
    return defective_answers(spark.read.parquet(f"{sf_dir}/ensemble.parquet"))


def p2_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of each model."""
    answers = spark.read.parquet(f"{sf_dir}/ensemble.parquet")
    found = defective_answers(answers)
    return found.join(answers.select("row_id", "model"), "row_id").groupBy("model", "defect").agg(F.count(F.lit(1)).alias("answers"))
