"""Texts that lost their end.

1. *Near-copies.*  Five-word shingles, min-hash signatures and bands bring texts together
   whose shingles agree to 0.8; a text that belongs to a row's own fields (an inline
   alignment beside its source and target) is a pair from the start.  The texts of the
   bucket are verified by shingle containment and aligned, every open-ended one with every
   other; the copy whose alignment ends early is cut.
2. *Terminality.*  A text without such a partner is judged by its closing word: how often
   do this word, in this context, and longer words that begin with it, end a sentence
   and how often do they go on, over all texts of the table?

Hot groups: equal texts count once, by digest.  The distinct texts of a bucket meet in cells
of a bounded size, so a task holds no more than one cell; the pairs of a bucket grow with the
square of its distinct texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import accumulate, chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.confusables import consistent, stands_alone
from inkwell.llm.shingles import SHINGLE, SIMILARITY, bands, hashes, shingle_hashes, word_hashes
from inkwell.operators.lineage import cut as stored

#: Texts of a cell, and of those that ask in it; larger buckets have several cells.
CELL = 2048
#: Parts of texts that one Python worker remembers; emptied when full.
REMEMBERED = 100_000
#: Share of going on from which an ending counts as cut, and the share taken before anything is counted.
GOES_ON, PRIOR = 0.6, 0.1
#: What goes before any count weighs in observations: before the word's, the context's, the word's in its context.
WIDER = (0.5, 3, 0.5)
_EDIT = re.compile(r"\{([^{}]*?)=>([^{}]*?)\}")
_DOTS = re.compile(r"(?:\s*(?:\.\.+|…+))+\s*$")
_CLOSERS = "\"'”’»“)]}*_ \n\t\r"
_OPEN_CLOSE = {"“": "”", "«": "»", "„": "“", "(": ")", "[": "]", "{": "}", "‚": "‘"}
_WORD = re.compile(r"\w+")
_ASCII_SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_SENTENCE_END = re.compile(r"[\"'”’»“)\]}*_]*(?:[.!?](?!\w)|[ \t]*[\r\n])|\"\s*[,}\]]")
_EDGE = "\"'“”„«»‚‘’.,;!?…()[]{}<>*|"
#: How a JSON object or list begins.
_JSON = re.compile(r"\[\s*[\[\"'{]|\{\s*\"[^\"]*\"\s*:")
_BEFORE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def project(aligned: str, side: int) -> str:
    """Source (1) or target (2) side of an inline alignment; an edit cut short counts as far as it goes."""
    if "{" not in aligned:
        return aligned
    text = _EDIT.sub(lambda m: m.group(side), aligned)
    head, brace, tail = text.rpartition("{")
    if brace and "}" not in tail:
        old, arrow, new = tail.partition("=>")
        text = head + (old.rstrip("=") if side == 1 or not arrow else new)
    return text


class _Parts(dict):
    """What is made of each part of a text between spaces; of short parts it is remembered."""

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> object:
        got = self.make(part)
        if len(part) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = got
        return got


def _letters(text: str) -> str:
    return "".join(filter(str.isalnum, consistent(text).casefold()))


# a part whose characters may change with what is beside them has no letters of its own
_letters_of = _Parts(lambda part: _letters(part) if stands_alone(part) else None)
_words_of = _Parts(lambda part: tuple(_WORD.findall(part.lower())))


def letters(text: str) -> str:
    """What alignment compares: letters and digits in one form and case."""
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_SIGNS).decode()
    try:
        return "".join(map(_letters_of.__getitem__, text.split(" ")))
    except TypeError:
        return _letters(text)


def _words(text: str) -> list[str]:
    return list(chain.from_iterable(map(_words_of.__getitem__, text.split(" "))))


def _undotted(text: str) -> str:
    """The text without dots that stand for more; most texts end otherwise and are not searched."""
    return _DOTS.sub("", text) if text.rstrip().endswith(("..", "…")) else text


def _core(token: str) -> str:
    return token.strip(_EDGE)


def ending(text: str) -> tuple[tuple[str, str], str, str] | None:
    """(two words before, last word, how it ends): 'cut' for sure, 'open' without a mark; None when finished."""
    t = text.strip()
    bare = _undotted(t)
    dotted = bare != t
    if not bare:
        return None
    if _JSON.match(bare):
        return None if bare[-1] in "}]" and not dotted else (("", ""), "", "cut")
    if bare[-1] in "}]" and _EDIT.search(bare[bare.rfind("{") :] or ""):
        bare = project(bare, 2).rstrip() if project(bare, 2).strip() else project(bare, 1)
    opens = _unclosed(bare)
    end = bare.rstrip(_CLOSERS)
    if not any(map(str.isalnum, end)):
        return None  # signs that stand for an empty text
    tokens = bare.split()
    last = _core(tokens[-1]) or tokens[-1]
    before = ("", "", *map(_core, tokens[-3:-1]))[-2:]
    ordinal = bool(re.fullmatch(r"\d+\.", tokens[-1]))
    if end[-1] in ".!?" and not dotted and not ordinal:
        return None
    return before, last, "cut" if opens else "open"


def _unclosed(text: str) -> bool:
    """A quotation or bracket opened last and not closed again."""
    for o, c in _OPEN_CLOSE.items():
        at = text.rfind(o)
        if at >= 0 and c not in text[at + 1 :] and not (o == "“" and text.count("„") > text[:at].count("“")):
            return True
    return False


def ends_early(short: str, full: str) -> bool:
    """The letters of ``short`` run along ``full`` and stop before its end."""
    a, b = letters(short), letters(full)
    return len(a) < len(b) and len(a) >= 1 and b.startswith(a)


class Copy:
    """A text as near-copies are compared."""

    def __init__(self, text: str) -> None:
        self.text = project(text, 2)

    @cached_property
    def letters(self) -> str:
        return letters(self.text)

    @cached_property
    def words(self) -> list[str]:
        return _words(self.text)

    @cached_property
    def shingles(self) -> set[int]:
        return set(shingle_hashes(self.words).tolist())

    def sentence_ends(self, at: int) -> bool:
        """A sentence, line or JSON string ends behind the first ``at`` letters."""
        return bool(_SENTENCE_END.match(self.text, self._place(at)))

    def _place(self, at: int) -> int:
        """Where in the text its first ``at`` letters end."""
        return bisect_left(range(len(self.text)), at, key=lambda i: len(letters(self.text[:i])))


class Asking(Copy):
    """An open-ended text; its last word may be cut."""

    def __init__(self, text: str) -> None:
        super().__init__(_undotted(project(text, 2)))
        #: Texts that it was compared with; buckets of one task share many.
        self.tried: set[int] = set()

    @cached_property
    def inner(self) -> set[int]:
        return set(shingle_hashes(self.words[:-1]).tolist()) if len(self.words) > SHINGLE else set()

    @cached_property
    def end(self) -> str:
        return letters("".join(self.words[-SHINGLE - 1 :]))

    def goes_on_in(self, full: Copy) -> bool:
        """``full`` has 0.8 of the shingles, and goes on where this text ends.

        Either the letters open ``full``, or its last words are in ``full`` with 0.8 of
        the shingles before them and no end of a sentence behind, so that earlier
        differences do not matter.
        """
        at = full.letters.find(self.end)
        if not self.inner or at < 0 or at + len(self.end) == len(full.letters):
            return False
        least = SIMILARITY * len(self.inner)
        if len(self.inner & full.shingles) < least:
            return False
        if full.letters.startswith(self.letters):
            return True
        while at >= 0 and at + len(self.end) < len(full.letters):
            before = _WORD.findall(full.text.lower()[: full._place(at + len(self.end))])
            if len(self.inner.intersection(shingle_hashes(before).tolist())) >= least and not full.sentence_ends(at + len(self.end)):
                return True
            at = full.letters.find(self.end, at + 1)
        return False


_copy, _asking = lru_cache(20_000)(Copy), lru_cache(5_000)(Asking)


def _early_in_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of sorted ``tbl, band, a, b, text_id, asks, text`` rows that another text of their cell goes on from."""
    found: set[tuple[str, int]] = set()
    for (tbl, *_), cell in groupby((r for f in frames for r in zip(*(f[c].tolist() for c in f), strict=True)), key=itemgetter(0, 1, 2, 3)):
        members = list(cell)
        full = [(r[4], _copy(r[6])) for r in members if not r[5]]
        # the letters of all texts of the cell in one string, so that an ending is looked for in all at once
        joined = "\n".join(c.letters for _, c in full)
        starts = [0, *accumulate(len(c.letters) + 1 for _, c in full)]
        for r in members:
            if r[5] and (tbl, r[4]) not in found:
                asking = _asking(r[6])
                at = joined.find(asking.end) if asking.end else -1
                while at >= 0:
                    j = bisect_right(starts, at) - 1
                    if full[j][0] != r[4] and full[j][0] not in asking.tried:
                        if asking.goes_on_in(full[j][1]):
                            found.add((tbl, r[4]))
                            break
                        if len(asking.tried) < CELL:
                            asking.tried.add(full[j][0])
                    at = joined.find(asking.end, starts[j + 1])
        if len(found) > 10_000:
            yield pd.DataFrame(sorted(found), columns=["tbl", "text_id"])
            found.clear()
    yield pd.DataFrame(sorted(found), columns=["tbl", "text_id"])


def _context(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number for the two words (given by their hashes) that stand before a word."""
    with np.errstate(over="ignore"):
        return (before * _BEFORE[0] + last * _BEFORE[1]).view(np.int64)


def _alone(word: np.ndarray) -> np.ndarray:
    """The number under which a word is counted without its context."""
    with np.errstate(over="ignore"):
        return ((word ^ (word >> np.uint64(32))) * _BEFORE[0] + np.uint64(1)).view(np.int64)


def _count_words(texts: list[str]) -> pd.DataFrame:
    """Counts of (context, word) closing a sentence (kind 0), going on (1), last without a mark (2)."""
    tokens = [project(t, 2).split() for t in texts]
    n = np.array([len(t) for t in tokens if t], np.int64)
    if not len(n):
        return pd.DataFrame({"context": [], "word": [], "alone": [], "kind": [], "n": []})
    code, spelled = pd.factorize(np.array([*chain.from_iterable(tokens), ""], object)[:-1])
    cores = [_core(t) for t in spelled]
    tails = [t.rstrip(_CLOSERS)[-1:] for t in spelled]
    closes = np.array([c in ("!", "?") or (c == "." and not t[:-1].isdigit()) for t, c in zip(spelled, tails, strict=True)])
    dots = np.array([c == "." and t.endswith("..") for t, c in zip(spelled, tails, strict=True)])
    h = word_hashes(cores)[code]
    top = np.cumsum(n) - 1
    start = top - n + 1
    none = np.uint64(hashes[""])
    p1 = np.concatenate(([none], h[:-1]))
    p1[start] = none
    p2 = np.concatenate(([none], p1[:-1]))
    p2[start] = none
    kind = np.where(closes[code], 0, 1)
    last = np.zeros(len(code), bool)
    last[top] = True
    kind[last & (~closes[code] | dots[code])] = 2
    words = np.array([*cores, ""], object)[:-1]
    frames = []
    for alone, context in ((False, _context(p2, p1)), (True, _alone(h))):
        with np.errstate(over="ignore"):
            key = (context.view(np.uint64) * _BEFORE[1] + h) * _BEFORE[0] + kind.astype(np.uint64)
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        frames.append(pd.DataFrame({"context": context[first], "word": words[code[first]], "alone": alone, "kind": kind[first], "n": count}))
    return pd.concat(frames)


def _seen_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for tbl, part in frame.groupby("tbl", sort=False):
            counts = _count_words(part["text"].tolist())
            counts.insert(0, "tbl", tbl)
            yield counts


def _own_form(text: str, own: list[str | None]) -> tuple[bool, bool]:
    """(ends before one of its own other forms, is as long as one)."""
    early = whole = False
    for side, full in zip((1, 2), own, strict=False):
        if full:
            mine = _undotted(project(text, side))
            if ends_early(mine, full):
                early = True
            elif letters(mine) == letters(full):
                whole = True
    return early and not whole, whole


def text_states(records: DataFrame, judge: Callable[..., str | None] | None = None, *judged: str) -> DataFrame:
    """What one pass reads off each text: how it ends, the numbers of its context, its bands.

    ``judge`` is called with the values of the columns ``judged`` of every row, also of
    those without a text, and gives the column ``kind``.
    """

    def state(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) and t.strip() else "" for t in frame["text"]]
            found = bands([_words(project(t, 2)) for t in texts])
            ends = [ending(t) if t else None for t in texts]
            sure, open_ = [], []
            for t, end, own in zip(texts, ends, frame["own"], strict=True):
                cut, whole = bool(end and end[2] == "cut"), False
                if end and not cut and own is not None:
                    cut, whole = _own_form(t, own)
                sure.append(cut)
                open_.append(bool(end) and not cut and not whole)
            asked = [e if o else (("", ""), None, "") for e, o in zip(ends, open_, strict=True)]
            p2, p1, w = (word_hashes(x) for x in ([e[0][0] for e in asked], [e[0][1] for e in asked], [e[1] or "" for e in asked]))
            kinds = [judge(*v) for v in zip(*(frame[c] for c in judged), strict=True)] if judge else None
            yield pd.DataFrame({
                "tbl": frame["tbl"], "row_id": frame["row_id"], "text_id": frame["text_id"], "sure": sure, "open": open_,
                "context": _context(p2, p1), "word": [e[1] for e in asked], "alone": _alone(w), "bands": found, "kind": kinds,
            })

    id_type = records.schema["row_id"].dataType.simpleString()
    rows = records.select("tbl", "row_id", "text", "own", F.xxhash64("text").alias("text_id"), *judged)
    return rows.mapInPandas(state, f"tbl string, row_id {id_type}, text_id bigint, sure boolean, open boolean, context bigint, word string, alone bigint, bands array<bigint>, kind string")


def cut_texts(records: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """``tbl, row_id`` of the cut texts among ``tbl, row_id, text, own`` records.

    ``own`` holds the texts the record repeats in another form (or is empty).  Null and
    empty texts are no cases, and neither is a finished text without a final mark;
    repeated rows are judged alike; texts of any length are read whole.  A text of fewer
    than five words has no five-word shingle, so it has no near-copy and its closing
    words decide.  ``states`` are the stored ``text_states`` of the records, where the
    caller has them.
    """
    rows = records.select("tbl", "row_id", "text", "own").where("text is not null and trim(text) <> ''").withColumn("text_id", F.xxhash64("text"))
    states = states if states is not None else stored(text_states(records))
    sure = states.where("sure").select("tbl", "row_id")
    open_ = states.where("open")
    early = open_.join(_early_texts(rows, states), ["tbl", "text_id"], "left_semi").select("tbl", "row_id")

    # terminality of the others
    counted = rows.select("tbl", "text").mapInPandas(_seen_words, "tbl string, context bigint, word string, alone boolean, kind int, n bigint")
    wanted = open_.groupBy("tbl", "context", "word", "alone").agg(F.count(F.lit(1)).alias("n_self"))
    contexts = wanted.select("tbl", "context").union(wanted.select("tbl", "alone")).distinct()
    known = stored(counted.groupBy("tbl", "context", "word", "alone", "kind").agg(F.sum("n").alias("n")).join(contexts, ["tbl", "context"], "left_semi"))
    n_of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    in_context, single = known.where("not alone"), known.where("alone")
    exact = in_context.groupBy("tbl", "context", "word").agg(n_of(0).alias("ends"), n_of(1).alias("on"), n_of(2).alias("last"))
    longer = in_context.select("tbl", "context", "n", F.explode(F.expr("transform(sequence(1, greatest(1, length(word) - 1)), k -> left(word, k))")).alias("prefix"), "word").where("prefix <> word")
    longer = longer.groupBy("tbl", "context", F.col("prefix").alias("word")).agg(F.sum("n").alias("longer"))
    whole = in_context.groupBy("tbl", "context").agg(n_of(0).alias("c_ends"), n_of(1).alias("c_on"))
    single = single.groupBy("tbl", F.col("context").alias("alone")).agg(n_of(0).alias("w_ends"), n_of(1).alias("w_on"))
    x = wanted.join(exact, ["tbl", "context", "word"], "left").join(longer, ["tbl", "context", "word"], "left").join(whole, ["tbl", "context"], "left").join(single, ["tbl", "alone"], "left").na.fill(0)
    ends = F.col("ends") + F.greatest(F.col("last") - F.col("n_self"), F.lit(0)) + F.when(F.col("n_self") > 1, F.col("n_self") - 1).otherwise(0)
    going = F.lit(PRIOR)
    for on, over, weight in ((F.col("w_on"), F.col("w_ends"), WIDER[0]), (F.col("c_on"), F.col("c_ends"), WIDER[1]), (F.col("on") + F.col("longer"), ends, WIDER[2])):
        going = (on + weight * going) / (on + over + weight)
    cut_ends = x.where(going > GOES_ON).select("tbl", "context", "word")
    by_word = open_.join(cut_ends, ["tbl", "context", "word"], "left_semi").select("tbl", "row_id")
    return sure.unionByName(early).unionByName(by_word).distinct()


def _early_texts(rows: DataFrame, states: DataFrame) -> DataFrame:
    """``tbl, text_id`` of the open-ended texts that a near-copy goes on from."""
    banded = states.select("tbl", "text_id", "open", F.explode("bands").alias("band"))
    buckets = banded.groupBy("tbl", "band").agg(F.max("open").alias("any_open"), F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("any_open and lo <> hi")
    members = stored(banded.join(buckets.select("tbl", "band"), ["tbl", "band"], "left_semi").groupBy("tbl", "band", "text_id").agg(F.max("open").alias("open")))
    n_cells = lambda n: F.ceil(n / CELL).cast("int")
    sizes = members.groupBy("tbl", "band").agg(n_cells(F.count(F.lit(1))).alias("as"), n_cells(F.count_if("open")).alias("bs"), F.min("text_id").alias("lo"))
    own = lambda n: F.pmod(F.xxhash64("text_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = members.join(sizes, ["tbl", "band"])
    having = sized.select("tbl", "lo", "band", own("as").alias("a"), every("bs").alias("b"), "text_id", F.lit(False).alias("asks"))
    asking = sized.where("open").select("tbl", "lo", "band", every("as").alias("a"), own("bs").alias("b"), "text_id", F.lit(True).alias("asks"))
    texts = rows.groupBy("tbl", "text_id").agg(F.first("text").alias("text"))
    cells = having.unionByName(asking).join(texts, ["tbl", "text_id"])
    # buckets that begin with the same text share others, too: they are read one after the other
    cells = cells.repartition("tbl", "lo", "a", "b").sortWithinPartitions("tbl", "lo", "band", "a", "b").select("tbl", "band", "a", "b", "text_id", "asks", "text")
    return cells.mapInPandas(_early_in_cells, "tbl string, text_id bigint").distinct()


def answer_records(ensemble: DataFrame, *kept: str) -> DataFrame:
    return ensemble.select(F.lit("ensemble").alias("tbl"), "row_id", F.col("reasoning").alias("text"), F.lit(None).cast("array<string>").alias("own"), *kept)


def alignment_records(gold: DataFrame) -> DataFrame:
    return gold.select(F.lit("gold_annotations").alias("tbl"), "row_id", F.col("aligned").alias("text"), F.array("src", "tgt").alias("own"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut answers and alignments."""
    ensemble, gold = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("ensemble", "gold_annotations"))
    return cut_texts(answer_records(ensemble).unionByName(alignment_records(gold)))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's answers and each source's alignments are cut."""
    ensemble, gold = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("ensemble", "gold_annotations"))
    origin = ensemble.select(F.lit("ensemble").alias("tbl"), "row_id", F.col("model").alias("origin")).unionByName(gold.select(F.lit("gold_annotations").alias("tbl"), "row_id", F.col("source").alias("origin")))
    marked = origin.join(p3_found(spark, sf_dir).withColumn("hit", F.lit(1)), ["tbl", "row_id"], "left")
    return marked.groupBy("tbl", "origin").agg(F.count(F.lit(1)).alias("texts"), F.count("hit").alias("cut"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))
