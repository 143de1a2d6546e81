"""Bounded samples and the language profile they are sorted by."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "de", "uk", "es", "it", "ru")
#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and is of that this to with from for in at by on are was it not be although because before after".split(),
    "de": "der die das und ist nicht ein eine den dem bei aus hinter mit von in zum zur vor weil obwohl aber denn auf sehr".split(),
    "uk": "і й та що не на це є у ї від із біля з до зі бо хоча про уже дуже за через разом цього".split(),
    "es": "el la los las de que y una un no en por con cerca según antes este del al porque aunque muy junto sin".split(),
    "it": "il lo di che non è la per una e dopo del con della perché così si fa in mia nostro piccolo come gli ogni".split(),
    "ru": "и что не на это в с как из возле для по из-за вместе очень так потому ещё моя мой наша старый через уже раз".split(),
}
_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_IN = {w: [l for l in LANGS if w in FUNCTION_WORDS[l]] for l in LANGS for w in FUNCTION_WORDS[l]}
#: Languages of each function word, and its share for each.
_OF = {w: tuple((l, 1 / len(of)) for l in of) for w, of in _IN.items()}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def profile(text: str) -> str | None:
    """Language with the most function words, or None without a clear winner."""
    score: dict[str, float] = {}
    for of in filter(None, map(_OF.get, words(text))):
        for l, share in of:
            score[l] = score.get(l, 0) + share
    if len(score) < 2:
        return next(iter(score), None)
    top = max(score.values())
    best = [l for l, n in score.items() if n == top]
    return best[0] if len(best) == 1 else None


def bounded_texts(df: DataFrame, text: Column, size: int, seed: int = 7) -> list[str]:
    """At most ``size`` distinct texts, spread over all rows; one shuffle of ``size`` rows.

    The rows' hash space is cut into ``size`` cells and each cell keeps the text with
    the smallest second hash; partial aggregation leaves at most ``size`` rows a task.
    The bound does not depend on the number of rows, so it may be collected; the texts
    come in the order of their cells, which has nothing to do with what they say.
    """
    rows = df.select(text.alias("t")).where("t is not null and trim(t) <> ''")
    cells = rows.groupBy(F.pmod(F.xxhash64("t"), F.lit(size)).alias("cell")).agg(F.min_by("t", F.xxhash64(F.lit(seed), "t")).alias("t"))
    return [r.t for r in sorted(cells.collect())]
