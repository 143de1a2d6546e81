"""Word alignment of a pair and its inline form, as Arrow functions over small helpers."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s+|\w+(?:[’'-]\w+)*|[^\w\s]")


def tokens(text: str) -> list[str]:
    """Words, signs and white space; joined they give the text."""
    return _TOKEN.findall(text)


def diff(src: str, tgt: str) -> list[tuple[str, str]]:
    """(old, new) pieces in order; equal pieces have old == new."""
    a, b = tokens(src), tokens(tgt)
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [("".join(a[:head]),) * 2] if head else []
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    for _, i, j, k, l in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        out.append(("".join(x[i:j]), "".join(y[k:l])))
    if tail:
        out.append(("".join(a[len(a) - tail :]),) * 2)
    return out


def merged(pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Edits that touch, or that only white space parts, become one."""
    out: list[tuple[str, str]] = []
    for old, new in pieces:
        if old == new and old.isspace() and out and out[-1][0] != out[-1][1]:
            out.append((old, new))  # may yet be bridged
        elif old != new and out and out[-1][0] != out[-1][1]:
            out[-1] = (out[-1][0] + old, out[-1][1] + new)
        elif old != new and len(out) > 1 and out[-1][0] == out[-1][1] and out[-1][0].isspace() and out[-2][0] != out[-2][1]:
            gap = out.pop()[0]
            out[-1] = (out[-1][0] + gap + old, out[-1][1] + gap + new)
        else:
            out.append((old, new))
    return out


def smoothed(pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """No edit begins or ends inside a word: letters are pulled in from its neighbours."""
    out = [list(p) for p in pieces]
    for i, (old, new) in enumerate(pieces):
        if old == new:
            continue
        while i and out[i - 1][0] == out[i - 1][1] and out[i - 1][0][-1:].isalnum() and (out[i][0][:1].isalnum() or out[i][1][:1].isalnum()):
            c = out[i - 1][0][-1]
            out[i - 1] = [out[i - 1][0][:-1]] * 2
            out[i] = [c + out[i][0], c + out[i][1]]
        while i + 1 < len(out) and out[i + 1][0] == out[i + 1][1] and out[i + 1][0][:1].isalnum() and (out[i][0][-1:].isalnum() or out[i][1][-1:].isalnum()):
            c = out[i + 1][0][0]
            out[i + 1] = [out[i + 1][0][1:]] * 2
            out[i] = [out[i][0] + c, out[i][1] + c]
    return [(a, b) for a, b in out if a or b]


def inline(src: str, tgt: str) -> str:
    """``text {old=>new} text``; its projections are the two texts."""
    return "".join(a if a == b else f"{{{a}=>{b}}}" for a, b in smoothed(merged(diff(src, tgt))))


def diff_distance(src: str, tgt: str) -> int:
    """Sum over edits of the longer side: an upper bound of the edit distance."""
    return sum(max(len(a), len(b)) for a, b in diff(src, tgt) if a != b)


@F.pandas_udf(T.StringType())
def inline_alignment(src: pd.Series, tgt: pd.Series) -> pd.Series:
    """Null where a side is null."""
    return pd.Series([None if a is None or b is None else inline(a, b) for a, b in zip(src, tgt, strict=True)], dtype=object)


@F.pandas_udf(T.IntegerType())
def word_diff_distance(src: pd.Series, tgt: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else diff_distance(a, b) for a, b in zip(src, tgt, strict=True)], dtype="Int32")


def labelled(aligned: Column, labels: Column) -> Column:
    """``{old=>new:::LABEL}`` for the edits in order; surplus edits stay without a label."""
    parts = F.split(aligned, r"(?<=\})")
    number = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), lambda p: p.endswith("}")))
    done = F.transform(parts, lambda p, i: F.when(p.endswith("}") & (number(i) <= F.size(labels)), F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.lit(":::"), F.get(labels, number(i) - 1), F.lit("}"))).otherwise(p))
    return F.array_join(done, "")


def apply_spans(text: Column, spans: Column) -> Column:
    """Replacements (begin, end, repl), ends exclusive, applied from right to left."""
    back = F.reverse(F.array_sort(spans))
    return F.aggregate(back, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["begin"]), s["repl"], F.substring(acc, s["end"] + 1, F.lit(2**30))))


def first_word_differences(src: Column, tgt: Column, n: int = 5) -> Column:
    """'old -> new' of the first ``n`` words that differ by position."""
    a, b = F.split(src, r"\s+"), F.split(tgt, r"\s+")
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.lit(" -> "), F.coalesce(y, F.lit("")))), lambda p: F.split_part(p, F.lit(" -> "), F.lit(1)) != F.split_part(p, F.lit(" -> "), F.lit(2)))
    return F.array_join(F.slice(pairs, 1, n), "; ")
