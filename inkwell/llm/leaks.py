"""Passages of held-out material inside a training corpus.

The corpus is indexed shard by shard where it lies: the documents of one Spark task
form one FM-index (Burrows-Wheeler transform, wavelet matrix for ranks, sampled suffix
positions), built and searched in numpy and then dropped.  Every stretch of ten words
of every item is one phrase; all phrases step backwards through the index together.

The letters of the index are words.  Words that no item has are one letter, and only
stretches of ten and more words of the items enter the index: no phrase can end
elsewhere, so this loses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
PHRASE = 10
#: Words of one index and of one block of items: bounds of a task's memory.
SHARD_WORDS, BLOCK_WORDS = 1_000_000, 400_000
#: Every how many text positions the index keeps its place.
SAMPLE_EVERY = 16
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words as they are compared: lower case, without punctuation and spacing."""
    return _WORD.findall(text.lower())


def plain_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, text`` without the opening instruction.

    An instruction ends in the item's first colon, has no end of a sentence before it,
    and opens several items that go on differently; equal items have no instruction.
    """
    parts = [F.regexp_extract(text, r"(?s)^([^:.!?…]*:)(.*)$", g) for g in (1, 2)]
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"), parts[0].alias("head"), parts[1].alias("rest"))
    common = rows.where("head <> ''").groupBy("head").agg((F.min("rest") < F.max("rest")).alias("instruction")).where("instruction")
    return rows.join(common, "head", "left").select("item_id", F.when(F.col("instruction"), F.col("rest")).otherwise(F.col("text")).alias("text"))


class Wavelet:
    """Ranks over a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, letters: int) -> None:
        self.bits = max(1, int(letters - 1).bit_length())
        self.zeros: list[int] = []
        self.ones: list[np.ndarray] = []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(cur) - self.ones[-1][-1]))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def rank(self, letter: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each letter before each position."""
        lo, hi = np.zeros_like(upto), upto
        for level, zeros, ones in zip(range(self.bits - 1, -1, -1), self.zeros, self.ones, strict=True):
            bit = ((letter >> level) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            hi = np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling the compared length."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over one shard's words."""

    def __init__(self, seq: np.ndarray, letters: int) -> None:
        n = len(seq)
        order = suffix_order(seq)
        self.last = seq[order - 1]  # the letter before each suffix
        self.less = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=letters)))).astype(np.int64)
        self.wavelet = Wavelet(self.last, letters)
        self.size = n
        self.kept = order % SAMPLE_EVERY == 0
        self.kept_rank = np.concatenate(([0], np.cumsum(self.kept)))
        self.places = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open ranges of the suffixes that begin with each phrase (rows of letters)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j]
            a = self.less[c] + self.wavelet.rank(c, lo[alive])
            b = self.less[c] + self.wavelet.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[b > a]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back until a kept place, then count forward."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[at])
        while len(todo):
            c = self.last[at[todo]]
            at[todo] = self.less[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[~self.kept[at[todo]]]
        return (self.places[self.kept_rank[at]] + steps) % self.size


@dataclass
class Block:
    """All phrases of some items: rows of letters, and each one's item by its number in ``ids``."""

    phrases: np.ndarray
    item: np.ndarray
    ids: list


def _blocks(rows: Iterator, letter: dict[str, int]) -> Iterator[Block]:
    """Items in blocks of at most BLOCK_WORDS words (or of one longer item); new words get the next letter."""
    ids: list = []
    parts: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    size = 0

    def block() -> Block:
        empty = np.zeros((0, PHRASE), np.int64)
        return Block(np.concatenate([empty, *parts]), np.concatenate([np.zeros(0, np.int64), *owner]), list(ids))

    for item, text in rows:
        seq = np.array([letter.setdefault(w, len(letter) + 2) for w in words(text)], np.int64)
        if len(seq) < PHRASE:
            continue
        if ids and size + len(seq) > BLOCK_WORDS:
            yield block()
            ids, parts, owner, size = [], [], [], 0
        windows = np.lib.stride_tricks.sliding_window_view(seq, PHRASE)
        parts.append(windows)
        owner.append(np.full(len(windows), len(ids)))
        ids.append(item)
        size += len(seq)
    if ids:
        yield block()


def _runs(seq: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of PHRASE and more letters of the items: (first word's number, letters)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (seq > 1).astype(np.int8), [0]))))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= PHRASE:
            yield int(a), seq[a:b]


class Shard:
    """The stretches of some documents with their index, which every block of items is searched in."""

    def __init__(self, letters: int, runs: list[tuple[object, int, np.ndarray]]) -> None:
        gap, end = np.ones(1, np.int64), np.zeros(1, np.int64)
        seq = np.concatenate([x for _, _, r in runs for x in (r, gap)] + [end])  # a last letter of its own
        self.starts = np.cumsum([0, *(len(r) + 1 for _, _, r in runs)])[:-1]
        self.first = np.array([a for _, a, _ in runs], np.int64)
        numbers: dict = {}
        self.doc = np.array([numbers.setdefault(d, len(numbers)) for d, _, _ in runs], np.int64)
        self.docs = list(numbers)
        self.index = FMIndex(seq, letters)

    def spans(self, block: Block) -> pd.DataFrame:
        """doc_id, item_id, first_word, last_word of the merged spans."""
        lo, hi = self.index.search(block.phrases)
        n = hi - lo
        hit = np.flatnonzero(n)
        rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n[hit])[:-1])), n[hit]) + np.arange(int(n[hit].sum()))
        place = self.index.locate(rows)
        run = np.searchsorted(self.starts, place, side="right") - 1
        # the first word's number in the document: the stretch's own number plus the offset in it
        first = place - self.starts[run] + self.first[run]
        x = pd.DataFrame({"doc": self.doc[run], "item": block.item[np.repeat(hit, n[hit])], "first_word": first}).sort_values(["doc", "item", "first_word"])
        new = (x[["doc", "item"]].diff().fillna(1) != 0).any(axis=1) | (x["first_word"].diff() > PHRASE)
        spans = x.groupby(new.cumsum().to_numpy()).agg(doc=("doc", "first"), item=("item", "first"), first_word=("first_word", "min"), last_word=("first_word", "max"))
        spans["last_word"] += PHRASE - 1
        spans.insert(0, "doc_id", pd.Series([self.docs[d] for d in spans.pop("doc")], index=spans.index, dtype=object))
        spans.insert(1, "item_id", [block.ids[i] for i in spans.pop("item")])
        return spans


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, first_word, last_word``: every passage of an item in a document.

    A passage is ten and more consecutive words, compared without case, punctuation and
    spacing; words are numbered from 0; overlapping phrases of one item are one span.
    The items are the stated query set: they go out in blocks of at most BLOCK_WORDS
    words, and a task reads one block after the other into the index of its shard, so
    the documents are read and indexed once.  Null, empty and short texts on either side
    give nothing; ids are of any type; repeated items and documents give a span each;
    other columns are not read.  Narrow on the documents' side: no shuffle.
    """
    sc = docs.sparkSession.sparkContext
    letter: dict[str, int] = {}
    sent = [sc.broadcast(b) for b in _blocks(((r[0], r[1]) for r in plain_items(items, item_id, text).toLocalIterator()), letter)]
    letters = sc.broadcast(letter)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    doc_type = kept.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {items.schema[item_id].dataType.simpleString()}, first_word bigint, last_word bigint"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, runs, size = letters.value.get, [], 0
        for batch in batches:
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                seq = np.fromiter((find(w, 1) for w in words(t)), np.int64)
                for first, r in _runs(seq):
                    runs.append((d, first, r))
                    size += len(r) + 1
                if size >= SHARD_WORDS:
                    shard = Shard(len(letters.value) + 2, runs)
                    yield from (shard.spans(b.value) for b in sent)
                    runs, size = [], 0
        if runs:
            shard = Shard(len(letters.value) + 2, runs)
            yield from (shard.spans(b.value) for b in sent)

    return kept.mapInPandas(search, schema)


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to remove from each document, and the item each comes from."""
    return leaked_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark_items.parquet"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a passage of a held-out item, and the item."""
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out items by the number of documents they leaked into."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
