"""Subject areas of documents from mined class-association rules.

1. Sentences of hand-labelled documents are transactions: their telling words and the
   document's subject.  Parallel frequent-pattern growth (``pyspark.ml.fpm.FPGrowth``)
   mines word sets with and without a subject, so every frequent word set has a count
   for each subject.
2. A set is redundant when its distribution over subjects is that of one of its own
   subsets; only the others stay.  A set spread over all subjects stays where it corrects
   a narrower belief ("prescribes" is medicine, "prescribes more patience" is nothing).
3. A sentence takes the evidence of the most specific rules that match it.  The sentence
   counts for a subject above a calibrated evidence, and a document has the subjects that
   hold a calibrated share of its sentences; both are the values that agree best with
   the labels of sample documents that were kept out of the mining.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, product

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.lineage import cut

#: Labelled documents the rules are mined from and calibrated on, at most about this many; one in HELD is kept for calibration.
LABELLED, HELD = 4000, 4
#: What calibration chooses from: evidence of a sentence; share of a document's sentences; sentences asked for on top.
EVIDENCE, SHARE, EXTRA = (0.4, 0.5, 0.6, 0.7), (0.1, 0.12, 0.15, 0.18, 0.2, 0.22, 0.25), (0.0, 0.25, 0.5, 0.75, 1.0)
#: Words of the largest rule.
LONGEST = 3
#: Share of a word's sentences that its first subject needs for the word to be an item.
TELLING = 0.4
_SENTENCE = re.compile(r"(?<=[.!?…])[\s“”»«\"]+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CLASS = "\x00"  # marks a subject among the items


def sentences(text: str) -> list[frozenset[str]]:
    """The word sets of a text's sentences; those without words are left out."""
    return [w for s in _SENTENCE.split(text.lower()) if s and (w := frozenset(_WORD.findall(s)))]


class Node:
    """A word of a rule; the rules that go on with a later word are below it."""

    __slots__ = ("below", "spread")

    def __init__(self) -> None:
        self.below: dict[int, Node] = {}
        self.spread: tuple[float, ...] | None = None


def prefix_tree(table: dict[tuple[int, ...], tuple[float, ...]]) -> Node:
    root = Node()
    for words, spread in table.items():
        node = root
        for w in words:
            node = node.below.setdefault(w, Node())
        node.spread = spread
    return root


@dataclass
class Rules:
    """Word sets with their distribution over subjects, and what calibration found."""

    subjects: list[str]
    items: dict[str, int]
    table: dict[tuple[int, ...], tuple[float, ...]]
    evidence: float = 0.5
    share: float = 0.25
    extra: float = 0.0
    memo: dict[frozenset[int], int] = field(default_factory=dict)
    tree: Node | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "tree": None}

    def belief(self, ids: frozenset[int]) -> tuple[float, ...] | None:
        """Mean distribution of the longest rules whose words all occur; None if none does.

        The rules are a tree of words in order, walked along the sentence's words: the
        work is that of the rules' prefixes that occur, whatever the sentence's length.
        """
        self.tree = self.tree or prefix_tree(self.table)
        longest: list[tuple[float, ...]] = []
        level = [self.tree]
        while level:
            level = [n.below[w] for n in level for w in (n.below.keys() & ids if len(n.below) > len(ids) else [w for w in n.below if w in ids])]
            longest = [n.spread for n in level if n.spread is not None] or longest
        return tuple(sum(x) / len(longest) for x in zip(*longest, strict=True)) if longest else None

    def best(self, words: frozenset[str]) -> tuple[int, float]:
        """Number of the sentence's likeliest subject with its evidence, or (-1, 0)."""
        ids = frozenset(self.items[w] for w in words if w in self.items)
        got = self.memo.get(ids)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            b = self.belief(ids) if ids else None
            k = max(range(len(b)), key=b.__getitem__) if b else -1
            got = self.memo[ids] = (k, b[k] if b else 0.0)
        return got

    def counts(self, text: str, evidence: float | None = None) -> tuple[list[int], int]:
        """Sentences of each subject, and all sentences."""
        least = self.evidence if evidence is None else evidence
        out, n = [0] * len(self.subjects), 0
        for s in sentences(text):
            n += 1
            k, e = self.best(s)
            if k >= 0 and e >= least:
                out[k] += 1
        return out, n

    def decide(self, counts: list[int], n: int, share: float | None = None, extra: float | None = None) -> list[str]:
        """Subjects with their share of the sentences and what is asked for on top, of the ``n`` there are at most."""
        least = min(n, (self.share if share is None else share) * n + (self.extra if extra is None else extra))
        return [s for s, c in zip(self.subjects, counts, strict=True) if c and c >= least]


def _prune(sets: dict[tuple[int, ...], list[int]], subjects: int) -> dict[tuple[int, ...], tuple[float, ...]]:
    prior = [1.0 / subjects] * subjects
    spread = {k: tuple((c + 2 * p) / (sum(v) + 2) for c, p in zip(v, prior, strict=True)) for k, v in sets.items()}
    kept: dict[tuple[int, ...], tuple[float, ...]] = {}
    for k in sorted(spread, key=len):
        subsets = [kept[s] for m in range(1, len(k)) for s in combinations(k, m) if s in kept]
        if not subsets or all(max(abs(a - b) for a, b in zip(spread[k], s, strict=True)) > 0.1 for s in subsets):
            kept[k] = spread[k]
    return kept


def mine_rules(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, support: float = 0.0004, least_sets: int = 4) -> Rules:
    """Rules from at most about ``limit`` labelled documents, chosen by the hash of their id.

    The thresholds are calibrated on documents kept out of a first mining; the rules are
    then mined from all.  Sentences are counted and mined as tables; what reaches the
    driver is the words that tell a subject, the rules and a table of calibration, all
    bounded by ``limit``.
    """
    marked = labels.where("subject is not null and doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    every = max(1, -(-marked.count() // limit))
    sample = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    held = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(HELD)) == 0
    texts = cut(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "subjects", held.alias("held")))
    subjects = [r.s for r in sample.select(F.explode("subjects").alias("s")).distinct().sort("s").collect()]
    trial = _mine(texts.where("not held"), subjects, support, least_sets)
    _calibrate(trial, texts.where("held").select("text", "subjects"))
    rules = _mine(texts, subjects, support, least_sets)
    rules.evidence, rules.share, rules.extra = trial.evidence, trial.share, trial.extra
    return rules


def _mine(texts: DataFrame, subjects: list[str], support: float, least_sets: int) -> Rules:
    """Rules from ``text, subjects`` rows; documents of one subject alone tell what its sentences look like."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(list(w), of[0]) for t, of in zip(frame["text"], frame["subjects"], strict=True) for w in sentences(t)], columns=["words", "subject"])

    single = texts.where("size(subjects) = 1").select("text", "subjects").mapInPandas(split, "words array<string>, subject string")
    single = cut(single)
    n = single.count()
    least = max(least_sets, support * n)
    by = single.select(F.explode("words").alias("word"), "subject").groupBy("word", "subject").agg(F.count(F.lit(1)).alias("c"))
    telling = by.groupBy("word").agg(F.sum("c").alias("all"), F.max("c").alias("top")).where((F.col("all") >= least) & (F.col("top") >= TELLING * F.col("all")))
    items = {r.word: i for i, r in enumerate(telling.select("word").sort("word").collect())}
    rules = Rules(subjects, items, {})
    if not items:
        return rules
    known = texts.sparkSession.sparkContext.broadcast(items)

    def basket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [[w for w in ws if w in known.value] for ws in frame["words"]]
            yield pd.DataFrame({"items": [[*sorted(r), CLASS + s] for r, s in zip(rows, frame["subject"], strict=True) if r]})

    baskets = cut(single.mapInPandas(basket, "items array<string>"))
    size = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / size), minConfidence=1.0).fit(baskets)
    mined = model.freqItemsets.where(F.size("items") <= LONGEST + 1)
    number = {s: k for k, s in enumerate(subjects)}
    sets: dict[tuple[int, ...], list[float]] = {}
    totals: dict[tuple[int, ...], int] = {}
    for r in mined.collect():
        k = tuple(sorted(items[w] for w in r.items if not w.startswith(CLASS)))
        of = [w for w in r.items if w.startswith(CLASS)]
        if k and len(of) == 1:
            sets.setdefault(k, [0] * len(subjects))[number[of[0][1:]]] = r.freq
        elif k and not of and len(k) <= LONGEST:
            totals[k] = r.freq
    # subjects under the support have no count of their own: the set's total has them
    for k, total in totals.items():
        v = sets.setdefault(k, [0] * len(subjects))
        rest, open_ = total - sum(v), [i for i, x in enumerate(v) if not x]
        for i in open_:
            v[i] = rest / len(open_)
    rules.table = _prune(sets, len(subjects))
    return rules


def _calibrate(rules: Rules, held: DataFrame) -> None:
    """The thresholds that agree best with the labels of documents that no rule was mined from."""
    shared = held.sparkSession.sparkContext.broadcast(rules)
    grid = list(product(EVIDENCE, SHARE, EXTRA))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        tally = [[0, 0, 0] for _ in grid]
        for frame in frames:
            for t, of in zip(frame["text"], frame["subjects"], strict=True):
                want = set(of)
                counted = {e: r.counts(t, e) for e in EVIDENCE}
                for (e, share, extra), x in zip(grid, tally, strict=True):
                    got = set(r.decide(*counted[e], share, extra))
                    x[0] += len(got & want)
                    x[1] += len(got - want)
                    x[2] += len(want - got)
        yield pd.DataFrame([(i, *x) for i, x in enumerate(tally)], columns=["i", "tp", "fp", "fn"])

    summed = held.mapInPandas(compare, "i int, tp bigint, fp bigint, fn bigint").groupBy("i").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    scored = [(2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn), *grid[r.i]) for r in summed.collect()]
    _, rules.evidence, rules.share, rules.extra = max(scored, default=(0, rules.evidence, rules.share, rules.extra))


def assign_subjects(docs: DataFrame, labels: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id, subject, share``: one row for each subject of an unlabelled document.

    Null, empty and blank texts and documents with a hand label are left out; repeated
    rows give repeated results; without labels nothing is assigned; extra columns are not
    read.  Scoring is narrow and whole texts are read; only (doc_id, subject) rows meet
    the labels in the anti-join.
    """
    rules = rules or mine_rules(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for frame in frames:
            out = []
            for d, t in zip(frame["doc_id"], frame["text"], strict=True):
                c, n = r.counts(t)
                out += [(d, s, c[r.subjects.index(s)] / n) for s in r.decide(c, n)]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "share"])

    kept = docs.select("doc_id", "text").where("text is not null and trim(text) <> ''")
    id_type = kept.schema["doc_id"].dataType.simpleString()
    scored = kept.mapInPandas(score, f"doc_id {id_type}, subject string, share double")
    known = labels.select("doc_id").where("doc_id is not null").distinct()
    return scored.join(known.hint("merge"), "doc_id", "left_anti")  # the labels grow with the documents: no broadcast


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every document without a hand label."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "doc_labels"))
    return assign_subjects(docs, labels).select("doc_id", "subject")


def p9_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean share by subject over the corpus."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "doc_labels"))
    return assign_subjects(docs, labels).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))
