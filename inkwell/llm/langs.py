"""Language of every text and of every segment of a mixed one, with a confidence.

The network reads one-byte text: lower case, one code for each letter of the six
languages.  It is trained here on all labelled sentences whose label agrees with their
function words, cut and strung together so that languages change midway: a start is made
on a bounded number of them, then every task trains a copy on all of its own, and the
mean of the copies' parameters is the network.  A text's language is that of its pooled probabilities; a clause speaks another
language when its own pooled probabilities do.
"""

from __future__ import annotations

import os
import random
import re
from collections.abc import Iterable, Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.bigru import Adam, BiGRU, train
from inkwell.llm.confusables import consistent
from inkwell.llm.encoding import Decoder, fit_decoder
from inkwell.llm.samples import LANGS, profile

#: Labelled sentences that the training starts with, at most; hidden units; training steps, bytes and texts a step.
SAMPLE, HIDDEN, STEPS, LENGTH, BATCH = 4096, 24, 480, 96, 48
#: Lengths of the pieces that sentences are cut into.  Over all sentences: rate, rows a step, and steps whose pieces are mixed.
PIECES = (25, 40, 60, 96)
RATE, ROWS, MIXED = 0.002, 256, 8
#: Texts, or windows of long ones, read at once; positions of a window, and those on each side that only give it context.
READ, WINDOW, CONTEXT = 512, 512, 48
#: A clause of another language: words, letters, and mean probability it needs.  A clause
#: that is not the text's language by DOUBT is read once more by itself; where the two
#: readings differ, SURER is asked for.
WORDS, LETTERS, SURE, DOUBT, SURER = 3, 12, 0.5, 0.15, 0.65
#: Probability that a given label may have and still be wrong.
GIVEN = 0.25
#: Spellings of each language's label; anything else is a placeholder.
SPELLINGS = {
    "en": "en eng english englisch inglés англійська",
    "de": "de deu ger german deutsch",
    "uk": "uk ua ukr ukrainian українська",
    "es": "es spa spanish español",
    "it": "it ita italian italiano",
    "ru": "ru rus russian русский",
}
_LABEL = {w: l for l, names in SPELLINGS.items() for w in names.split()}
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ"
_MARKS = "“”„«»‚‘’—–…№€£§ºª½¼¾"
#: One byte for each character: ASCII, Cyrillic from 0x80, marks from 0xB0, Latin-1 letters.
_CODE = {chr(i): i for i in range(32, 127)} | {c: 0x80 + i for i, c in enumerate(_CYRILLIC)} | {c: 0xB0 + i for i, c in enumerate(_MARKS)} | {chr(i): i for i in range(0xDF, 0x100)}
_OTHER = 0xDE
_PLAIN = str.maketrans({c: chr(b) for c, b in _CODE.items()})
_CLAUSE = re.compile(r"[^.!?…:;,“”«»„—–()\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def known_label(label: Column) -> Column:
    """The language a label names, or null."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(_LABEL.items()) for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(label)))


def to_bytes(text: str) -> np.ndarray:
    """One byte for each character, in lower case; positions are those of the text."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals fold to two letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    coded = low.translate(_PLAIN)
    try:
        return np.frombuffer(coded.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(bytes(ord(c) if c < "Ā" else _OTHER for c in coded), np.uint8)


@dataclass
class Tagger:
    """A trained network and the reading of its output."""

    model: BiGRU

    def read(self, texts: list[str]) -> list[np.ndarray]:
        """Probabilities of the languages at each character of each text.

        A text is read in windows that overlap by CONTEXT on each side, so a batch is a
        block of READ x (WINDOW + 2 CONTEXT) positions at most, whatever the texts' length.
        """
        coded = [to_bytes(t) for t in texts]
        out = [np.zeros((len(LANGS), len(c)), np.float32).T for c in coded]
        windows = [(i, a, max(0, a - CONTEXT), min(len(c), a + WINDOW + CONTEXT)) for i, c in enumerate(coded) for a in range(0, len(c), WINDOW)]
        windows.sort(key=lambda w: w[3] - w[2])
        for at in range(0, len(windows), READ):
            part = windows[at : at + READ]
            x = np.zeros((part[-1][3] - part[-1][2], len(part)), np.uint8)
            for j, (i, _, lo, hi) in enumerate(part):
                x[: hi - lo, j] = coded[i][lo:hi]
            p = self.model.predict(x).transpose(1, 2, 0).copy()
            for j, (i, a, lo, hi) in enumerate(part):
                n = min(len(coded[i]), a + WINDOW) - a
                out[i].T[:, a : a + n] = p[j, :, a - lo : a - lo + n]
        return out

    @staticmethod
    def pooled(probs: list[np.ndarray]) -> np.ndarray:
        """Mean probabilities of each text; zeros for an empty one."""
        sums = np.array([p.sum(axis=0) for p in probs], np.float32).reshape(-1, len(LANGS))
        return sums / np.maximum(np.fromiter(map(len, probs), np.float32, len(probs)), 1)[:, None]

    @staticmethod
    def clauses(text: str, p: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, mean probabilities) of each clause long enough to tell."""
        out = []
        for m in _CLAUSE.finditer(text):
            words = _WORD.findall(m.group())
            if len(words) >= WORDS and sum(map(len, words)) >= LETTERS:
                a, b = m.span()
                out.append((a, b, p[a:b].sum(axis=0) / np.float32(b - a)))
        return out

    def segments(self, texts: list[str], probs: list[np.ndarray], pooled: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """(start, end, language, confidence) of the clauses of each mixed text, like neighbours as one; else []."""
        mains = pooled.argmax(axis=1).tolist()
        # a text whose other languages have less in all than one doubtful clause needs has no such clause
        little = DOUBT * (LETTERS + WORDS - 1) - 0.01
        others = (1 - pooled.max(axis=1, initial=0)) * np.fromiter(map(len, probs), np.float64, len(probs))
        found = [self.clauses(t, p) if other > little else [] for t, p, other in zip(texts, probs, others.tolist(), strict=True)]
        doubtful = [(i, j) for i, cs in enumerate(found) for j, (_, _, mean) in enumerate(cs) if mean[mains[i]] < 1 - DOUBT]
        alone = self.read([texts[i][found[i][j][0] : found[i][j][1]].strip() for i, j in doubtful])
        for (i, j), p in zip(doubtful, alone, strict=True):
            a, b, mean = found[i][j]
            own = p.mean(axis=0)
            both, main = (mean + own) / 2, mains[i]
            if main in (mean.argmax(), own.argmax()) and both.max() < SURER:
                both = np.where(np.arange(len(LANGS)) == main, np.float32(max(mean[main], own[main])), np.float32(0))
            found[i][j] = (a, b, both)
        out = []
        for main, cs in zip(mains, found, strict=True):
            segs: list[tuple[int, int, int, float]] = []
            for a, b, mean in cs:
                k = int(mean.argmax())
                if k != main and mean[k] < SURE:
                    k = main
                if segs and segs[-1][2] == k:
                    x, y, _, c = segs[-1]
                    segs[-1] = (x, b, k, float((c * (y - x) + mean[k] * (b - a)) / (y - x + b - a)))
                else:
                    segs.append((a, b, k, float(mean[k])))
            out.append(segs if any(k != main for _, _, k, _ in segs) else [])
        return out


def train_tagger(labelled: DataFrame, text: str, label: str, size: int = SAMPLE, steps: int = STEPS, seed: int = 5) -> Tagger:
    """Network trained on all labelled sentences; the start is made on at most ``size``, one of each cell of the hash space."""
    rows = labelled.select(known_label(F.col(label)).alias("l"), F.col(text).alias("t")).where("l is not null and trim(t) <> ''")
    cell = F.pmod(F.xxhash64("t"), F.lit(size // len(LANGS)))
    picked = rows.groupBy("l", cell.alias("c")).agg(F.min_by("t", F.xxhash64(F.lit(9), "t")).alias("t")).select("l", "t").collect()
    by: dict[str, list[np.ndarray]] = {}
    for r in sorted(picked):
        if profile(r.t) == r.l:
            by.setdefault(r.l, []).append(to_bytes(r.t))
    rnd = random.Random(seed)
    present = [l for l in LANGS if by.get(l)]
    model = BiGRU(len(LANGS), HIDDEN, seed)
    if not present:
        return Tagger(model)
    # half of the pieces begin with a word, as clauses do
    starts = {(l, id(t)): [0, *(np.flatnonzero(t[:-12] == 32) + 1).tolist()] for l in present for t in by[l]}

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _ in range(steps):
            x, y = np.zeros((LENGTH, BATCH), np.uint8), np.full((LENGTH, BATCH), -1)
            for j in range(BATCH):
                at = 0
                while at < LENGTH:
                    l = rnd.choice(present)
                    t = rnd.choice(by[l])
                    n = min(rnd.choice(PIECES), LENGTH - at, len(t))
                    a = rnd.choice(starts[l, id(t)]) if rnd.random() < 0.5 else rnd.randrange(len(t) - n + 1)
                    n = min(n, len(t) - a)
                    x[at : at + n, j], y[at : at + n, j] = t[a : a + n], LANGS.index(l)
                    at += n
                    if at < LENGTH:
                        x[at, j] = 32
                        at += 1
                    if rnd.random() < 0.1:
                        break  # a short text: the rest is padding
            yield x, y

    train(model, batches(), rate=0.015)
    _train_on_all(model, rows, seed)
    return Tagger(model)


def strung(texts: Iterable[tuple[str, str]], rnd: random.Random) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (bytes, language) that hold every byte of (language, text) once: pieces of the texts, mixed and strung together."""
    pieces: list[tuple[int, bytes]] = []

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rnd.shuffle(pieces)
        x, of, sizes, at = [], [], [], 0
        for k, piece in pieces:
            # some rows end early: the rest is padding, as behind short texts
            gap = 1 if rnd.random() > 0.06 else -(at + len(piece)) % LENGTH
            x += piece, b" " if gap == 1 else bytes(gap)
            of += k, -1
            sizes += len(piece), gap
            at += len(piece) + gap
        x.append(bytes(-at % LENGTH))
        x, y = np.frombuffer(b"".join(x), np.uint8).reshape(-1, LENGTH), np.repeat([*of, -1], [*sizes, -at % LENGTH]).reshape(-1, LENGTH)
        n = max(1, round(len(x) / ROWS))
        yield from zip((a.T.copy() for a in np.array_split(x, n)), (a.T.copy() for a in np.array_split(y, n)), strict=True)
        pieces.clear()

    held = 0
    for l, text in texts:
        k, raw, at = LANGS.index(l), to_bytes(text).tobytes(), 0
        while at < len(raw):
            end = at + rnd.choice(PIECES)
            if rnd.random() < 0.5:  # the next piece begins with a word
                end = raw.find(b" ", end) + 1 or len(raw)
            piece = raw[at:end]
            pieces.append((k, piece))
            held += len(piece)
            at = end
            if held >= LENGTH * ROWS * MIXED:
                yield from batches()
                held = 0
    if pieces:
        yield from batches()


def _train_on_all(model: BiGRU, rows: DataFrame, seed: int) -> None:
    """The model trained on by every different text of the ``l, t`` rows, once.

    Each task trains a copy on its texts, in the order of their hashes; the parameters
    are the mean over the steps of all tasks.  Languages weigh alike, however many texts
    they have.  To the driver come a few sums of the parameters.
    """
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.sum(F.length("t")).alias("n")).collect()}
    weight = np.array([1 / sizes[l] if l in sizes else 0 for l in LANGS])
    weight = weight / weight.max()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def trained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _one_thread()
        task = TaskContext.get().partitionId()
        mine = deepcopy(shared.value)
        adam, sums, n = Adam(mine), [np.zeros(p.shape) for p in mine.params()], 0
        agreed = ((l, t) for frame in frames for l, t in zip(frame["l"], frame["t"], strict=True) if profile(t) == l)
        for x, y in strung(agreed, random.Random(f"{seed} {task}")):
            adam.step(x, y, RATE, weight)
            told = int((y >= 0).sum())
            n += told
            for p, q in zip(mine.params(), sums, strict=True):
                q += told * p
        yield pd.DataFrame({"task": [task], "n": [n], "sums": [np.concatenate([q.ravel() for q in sums]).tobytes()]})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")
        return pd.DataFrame({"task": frame["task"][:1], "n": [frame["n"].sum()], "sums": [sum(np.frombuffer(s) for s in frame["sums"]).tobytes()]})

    form = "task int, n bigint, sums binary"
    copies = rows.distinct().sortWithinPartitions(F.xxhash64("t"), "t", "l").mapInPandas(trained, form)
    parts = sorted(copies.groupBy(F.col("task") % 16).applyInPandas(summed, form).collect())
    if n := sum(r.n for r in parts):
        mean = sum(np.frombuffer(r.sums) for r in parts) / n
        at = 0
        for p in model.params():
            p[...] = mean[at : at + p.size].reshape(p.shape)
            at += p.size


def _one_thread() -> None:
    """Numpy inside a Spark task keeps to the task's core."""
    for v in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(v, "1")


def label_texts(df: DataFrame, id_col: str, text: str, tagger: Tagger, decoder: Decoder | None = None) -> DataFrame:
    """``row_id, lang, confidence, segments, pooled`` for every text.

    ``segments`` is an array of (start, end, lang, confidence) in characters, present when
    clauses of the text differ in language, else empty; ``pooled`` has the probability of
    each of LANGS.  Null and blank texts give a null
    language.  A text that seems mixed is read again with its encoding repaired and its
    letters in one form.  Narrow; repeated rows get the same result; extra columns are not
    read; whole texts are read.
    """
    shared = df.sparkSession.sparkContext.broadcast((tagger, decoder))
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text).alias("text"))
    id_type = rows.schema["row_id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _one_thread()
        tag, dec = shared.value

        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            probs = tag.read(texts)
            pooled = tag.pooled(probs)
            seg = tag.segments(texts, probs, pooled)
            if dec is not None:
                again = {i: better for i, s in enumerate(seg) if s and not texts[i].isascii() and (better := consistent(dec.restore(texts[i])[0])) != texts[i]}
                better = list(again.values())
                reread = tag.read(better)
                means = tag.pooled(reread)
                for i, t, mean, s in zip(again, better, means, tag.segments(better, reread, means), strict=True):
                    texts[i], pooled[i], seg[i] = t, mean, s
            out = []
            for row_id, t, k, mean, rounded, s in zip(frame["row_id"], texts, pooled.argmax(axis=1).tolist(), pooled.tolist(), pooled.round(4).tolist(), seg, strict=True):
                kept = [(a, b, LANGS[x], round(q, 4)) for a, b, x, q in s]
                told = bool(t.strip())
                out.append((row_id, LANGS[k] if told else None, round(mean[k], 4) if told else 0.0, [dict(zip(("start", "end", "lang", "confidence"), x, strict=True)) for x in kept], rounded if told else None))
            yield pd.DataFrame(out, columns=["row_id", "lang", "confidence", "segments", "pooled"])

    return rows.mapInPandas(read, f"row_id {id_type}, lang string, confidence double, segments array<struct<start:int,end:int,lang:string,confidence:double>>, pooled array<float>")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Tagger, Decoder]:
    report = spark.read.parquet(f"{sf_dir}/generate_report.parquet").select("report_id", "src", "language")
    gold = spark.read.parquet(f"{sf_dir}/gold_annotations.parquet").select("row_id", "src")
    return report, gold, train_tagger(report, "src", "language"), fit_decoder(report.select("src").unionByName(gold.select("src")), "src")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with a missing or wrong language, and the languages of mixed gold sources."""
    report, gold, tagger, decoder = _tables(spark, sf_dir)
    given = report.select(F.struct("report_id", known_label(F.col("language")).alias("given")).alias("key"), "src")
    # a label stands unless the text speaks against it
    of_given = F.get("pooled", F.array_position(F.array(*map(F.lit, LANGS)), F.col("row_id.given")).cast("int") - 1)
    wrong = F.col("row_id.given").isNull() | ((F.col("lang") != F.col("row_id.given")) & (of_given < GIVEN))
    right = label_texts(given, "key", "src", tagger, decoder).where(F.col("lang").isNotNull() & wrong)
    mixed = label_texts(gold, "row_id", "src", tagger, decoder).where("size(segments) > 0")
    langs = mixed.select("row_id", F.explode(F.array_distinct(F.concat(F.array("lang"), F.transform("segments", lambda s: s["lang"])))).alias("lang"))
    return right.select(F.lit("generate_report").alias("tbl"), F.col("row_id.report_id").alias("row_id"), "lang").unionByName(langs.select(F.lit("gold_annotations").alias("tbl"), "row_id", "lang"))


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every text of both tables."""
    report, gold, tagger, decoder = _tables(spark, sf_dir)
    a = label_texts(report, "report_id", "src", tagger, decoder).select(F.lit("generate_report").alias("tbl"), "row_id", "lang", "confidence")
    b = label_texts(gold, "row_id", "src", tagger, decoder).select(F.lit("gold_annotations").alias("tbl"), "row_id", "lang", "confidence")
    return a.unionByName(b)


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of mixed gold sources with language and confidence."""
    _, gold, tagger, decoder = _tables(spark, sf_dir)
    return label_texts(gold, "row_id", "src", tagger, decoder).select("row_id", F.inline("segments"))
