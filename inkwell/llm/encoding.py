"""Text that was decoded with a wrong character encoding, found and restored.

Minimum description length decides: every candidate reading of a text is compressed
with a zstandard dictionary of each language, and the reading with the fewest bytes,
its chain of decodings paid for, wins; otherwise the text stays as it is.

A chain is ``shown as X, really Y``.  Its candidate re-reads the words it applies to: all
words that decode strictly where Y is UTF-8; where both are one-byte encodings, which
decode anything, either all words or those from the first to the last one that turns
into a word of the corpus.  Chains are applied again to their result, so that text garbled twice, or by two
encodings in different places, is restored in several steps.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.samples import LANGS, profile
from inkwell.operators.lineage import cut as stored

#: Bytes of each dictionary; words and letters of a language that may ask for a text in it, the most frequent first.
DICT_BYTES, ASKING = 110_000, 4096
#: Counts that one task holds before it gives them out.
HELD = 200_000
#: Characters of the texts that are counted at once.
BLOCK = 1 << 20
#: Bytes that one more decoding costs, by its kind, and each letter that a lossy one left out.
UTF8_COST, ONE_BYTE_COST, LOST_COST = 0.25, 0.5, 1
#: Bytes that a text left unchanged costs where it decodes strictly as UTF-8: such text stands for a garbled one, so a true one has to be marked.
ESCAPE = 1.5
#: Characters with a byte of their own.
CODED = 250
#: Texts a word of the corpus stands in at least, and how much more frequent its other reading may be.
SEEN, RATHER = 3, 2

#: Encodings that UTF-8 bytes are shown in.
UTF8_SHOWN = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_u", "cp1250", "iso8859_5", "mac_cyrillic", "iso8859_15")
#: One-byte pairs (shown as, really).
ONE_BYTE = (
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8_u"), ("latin-1", "koi8_u"), ("cp1251", "koi8_u"), ("koi8_u", "cp1251"),
    ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_u", "cp866"), ("cp866", "koi8_u"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp1252", "cp437"),
    ("cp1251", "cp1252"), ("koi8_u", "cp1252"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp850", "cp1251"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"),
    ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp866", "cp1252"),
)
_GAP = re.compile(r"([ \n\r\t]+)")
#: Signs that only a lossy decoding leaves: the replacement character, C1 controls, the
#: start of a UTF-8 sequence for punctuation whose rest is gone.
LOST = re.compile("(?:�|[\x80-\x84\x86-\x9f]|â€(?!\\w)|вЂ|Ã[\xa0-\xbf?]|ï¿½|пїЅ)+")

#: What LOST begins with, apart from control characters.
LOST_SIGNS, _CONTROLS = ("�", "â€", "вЂ", "Ã", "ï¿½", "пїЅ"), re.compile("[\x80-\x84\x86-\x9f]")


@lru_cache(None)
def _bytes_of(shown: str) -> dict[str, int]:
    """Byte by character; bytes the encoding leaves undefined stand for themselves."""
    table: dict[str, int] = {}
    for b in range(256):
        try:
            table.setdefault(bytes([b]).decode(shown), b)
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


@lru_cache(None)
def _chars_of(really: str) -> list[str | None]:
    out: list[str | None] = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(really))
        except UnicodeDecodeError:
            out.append(None)
    return out


@lru_cache(None)
def _pair(shown: str, really: str) -> dict[str, str]:
    """Character of a one-byte encoding by the one shown for it."""
    chars = _chars_of(really)
    return {c: new for c, b in _bytes_of(shown).items() if (new := chars[b]) is not None}


def reread(word: str, shown: str, really: str) -> str | None:
    """The word's bytes in ``shown`` read as ``really``; None where that is impossible."""
    try:
        if really == "utf-8":
            return bytes(map(_bytes_of(shown).__getitem__, word)).decode("utf-8")
        return "".join(map(_pair(shown, really).__getitem__, word))
    except (KeyError, UnicodeDecodeError):
        return None


_MARKS = "\"'“”„«»‚‘’.,;:!?…()[]{}–—-"


def _inner(word: str) -> str:
    return word.strip(_MARKS).lower()


class Code(dict):
    """One byte for each frequent character of the corpus, four for any other.

    In UTF-8 a right mark may be longer than the wrong letter shown for it; here a
    character costs by how common it is.
    """

    def __missing__(self, point: int) -> str:
        c = chr(point)
        got = self[point] = self.one.get(c) or "\xff" + "".join(chr((point >> k) & 0x7F) for k in (14, 7, 0))
        return got

    def __init__(self, one: dict[str, str]) -> None:
        super().__init__()
        self.one = one

    def __reduce__(self):
        return Code, (self.one,)

    def encode(self, text: str) -> bytes:
        return text.translate(self).encode("latin-1")


def _utf8_shown() -> re.Pattern[str]:
    """A sequence of UTF-8 as some encoding shows it; every word that reads as UTF-8 holds one."""
    out = []
    for e in UTF8_SHOWN:
        chars = {b: c for c, b in _bytes_of(e).items()}
        span = lambda lo, hi: "[" + re.escape("".join(chars[b] for b in range(lo, hi) if b in chars)) + "]"  # noqa: B023, E731
        more = span(0x80, 0xC0)
        out += [span(0xC2, 0xE0) + more, span(0xE0, 0xF0) + more * 2, span(0xF0, 0xF5) + more * 3]
    return re.compile("|".join(out))


_UTF8_SHOWN = _utf8_shown()


@lru_cache(200_000)
def _odd(word: str) -> bool:
    """The word has a sign of a lossy decoding or, taken as shown in some encoding, reads as UTF-8."""
    return LOST.search(word) is not None or (_UTF8_SHOWN.search(word) is not None and any(reread(word, e, "utf-8") not in (None, word) for e in UTF8_SHOWN))


def _clean(text: str) -> bool:
    return text.isascii() or not any(_odd(w) for w in text.split(" ") if not w.isascii())


Counts = dict[tuple[str, str], Counter[str]]


def tally(texts: Iterable[tuple[int, str]], counts: Counts, first: dict[str, dict[str, int]]) -> None:
    """Into ``counts``: for each language the number of clean texts, in all and by the letters and words in them; into ``first``: the smallest key of a text that holds each."""
    clean: dict[str, list[tuple[int, str]]] = {}
    for key, t in sorted(texts):
        if (l := profile(t)) and _clean(t):
            clean.setdefault(l, []).append((key, t))
    for l, some in clean.items():
        at = 0
        while at < len(some):
            end, size = at, 0
            while end < len(some) and (end == at or size < BLOCK):
                size += len(some[end][1])
                end += 1
            keys, block = zip(*some[at:end], strict=True)
            at, known = end, first[l]
            counts[l, "text"][""] += len(block)
            for kind, held in (("letter", _letters_in(block)), ("word", _words_in(block))):
                counter = counts[l, kind]
                for what, n, i in zip(*held, strict=True):
                    counter[what] += n
                    known[what] = min(keys[i], known.get(what, keys[i]))


def _letters_in(texts: Sequence[str]) -> tuple[list[str], list[int], list[int]]:
    """Each character, the number of texts that hold it, and the place of the first of them."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    held = np.zeros(0x110000, bool)
    held[points] = True
    chars = np.flatnonzero(held)
    place = np.empty(0x110000, np.int32)
    place[chars] = np.arange(len(chars))
    of, row = place[points], np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    n, at = np.zeros(len(chars), np.int64), np.full(len(chars), -1)
    starts = np.searchsorted(row, np.arange(0, len(texts) + 1000, 1000))
    for k, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
        there = np.zeros((1000, len(chars)), bool)
        there[row[lo:hi] - 1000 * k, of[lo:hi]] = True
        here = there.sum(axis=0)
        at = np.where((at < 0) & (here > 0), 1000 * k + there.argmax(axis=0), at)
        n += here
    return list(map(chr, chars.tolist())), n.tolist(), at.tolist()


def _words_in(texts: Sequence[str]) -> tuple[list[str], list[int], list[int]]:
    """Each word, the number of texts that hold it, and the place of the first of them."""
    tokens = [t.split() for t in texts]
    code, spelled = pd.factorize(np.array([*chain.from_iterable(tokens), ""], object)[:-1])
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, tokens), np.int64, len(texts)))
    pairs = np.unique(code.astype(np.int64) * len(texts) + row)
    start = np.searchsorted(pairs, np.arange(len(spelled)) * len(texts))
    return list(spelled), np.diff([*start, len(pairs)]).tolist(), (pairs[start] % len(texts)).tolist()


def _rows(counts: Counts, first: dict[str, dict[str, int]]) -> list[tuple[str, str, str, int, int]]:
    return [(l, kind, what, n, first[l].get(what, 0)) for (l, kind), some in counts.items() for what, n in some.items()]


def _in_turn(rows: Iterable[tuple[str, str, int, int]]) -> dict[str, dict[str, int]]:
    """The key of the text that each letter and word of a language asks for, the most frequent first."""
    out: dict[str, dict[str, int]] = {l: {} for l in LANGS}
    for l, what, _, key in sorted(rows, key=lambda x: (-x[2], x[1])):
        if len(out[l]) < ASKING:
            out[l].setdefault(what, key)
    return out


def _key(text: str) -> int:
    """Spark's xxhash64 of the text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)
    return h - (1 << 64) if h >> 63 else h


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


class Words:
    """A set of words as 64-bit hashes in order: eight bytes a word, however many there are."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self._asked: dict[str, bool] = {}

    def __reduce__(self):
        return Words, (self.hashes,)

    @classmethod
    def of(cls, some: Iterable[str]) -> Words:
        return cls(np.fromiter(map(_hash, some), np.uint64))

    def __contains__(self, word: str) -> bool:
        got = self._asked.get(word)
        if got is None:
            if len(self._asked) > 200_000:
                self._asked.clear()
            h = _hash(word)
            bits, shift = self._bits
            k = h >> shift
            got = bool(bits[k >> 3] >> (k & 7) & 1)
            if got:  # most words that are not in the set end before
                at = int(np.searchsorted(self.hashes, np.uint64(h)))
                got = at < len(self.hashes) and int(self.hashes[at]) == h
            self._asked[word] = got
        return got

    @cached_property
    def _bits(self) -> tuple[bytes, int]:
        """One bit for each stretch of hashes that holds some, about eight bits a word, and the stretch's size as a power of two."""
        shift = 64 - max(3, (8 * len(self.hashes)).bit_length())
        k = self.hashes >> np.uint64(shift)
        bits = np.zeros(1 << (61 - shift), np.uint8)
        np.bitwise_or.at(bits, k >> np.uint64(3), np.left_shift(np.uint8(1), (k & np.uint64(7)).astype(np.uint8)))
        return bits.tobytes(), shift


class Letters:
    """Letters of each language and a byte for each frequent one, from counts over all clean texts."""

    def __init__(self, counts: dict[tuple[str, str, str], int]) -> None:
        self.of: dict[str, set[str]] = {}
        for l in LANGS:
            least = max(2, counts.get((l, "text", ""), 0) // 250)
            self.of[l] = {c for (k, kind, c), n in counts.items() if k == l and kind == "letter" and (n >= least or ord(c) < 128)} | {"\xa0", "\xad"}
        self.everywhere = set().union(*self.of.values())
        frequent: Counter[str] = Counter()
        for (_, kind, c), n in counts.items():
            if kind == "letter" and c in self.everywhere:
                frequent[c] += n
        self.code = Code({c: chr(i) for i, c in enumerate(sorted(frequent, key=lambda c: (-frequent[c], c))[:CODED], 1)})


class Decoder:
    """Dictionaries, words and letters of the clean texts of a corpus."""

    def __init__(self, sample: Iterable[str], vocabulary: Iterable[str]) -> None:
        texts = {_key(t): t for t in sample}
        counts, first = defaultdict(Counter), defaultdict(dict)
        tally(texts.items(), counts, first)
        rows = _rows(counts, first)
        letters = Letters({r[:3]: r[3] for r in rows})
        asking = _in_turn((l, what, n, key) for l, kind, what, n, key in rows if kind != "text")
        self._set(letters, Words.of(w for w in vocabulary if w and all(c in letters.everywhere for c in w)), asking, texts)

    @classmethod
    def fitted(cls, letters: Letters, vocabulary: Words, asking: dict[str, dict[str, int]], texts: dict[int, str]) -> Decoder:
        """``asking``: letters and words of each language, the most frequent over all texts first, each with the key of a text that holds it."""
        new = cls.__new__(cls)
        new._set(letters, vocabulary, asking, texts)
        return new

    def _set(self, letters: Letters, vocabulary: Words, asking: dict[str, dict[str, int]], texts: dict[int, str]) -> None:
        self.letters, self.everywhere, self.code, self.vocab = letters.of, letters.everywhere, letters.code, vocabulary
        self.seen = self.everywhere
        self._words: dict[str, tuple[tuple[tuple[int, str], ...], tuple[tuple[int, bool], ...]]] = {}
        self._signs: dict[str, tuple[int, int, int]] = {}
        self._found: dict[tuple[str, str], tuple[int, ...]] = {}
        dictionaries = {}
        for l, wanted in asking.items():
            kept, room, held = [], DICT_BYTES, set()
            for what, key in wanted.items():
                t = texts[key]
                # a dictionary holds no text that a chain could read otherwise: it would vouch for itself
                if room > 0 and what not in held and self.letters[l].issuperset(t) and not self.candidates(t):
                    kept.append(t)
                    held.update(t, t.split())
                    room -= len(t) + 1
            # what is near its end costs least to refer to
            dictionaries[l] = "\n".join(reversed(kept))[-DICT_BYTES:]
        self.seen = {c for d in dictionaries.values() for c in d}
        self._words, self._found = {}, {}
        self.raw = {l: self.code.encode(d) for l, d in dictionaries.items() if len(d) > 200}
        self._ready: dict[str, zstandard.ZstdCompressor] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None, "_words": {}, "_signs": {}, "_found": {}}

    def length(self, text: str) -> int:
        """Bytes of the text under the best language's dictionary."""
        if self._ready is None:
            self._ready = {}
            for l, raw in self.raw.items():
                params = zstandard.ZstdCompressionParameters.from_level(12, source_size=256, dict_size=len(raw), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._ready[l] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        data = self.code.encode(text)
        return min((len(c.compress(data)) for c in self._ready.values()), default=len(data))

    def _readings(self, word: str) -> tuple[tuple[tuple[int, str], ...], tuple[tuple[int, bool], ...]]:
        """(chain, other reading) of a word by UTF-8 chains, and the one-byte chains that read it otherwise (``_chains_of``); both empty for words of the corpus."""
        got = self._words.get(word)
        if got is None:
            if len(self._words) > 200_000:
                self._words.clear()
            out, chains = [], ()
            if _inner(word) not in self.vocab:
                for k, e in enumerate(UTF8_SHOWN if word[-1] in "ÃРР" or _UTF8_SHOWN.search(word) else ()):
                    new = reread(word, e, "utf-8")
                    if new is None and len(word) > 1 and word[-1] in "ÃРР":
                        new = reread(word + "\xa0", e, "utf-8")  # the no-break space went with the gap
                    if new is not None and new != word and all(c in self.seen or c < "\x80" or _shown_again(c) for c in new):
                        out.append((k, new))
                chains = self._chains_of(word)
            got = self._words[word] = tuple(out), chains
        return got

    def _chains_of(self, word: str) -> tuple[tuple[int, bool], ...]:
        """(chain, may be supported) of the one-byte chains that read the word otherwise.

        All the encodings have ASCII in common.  No chain is supported that gives a
        character of no language.
        """
        reads, differs, likely = -1, 0, -1
        for c in set(word):
            if c > "\x7f":
                x, y, z = self._signs.get(c) or self._sign(c)
                reads &= x
                differs |= y
                likely &= z
        return _numbered(reads & differs, likely)

    def _sign(self, c: str) -> tuple[int, int, int]:
        """One bit for each one-byte chain that reads the character, that reads it otherwise, that gives one of a language."""
        reads = differs = likely = 0
        for k, (e, f) in enumerate(ONE_BYTE):
            if (new := _pair(e, f).get(c)) is not None:
                reads |= 1 << k
                differs |= (new != c) << k
                likely |= (new in self.everywhere or new in _MARKS or self.everywhere.issuperset(new.lower())) << k
        if len(self._signs) > 200_000:
            self._signs.clear()
        got = self._signs[c] = reads, differs, likely
        return got

    def _supported(self, word: str, lang: str) -> tuple[int, ...]:
        """The chains of a word that may be offered for it: UTF-8 ones, and those that turn it into a word of the corpus or take a strange character away."""
        got = self._found.get((word, lang))
        if got is None:
            if len(self._found) > 200_000:
                self._found.clear()
            letters = self.letters.get(lang, set())
            known = lambda new: len(inner := _inner(new)) > 1 and self.everywhere.issuperset(inner) and inner in self.vocab
            utf8, chains = self._readings(word)
            got = [k for k, _ in utf8]
            got += [k for k, likely in chains if likely and (known(new := _by_chain(word, k)) or _fits(word, new, letters))]
            got = self._found[word, lang] = tuple(got)
        return got

    def candidates(self, text: str) -> dict[str, int]:
        """Other readings of the text, one of each chain that finds support."""
        parts = _GAP.split(text)
        strange = [i for i, w in enumerate(parts) if not w.isascii() and any(self._readings(w))]
        lang = profile(text) or "" if strange else ""
        support = {i: self._supported(parts[i], lang) for i in strange}
        offered = {k for ks in support.values() for k in ks}
        other: dict[int, dict[int, str]] = {}
        for i in strange if offered else ():
            utf8, chains = self._readings(parts[i])
            for k, new in utf8:
                if k in offered:
                    other.setdefault(k, {})[i] = new
            for k, _ in chains:
                if k in offered:
                    other.setdefault(k, {})[i] = _by_chain(parts[i], k)
        out: dict[str, int] = {}
        for k, new in other.items():
            if k >= len(UTF8_SHOWN):
                sure = [i for i in new if k in support[i]]
                out["".join(new.get(i, p) for i, p in enumerate(parts))] = k
                new = {i: w for i, w in new.items() if sure[0] <= i <= sure[-1]}
            out["".join(new.get(i, p) for i, p in enumerate(parts))] = k
        return out

    def restore(self, text: str | None) -> tuple[str | None, bool, int]:
        """(text restored as far as possible, garbled, number of decodings undone)."""
        if not text or text.isascii():
            return text, False, 0
        now, steps, size = text, 0, None
        while other := self.candidates(now):  # every step shortens the code or the text
            if size is None:
                size, letters = self.length(now), self.letters.get(profile(text) or "", self.everywhere)
            lengths = {new: self.length(new) for new in other}
            marked = ESCAPE if any(k < len(UTF8_SHOWN) for k in other.values()) else 0
            cost = {new: lengths[new] + (UTF8_COST if k < len(UTF8_SHOWN) else ONE_BYTE_COST) for new, k in other.items()}
            best = min(cost, key=lambda new: (cost[new], sum(c not in letters for c in new)))
            if cost[best] >= size + (marked if other[best] < len(UTF8_SHOWN) else 0):
                break
            size, now, steps = lengths[best], best, steps + 1
        return now, steps > 0 or self._lossy(text), steps

    def _lossy(self, text: str) -> bool:
        """The code is shorter with the signs of a lossy decoding taken as letters left out."""
        if not any(sign in text for sign in LOST_SIGNS) and not _CONTROLS.search(text):
            return False
        bare, holes = LOST.subn("", text)
        return holes > 0 and self.length(bare) + LOST_COST * holes < self.length(text)


@lru_cache(50_000)
def _numbered(chains: int, likely: int) -> tuple[tuple[int, bool], ...]:
    """Numbers of the one-byte chains whose bits are set, and whether they are set in ``likely``."""
    return tuple((len(UTF8_SHOWN) + k, bool(likely >> k & 1)) for k in range(len(ONE_BYTE)) if chains >> k & 1)


def _by_chain(word: str, k: int) -> str:
    """The word's reading by the one-byte chain of this number, which has one."""
    return "".join(map(_pair(*ONE_BYTE[k - len(UTF8_SHOWN)]).__getitem__, word))


def _fits(old: str, new: str, letters: set[str]) -> bool:
    """The old word has a character strange to the language, the new one has none; lone signs prove nothing."""
    return any(c not in letters for c in old) and all(c in letters for c in new) and any(map(str.isalnum, old))


def _shown_again(c: str) -> bool:
    """A character a second round may still decode."""
    return c in _bytes_of("cp1252") or c in _bytes_of("cp1251")


def _other_readings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counted words beside each other reading they have; UTF-8 ones rule a word out at once."""
    for frame in frames:
        out = []
        for w, n in zip(frame["word"], frame["n"], strict=True):
            if w.isascii():
                out.append((w, n, None))
            elif all(reread(w, e, "utf-8") in (None, w) for e in UTF8_SHOWN):
                out.append((w, n, None))
                others = {r for r in (reread(w, e, f) for e, f in ONE_BYTE) if r is not None and r != w}
                out += [(w, n, x) for x in sorted({r.strip(_MARKS) for r in others})]
        yield pd.DataFrame(out, columns=["word", "n", "other"])


def corpus_words(df: DataFrame, *fields: str) -> DataFrame:
    """``word``: words of SEEN texts and more, over all texts, that are not themselves words shown in a wrong encoding.

    A word is left out when a chain reads it as one that is RATHER times as frequent.
    Counted with partial aggregation.
    """
    text = df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("t")).where("t is not null")
    inner = F.transform(F.split("t", "[ \n\r\t]+"), lambda w: F.btrim(w, F.lit(_MARKS)))
    words = text.select(F.explode(F.array_distinct(inner)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    read = words.mapInPandas(_other_readings, "word string, n bigint, other string")
    known = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    likelier = read.where("other is not null").join(known, "other").where(F.col("m") >= RATHER * F.col("n")).select("word").distinct()
    return read.where("other is null").join(likelier, "word", "left_anti").select("word")


def fit_decoder(df: DataFrame, *fields: str) -> Decoder:
    """Decoder of a corpus: letters, words and what its dictionaries hold are counted over all its different texts.

    A dictionary has a fixed size.  The letters and words of its language ask for a text
    that holds them, the most frequent of all first, until it is full; the text is the
    one of the smallest hash among all clean ones that hold it.  Counts are summed by
    task before they are shuffled.  To the driver come the letters, eight bytes for each
    word of the vocabulary, and a text for each of the ASKING words and letters of a language.
    """
    every = df.select(F.explode(F.array(*[F.col(f) for f in fields])).alias("t")).where("t is not null and trim(t) <> ''").withColumn("h", F.xxhash64("t"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, first = defaultdict(Counter), defaultdict(dict)
        frame_of = lambda: pd.DataFrame(_rows(counts, first), columns=["lang", "kind", "what", "n", "h"])
        for frame in frames:
            tally(zip(frame["h"].tolist(), frame["t"], strict=True), counts, first)
            if sum(map(len, first.values())) > HELD:
                yield frame_of()
                counts.clear()
                first.clear()
        yield frame_of()

    counts = every.distinct().mapInPandas(count, "lang string, kind string, what string, n bigint, h bigint").groupBy("lang", "kind", "what")
    counts = stored(counts.agg(F.sum("n").alias("n"), F.min("h").alias("h")))
    letters = Letters({(r.lang, r.kind, r.what): r.n for r in counts.where("kind <> 'word'").collect()})
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "what"))
    asking = _in_turn(map(tuple, counts.where("kind <> 'text'").withColumn("place", place).where(F.col("place") <= ASKING).select("lang", "what", "n", "h").collect()))
    keys = pd.DataFrame({"h": np.array(sorted({h for some in asking.values() for h in some.values()}), np.int64)})
    chosen = df.sparkSession.createDataFrame(keys, "h bigint")
    texts = {r.h: r.t for r in every.join(F.broadcast(chosen), "h", "left_semi").distinct().collect()}
    everywhere = letters.everywhere

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            low = [w.lower() for w in frame["word"]]
            yield pd.DataFrame({"h": [Words.of(w for w in low if all(c in everywhere for c in w)).hashes.tobytes()]})

    parts = [np.frombuffer(r.h, np.uint64) for r in corpus_words(df, *fields).mapInPandas(hashed, "h binary").collect()]
    return Decoder.fitted(letters, Words(np.concatenate([np.zeros(0, np.uint64), *parts])), asking, texts)


def restore_column(decoder: Decoder, spark: SparkSession):
    """Column function: text -> struct(text, garbled, steps); null gives (null, false, 0).

    What is broadcast are the dictionaries and eight bytes for each word of the vocabulary.
    """
    shared = spark.sparkContext.broadcast(decoder)

    @F.pandas_udf("text string, garbled boolean, steps int")
    def restored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        d = shared.value
        for s in texts:
            yield pd.DataFrame([d.restore(t) for t in s], columns=["text", "garbled", "steps"])

    return restored


def restore_fields(df: DataFrame, id_col: str, *fields: str, decoder: Decoder | None = None) -> DataFrame:
    """``row_id, field, original, restored, steps`` of every garbled field.

    Narrow: each row is judged by itself against the broadcast dictionaries.  Null and
    empty texts and texts of ASCII only are never garbled; repeated rows are judged
    alike; other columns are not read.  Lost letters stay lost (steps may be 0).
    """
    decoder = decoder or fit_decoder(df, *fields)
    restored = restore_column(decoder, df.sparkSession)
    risky = [F.col(f).rlike(r"[^\x00-\x7f]") for f in fields]
    any_risky = risky[0]
    for r in risky[1:]:
        any_risky = any_risky | r
    rows = df.where(any_risky).select(F.col(id_col).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("original")) for f in fields])).alias("x"))
    rows = rows.select("row_id", "x.*").withColumn("r", restored("original"))
    return rows.where("r.garbled").select("row_id", "field", "original", F.col("r.text").alias("restored"), F.col("r.steps").alias("steps"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled gold field with its restored text."""
    gold = spark.read.parquet(f"{sf_dir}/gold_annotations.parquet").select("row_id", "src", "tgt")
    return restore_fields(gold, "row_id", "src", "tgt")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled gold field."""
    return p1_restored(spark, sf_dir).select("row_id", "field")
