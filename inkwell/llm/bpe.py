"""Corpus encoding with a public byte-level BPE vocabulary, as a token automaton.

*Arcs.*  A token may follow another when the merges leave the two side by side.  The
arcs are built by adding one *merge gadget* after the other, in rank order.  The gadget
of the merge ``(a, b) -> c``

* takes the arc ``a -> b`` away, since that pair is always merged from now on;
* gives the new token ``c`` the incoming arcs ``a`` has at that moment, and
* gives the token ``c`` the outgoing arcs ``b`` has at that moment.

A gadget defines the arcs of its token from those of two older tokens, so an arc is
worked out when it is first asked for and kept.

*Table.*  The automaton reads bytes.  After a prefix of a word exactly one token can end
there, so a state holds that token and every token begun and not finished: how far it is
spelled, and which token stands before it.  Reading a byte spells all of them on and
drops those that no token goes on from; the one that is whole and has an arc from the
token before it is the token that ends here.  The table (state, byte) -> state is
written cell by cell when a word first needs it, instead of all at once, and words are
then encoded by looking up one cell a byte.  The labels of the arcs on the way back from
the last state are the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed value of the vocabulary: how text is split before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by one Python worker; the memory is emptied when full.
WORDS_KEPT = 400_000
#: States of one worker's table, which is begun anew when it is full.
STATES_KEPT = 1_000_000


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


def load_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Token ids by bytes and the merges by rank; bounded by the vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()

    def to_bytes(token: str) -> bytes | None:
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else None

    vocab = {b: i for t, i in model["vocab"].items() if (b := to_bytes(t)) is not None}
    merges = []
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        merges.append((to_bytes(left), to_bytes(right)))
    return vocab, merges


class Words(dict):
    """Ids by word, read on first use; emptied when full."""

    def __init__(self, owner: TokenAutomaton) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        ids = self[word] = self.owner.read(word.encode("utf-8"))
        return ids


State = tuple[tuple[int, int], ...]  # (place in the spelling tree, token before) of every token begun
START = -1


@dataclass
class TokenAutomaton:
    """Deterministic automaton over bytes that emits token arcs; see the module's text."""

    vocab: dict[bytes, int]
    merges: list[tuple[bytes, bytes]]
    rank: dict[tuple[int, int], int] = field(init=False)
    parts: dict[int, tuple[int, int, int]] = field(init=False)
    arcs: dict[tuple[int, int, int], bool] = field(init=False, default_factory=dict)
    spelled: dict[int, int] = field(init=False, default_factory=dict)
    whole: list[int] = field(init=False)
    words: Words = field(init=False)

    def __post_init__(self) -> None:
        self.rank, self.parts = {}, {}
        for i, (a, b) in enumerate(self.merges):
            c = self.vocab[a + b]
            self.rank[self.vocab[a], self.vocab[b]] = i
            self.parts.setdefault(c, (i, self.vocab[a], self.vocab[b]))
        self.size = {i: len(t) for t, i in self.vocab.items()}
        self.whole = [-1]  # by place in the spelling tree, the token that is whole there
        for token, i in self.vocab.items():
            if len(token) == 1 or i in self.parts:
                place = 0
                for byte in token:
                    nxt = self.spelled.get(place << 8 | byte)
                    if nxt is None:
                        nxt = self.spelled[place << 8 | byte] = len(self.whole)
                        self.whole.append(-1)
                    place = nxt
                self.whole[place] = i
        self.words = Words(self)
        self._empty_table()

    def _empty_table(self) -> None:
        self.table: dict[int, int] = {}
        self.states: list[State] = [((0, START),)]
        self.number: dict[State, int] = {self.states[0]: 0}
        self.ends: list[int] = [START]

    def follows(self, u: int, v: int, before: int) -> bool:
        """Whether the arc u -> v exists after the gadgets of all ranks under ``before``."""
        key = (u, v, before)
        known = self.arcs.get(key)
        if known is not None:
            return known
        r = self.rank.get((u, v))
        if r is not None and r < before:
            ok = False
        else:
            born_u, _, u_right = self.parts.get(u, (-1, 0, 0))
            born_v, v_left, v_right = self.parts.get(v, (-1, 0, 0))
            if born_u < 0 and born_v < 0:
                ok = True
            elif u == v:
                ok = self.follows(u_right, v_left, born_u)
                if v_left == v_right:
                    ok = True  # a run of four is two pairs
            elif born_u > born_v:
                ok = self.follows(u_right, v, born_u)
            else:
                # of an odd run of one token the pair comes first, the rest last
                ok = False if v_left == v_right == u else self.follows(u, v_left, born_v)
        self.arcs[key] = ok
        return ok

    def _write_cell(self, state: int, byte: int) -> int:
        """The state after ``byte``, entered into the table."""
        top, end, begun = len(self.merges) + 1, START, []
        for place, before in self.states[state]:
            at = self.spelled.get(place << 8 | byte)
            if at is not None:
                begun.append((at, before))
                token = self.whole[at]
                if end == START and token >= 0 and (before == START or self.follows(before, token, top)):
                    end = token
        new = (*begun, (0, end))
        n = self.number.get(new)
        if n is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
            self.ends.append(end)
        self.table[state << 8 | byte] = n
        return n

    def read(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: one table cell a byte, then back along the arcs."""
        if len(self.states) >= STATES_KEPT:
            self._empty_table()
            self.arcs.clear()
        table, state, path = self.table, 0, []
        for byte in word:
            nxt = table.get(state << 8 | byte)
            state = self._write_cell(state, byte) if nxt is None else nxt
            path.append(self.ends[state])
        ids, at = [], len(path)
        while at:
            ids.append(path[at - 1])
            at -= self.size[path[at - 1]]
        return tuple(reversed(ids))

    def encode_word(self, word: str) -> tuple[int, ...]:
        return self.words[word]

    def decode(self, ids: list[int]) -> str:
        """The text whose arcs carry these labels."""
        labels = {i: b for b, i in self.vocab.items()}
        return b"".join(labels[i] for i in ids).decode("utf-8", "replace")


_SPLIT = regex.compile(SPLIT)
_BUILT: dict[str, TokenAutomaton] = {}


def automaton(path: str) -> TokenAutomaton:
    """The automaton of a vocabulary file, built once in each Python process."""
    if path not in _BUILT:
        _BUILT[path] = TokenAutomaton(*load_vocabulary(path))
    return _BUILT[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row a document: its id and ``ids``, the token ids without special tokens.

    Null and empty texts give an empty list; a null id stays null; repeated rows give
    repeated results; strings that look like special tokens are ordinary text; other
    columns are not read.  A narrow map: no shuffle, no driver state, any text length.
    """
    path = path or default_path()
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        split = _SPLIT.findall
        word_ids = a.words.__getitem__
        for batch in batches:
            values: list[int] = []
            offsets = [0]
            for text in batch.column(1).to_pylist():
                if text:
                    values.extend(chain.from_iterable(map(word_ids, split(text))))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    id_type = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(encode, f"doc_id {id_type}, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k byte-level vocabulary."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
