"""Problem 8: the whole corpus as token ids of a public byte-level BPE vocabulary.

The merge list is compiled into a finite-state transducer that is determinised
while it runs. An encoding is canonical exactly when each pair of neighbouring
tokens is, so the transducer only ever needs to know, for each hypothesis, the
last token it closed and the bytes read since. Its state is the set of all live
hypotheses after the input so far; what they agree on is emitted at once, so the
lookahead is at most the longest token. Each new (state, byte) is worked out once
and then is a table entry.

Rows: one per input row. Null and empty texts give an empty list. The strings of
special tokens are ordinary text. Extra columns are left alone (only the id and
text columns are read).
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("LUMENSIFT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the byte-level vocabularies cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a worker keeps of states' transitions and of whole words' ids; a full table is begun anew.
KEPT = 400_000
_NONE = -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Byte-level BPE as a lazily determinised transducer over one pre-token."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        self.ranks, self.kept = ranks, kept
        self.text = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        #: A hypothesis is (ids not yet emitted, last closed id, bytes since).
        start = (((), _NONE, b""),)
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.finals: dict[int, tuple[int, ...]] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """The merges carried out on `word`; asked only of single tokens and token pairs."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, at = min(ranked)
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` in a canonical encoding (_NONE: at the start)."""
        known = self.pairs.get((left, right))
        if known is None:
            b = self.text[right]
            known = self.merged(b) == [b] if left == _NONE else self.merged(self.text[left] + b) == [self.text[left], b]
            if len(self.pairs) >= 4 * self.kept:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        after = []
        b = bytes((byte,))
        for out, last, since in self.states[state]:
            since += b
            closes = self.ranks.get(since)
            if closes is not None and self.fits(_NONE, closes) and (last == _NONE or self.fits(last, closes)):
                after.append((out + (closes,), closes, b""))
            if since in self.prefixes:
                after.append((out, last, since))
        outs = [h[0] for h in after]
        low, high = min(outs), max(outs)
        n = 0
        while n < len(low) and n < len(high) and low[n] == high[n]:
            n += 1
        key = tuple((out[n:], last, since) for out, last, since in after)
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        return number, low[:n]

    def __call__(self, word: bytes) -> tuple[int, ...]:
        if len(self.moves) > self.kept:
            self._restart()
        state, ids, moves = 0, [], self.moves
        for byte in word:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self._step(state, byte)
            state, out = move
            if out:
                ids.extend(out)
        rest = self.finals.get(state)
        if rest is None:
            rest = self.finals[state] = next(out for out, _, since in self.states[state] if not since)
        ids.extend(rest)
        return tuple(ids)


class Encoder:
    """Text to ids: cuts the text into pre-tokens and remembers whole stretches between spaces."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        self.fst, self.kept = Transducer(ranks, kept), kept
        self.cut = regex.compile(PATTERN).findall
        # A single space before a visible character always begins a pre-token: such places part the text exactly.
        self.uneven = regex.compile(r" \s| \Z").search
        self.words: dict[str, tuple[int, ...]] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}

    def _stretch(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        words = self.words
        for word in self.cut(text):
            got = words.get(word)
            if got is None:
                got = self.fst(word.encode())
                if len(words) >= self.kept:
                    words.clear()
                if len(word) <= 64:
                    words[word] = got
            ids.extend(got)
        return tuple(ids)

    def into(self, text: str, ids: array) -> None:
        if not text:
            return
        if self.uneven(text):
            ids.extend(self._stretch(text))
            return
        first, *rest = text.split(" ")
        if first:
            ids.extend(self._stretch(first))
        known = self.stretches
        for part in rest:
            got = known.get(part)
            if got is None:
                got = self._stretch(" " + part)
                if len(known) >= self.kept:
                    known.clear()
                if len(part) <= 64:
                    known[part] = got
            ids.extend(got)

    def __call__(self, text: str | None) -> list[int]:
        ids = array("i")
        self.into(text or "", ids)
        return ids.tolist()


class Utf8Machine:
    """Incremental UTF-8: bytes in any cuts, characters out as soon as they are whole.

    The state is (bytes still due, bits so far, least code point allowed). What cannot
    be UTF-8 comes out as U+FFFD, one for each maximal broken part, as the standard asks.
    """

    def __init__(self) -> None:
        self.due, self.bits, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        due, bits, low, high = self.due, self.bits, self.low, self.high
        for b in data:
            if due:
                if low <= b <= high:
                    bits, due, low, high = bits << 6 | b & 0x3F, due - 1, 0x80, 0xBF
                    if not due:
                        out.append(chr(bits))
                    continue
                out.append("�")
                due, low, high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                due, bits = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                due, bits = 2, b & 0x0F
                low, high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                due, bits = 3, b & 0x07
                low, high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        self.due, self.bits, self.low, self.high = due, bits, low, high
        return "".join(out)

    def end(self) -> str:
        broken, self.due, self.low, self.high = bool(self.due), 0, 0x80, 0xBF
        return "�" if broken else ""


def decode(ids: Iterable[int], text: dict[int, bytes]) -> str:
    """Ids to text, token by token; ids outside the vocabulary are passed over."""
    machine = Utf8Machine()
    return "".join(machine.feed(text.get(i, b"")) for i in ids) + machine.end()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's one encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) for every row, in one narrow pass: no shuffle, nothing broadcast but a path."""
    path = vocabulary(name, folder)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    own.into(text, ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(tokens: DataFrame, id_col: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text) from (id, ids); a null list gives a null text, an empty one an empty text."""
    path = vocabulary(name, folder)
    kind = tokens.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = encoder(path).fst.text
        for batch in batches:
            texts = [None if ids is None else decode(ids, text) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, "ids").mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("text", T.StringType())]))
