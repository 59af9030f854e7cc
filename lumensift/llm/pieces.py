"""Problem 7: items over the size limit, cut by content into pieces under it.

A rolling hash over the last WINDOW words marks landmarks that depend on nothing but
those words, so an edit moves only landmarks beside it. From each cut the first landmark
beyond the least size is taken and snapped to the nearest natural boundary (paragraph
end before sentence end) that keeps the piece within its limits; without a landmark the
last natural boundary in reach is taken, then a gap between words, and only inside a
single overlong word is the cut made anywhere. Consecutive pieces share OVERLAP words,
or as many whole words before the cut as fit in OVERLAP_CHARS where words are very long.

Only oversized rows reach Python; null, blank and small texts have no pieces. A chunk
delivered twice is cut once. An empty id list gives empty parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.llm.sentences import with_places

#: Limits of a piece, words shared by neighbours, and code points these may take where words are very long.
MAX_WORDS, MAX_CHARS, OVERLAP, OVERLAP_CHARS = 800, 6000, 75, 3500
#: New words (or their share of the code points) a piece has at least.
LEAST_WORDS, LEAST_CHARS = 200, 1500
#: Words in a landmark's window; one place in SPACING is a landmark.
WINDOW, SPACING = 8, 64
_WORD = re.compile(r"[^ \t\r\n]+")
_PARAGRAPH = re.compile(r"[ \t\r]*\n[ \t\r]*\n\s*")
SCHEMA = "chunk_id string, piece int, text string, start_char int, end_char int, n_words int, n_chars int, sentence_ids array<string>, paragraph_ids array<string>, ids_exact boolean"


def oversized(text: Column) -> Column:
    """More than MAX_WORDS words or MAX_CHARS code points; words are only counted where they can be that many."""
    return (F.length(text) > MAX_CHARS) | ((F.length(text) > 2 * MAX_WORDS) & (F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")) > MAX_WORDS))


def landmarks(words: list[str]) -> np.ndarray:
    """Numbers of the words after which a landmark lies."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64)
    values = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    total = np.zeros(len(words) - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            total = total * np.uint64(0x9E3779B97F4A7C15) + values[j : j + len(total)]
        total ^= total >> np.uint64(29)
    return np.flatnonzero(total % np.uint64(SPACING) == 0) + WINDOW


class Cutter:
    """The cuts of one text."""

    def __init__(self, text: str, sentence_ends: list[int]):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]
        self.paragraphs = sorted({m.start() for m in _PARAGRAPH.finditer(text)} | {len(text)})
        self.sentences = sorted(set(sentence_ends))
        self.marks = [self.ends[i - 1] for i in landmarks([text[s:e] for s, e in spans]).tolist()]

    def n_words(self, begin: int, end: int) -> int:
        return max(0, bisect_left(self.starts, end) - bisect_right(self.ends, begin))

    def back(self, cut: int) -> int:
        """Where the piece after `cut` begins: OVERLAP whole words before it."""
        first = bisect_right(self.ends, cut)  # words that end by the cut
        if first < len(self.starts) and self.starts[first] < cut:
            return cut  # the cut is inside a word
        n = 0
        while n < OVERLAP and n < first and cut - self.starts[first - n - 1] <= OVERLAP_CHARS:
            n += 1
        return self.starts[first - n] if n else cut

    def reach(self, begin: int) -> int:
        """The furthest end of a piece that begins at `begin`."""
        last = bisect_right(self.ends, begin) + MAX_WORDS - 1
        by_words = self.ends[last] if last < len(self.ends) else len(self.text)
        return min(by_words, begin + MAX_CHARS)

    @staticmethod
    def _within(places: list[int], low: int, high: int) -> list[int]:
        return places[bisect_left(places, low) : bisect_right(places, high)]

    def cut(self, begin: int, done: int) -> int:
        """The end of the piece that begins at `begin` and whose text up to `done` the last piece had."""
        far = self.reach(begin)
        if far >= len(self.text) or len(self.text) - begin <= MAX_CHARS and not self.text[far:].strip(" \t\r\n"):
            return len(self.text)
        at = bisect_left(self.starts, done)
        least = self.ends[min(at + LEAST_WORDS, len(self.ends)) - 1] if self.ends else far
        low = min(least, done + LEAST_CHARS, far)
        low = max(low, done + 1)
        paragraphs, sentences = self._within(self.paragraphs, low, far), self._within(self.sentences, low, far)
        mark = next(iter(self._within(self.marks, low, far)), None)
        if mark is not None and (paragraphs or sentences):
            # A paragraph's end is worth three times the way to a sentence's.
            return min([(abs(p - mark), 0, p) for p in paragraphs] + [(3 * abs(s - mark), 1, s) for s in sentences])[2]
        if paragraphs or sentences:
            return (paragraphs or sentences)[-1]
        gaps = self._within(self.ends, low, far)
        return gaps[-1] if gaps else far

    def pieces(self) -> list[tuple[int, int]]:
        out, begin, done = [], 0, 0
        while done < len(self.text):
            end = self.cut(begin, done)
            out.append((begin, end))
            if end >= len(self.text):
                break
            done = end
            begin = self.back(end)
            if begin <= out[-1][0]:
                begin = end
        return out


def _placed(n: int, spans: list[tuple[int, int]], whole: tuple[int, int]) -> list[tuple[int, int]]:
    """Spans of `n` ids: the found ones where they are as many, else even shares of the whole."""
    if len(spans) == n:
        return spans
    begin, end = whole
    return [(begin + (end - begin) * i // n, begin + (end - begin) * (i + 1) // n) for i in range(n)]


def _units(text: str, cuts: list[int], begin: int, end: int) -> list[tuple[int, int]]:
    """The stretches of text[begin:end] between the cuts, blank ones left out."""
    places = [begin, *(c for c in cuts if begin < c < end), end]
    return [(b, e) for b, e in zip(places, places[1:]) if text[b:e].strip()]


def id_spans(text: str, paragraph_ids: list[str], sentence_ids: list[str], sentence_ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Where each paragraph and sentence id lies in the text, and whether the text shows as many units as there are ids.

    Ids of sentences begin with their paragraph's. Where the numbers differ, ids share the length evenly.
    """
    whole, exact = (0, len(text)), True
    cuts = [m.end() for m in _PARAGRAPH.finditer(text)]
    units = _units(text, cuts, *whole)
    exact &= len(units) == len(paragraph_ids) or not paragraph_ids
    paragraphs = _placed(len(paragraph_ids), units, whole) if paragraph_ids else []
    ends = sorted({*sentence_ends, *cuts})
    of: dict[str, list[str]] = {}
    for s in sentence_ids:
        of.setdefault(s.rpartition(":")[0], []).append(s)
    if paragraph_ids and list(of) == [p for p in paragraph_ids if p in of] and sum(map(len, of.values())) == len(sentence_ids):
        parts = [(len(of[p]), span) for p, span in zip(paragraph_ids, paragraphs) if p in of]
    else:
        parts = [(len(sentence_ids), whole)] if sentence_ids else []
    sentences: list[tuple[int, int]] = []
    for n, span in parts:
        units = _units(text, ends, *span)
        exact &= len(units) == n
        sentences += _placed(n, units, span)
    return paragraphs, sentences, exact


def pieces(chunks: DataFrame) -> DataFrame:
    """SCHEMA rows of every oversized chunk, one per piece. One narrow pass, then one row per chunk_id and piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, sents, paras, ends in zip(frame["chunk_id"], frame["text"], frame["sentence_ids"], frame["paragraph_ids"], frame["ends"]):
                sents = [s for s in sents if s] if sents is not None else []
                paras = [p for p in paras if p] if paras is not None else []
                ends = ends.tolist() if ends is not None else []
                cutter = Cutter(text, ends)
                p_spans, s_spans, exact = id_spans(text, paras, sents, ends)
                for n, (begin, end) in enumerate(cutter.pieces()):
                    mine = lambda ids, spans: [i for i, (b, e) in zip(ids, spans) if b < end and e > begin]
                    rows.append((key, n, text[begin:end], begin, end, cutter.n_words(begin, end), end - begin, mine(sents, s_spans), mine(paras, p_spans), exact))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    source = chunks.select("chunk_id", "text", "sentence_ids", "paragraph_ids").filter(F.col("chunk_id").isNotNull() & oversized(F.col("text")))
    # Only oversized rows move: re-delivered ones are made one here, before their sentences are sought.
    once = with_places(source.dropDuplicates(["chunk_id"]), "text", "_u")
    ends = F.transform(F.filter("_u", lambda u: u["end"] > u["begin"]), lambda u: u["end"])
    return once.select("chunk_id", "text", "sentence_ids", "paragraph_ids", ends.alias("ends")).mapInPandas(run, SCHEMA)
