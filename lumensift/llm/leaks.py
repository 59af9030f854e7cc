"""Problem 9: passages of held-out test items inside training documents.

A word is the longest run of letters and digits of the lower-cased text. A document
holds an item when `n` consecutive words of the item stand in it in the same order
with nothing but non-word characters between them. The test set's n-grams form a hash
set that is broadcast after its size has been counted; the documents are scanned once,
each window of known words looked up and each hit compared word by word.

A test set whose built form is beyond the bound is joined instead, exactly and with the same results:
one bit of each test window goes to every task in a filter of fixed size, only the corpus' windows
that pass it move, with their words, and meet those of the test set in shares, as one window may
stand in any number of documents.

Null and empty texts (on either side) and items of fewer than `n` words hold nothing.
Repeated rows give one result row. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.io import written

#: Least number of shared consecutive words.
N_WORDS = 12
#: Characters of test text whose built set may be broadcast (some 8 bytes each, 100 MB); a larger test set takes the join.
BROADCAST_CHARS = 12_000_000
#: Bits of the filter (2 to this power, 32 MB), in parts of 2 to the power of PART_BITS; shares in which windows meet.
FILTER_BITS, PART_BITS, SALTS = 28, 20, 16
_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) | 1


def window_hashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes (modulo 2^64) of the windows of `n` values that begin at `starts`."""
    total = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            total = total * _BASE + values[starts + j]
    return total


class TestSet:
    """The n-grams of the test items: sorted hashes with the item and place of each."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.known: dict[str, int] = {}
        self.items: list[tuple[int, list[str]]] = []
        hashes, owners, places = [], [], []
        for item, text in items:
            own = words(text)
            if len(own) < n:
                continue
            for w in own:
                self.known.setdefault(w, word_hash(w))
            values = np.array([self.known[w] for w in own], np.uint64)
            starts = np.arange(len(own) - n + 1)
            hashes.append(window_hashes(values, starts, n))
            owners.append(np.full(len(starts), len(self.items)))
            places.append(starts)
            self.items.append((item, own))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.empty(0, np.int64)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text's number, first word, item) of each verified window."""
        known, n = self.known, self.n
        if not len(self.hashes):
            return
        split, sizes, parts = [], [], []
        for text in texts:
            own = words(text) if text else []
            split.append(own)
            sizes.append(len(own) + 1)
            parts += [known.get(w, 0) for w in own]
            parts.append(0)  # no window goes from one text into the next
        values = np.array(parts, np.uint64)
        unknown = np.concatenate([[0], np.cumsum(values == 0)])
        starts = np.flatnonzero(unknown[n:] == unknown[:-n])
        got = window_hashes(values, starts, n)
        low = np.searchsorted(self.hashes, got, "left")
        hit = (low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == got)
        begins = np.cumsum([0, *sizes])
        for start, at, h in zip(starts[hit].tolist(), low[hit].tolist(), got[hit].tolist()):
            doc = int(np.searchsorted(begins, start, "right")) - 1
            first = start - int(begins[doc])
            own = split[doc][first : first + n]
            while at < len(self.hashes) and int(self.hashes[at]) == h:
                item, theirs = self.items[self.owners[at]]
                place = int(self.places[at])
                if theirs[place : place + n] == own:
                    yield doc, first, item
                at += 1


def _spans(text: str, firsts: set[int], n: int) -> list[tuple[int, int]]:
    """Character spans (in the text as it is) of the windows, joined where they touch."""
    lowered = text.lower()
    at = list(range(len(lowered) + 1))
    if len(lowered) != len(text):  # a few letters grow when lower-cased
        at = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    found = [(at[m.start()], at[m.end() - 1] + 1) for m in _WORDS.finditer(lowered)]
    spans: list[tuple[int, int]] = []
    last = -1
    for first in sorted(firsts):
        begin, end = found[first][0], found[first + n - 1][1]
        if spans and first <= last:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((begin, end))
        last = first + n
    return spans


def _collect(items: DataFrame, item_col: str, text_col: str, limit: int) -> list[tuple[int, str]] | None:
    """The test items, or None where they are more than may be broadcast."""
    source = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    if (source.agg(F.sum(F.length("text"))).first()[0] or 0) > limit:
        return None
    return [(r.item_id, r.text) for r in source.collect()]


def leaks(docs: DataFrame, items: DataFrame, n: int = N_WORDS, limit: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id), one row for each document and item it holds `n` words of."""
    held = _collect(items, "item_id", "text", limit)
    if held is None:
        return leaks_joined(docs, items, n)
    shared = docs.sparkSession.sparkContext.broadcast(TestSet(held, n))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["doc_id"].to_numpy()
            pairs = {(int(ids[d]), item) for d, _, item in shared.value.scan(frame["text"].tolist())}
            yield pd.DataFrame(sorted(pairs), columns=["doc_id", "item_id"]).astype("int64")

    return docs.select("doc_id", "text").filter("text is not null").mapInPandas(run, "doc_id long, item_id long").distinct()


def _windows(own: list[str], n: int) -> np.ndarray:
    """Hashes of all windows of a text's words."""
    if len(own) < n:
        return np.empty(0, np.uint64)
    return window_hashes(np.array([word_hash(w) for w in own], np.uint64), np.arange(len(own) - n + 1), n)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(bits: DataFrame) -> np.ndarray:
    """The filter with the bits (bit) set: built in parts on the executors, of one size whatever the test set's."""

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << PART_BITS, bool)
        held[frame["bit"].to_numpy() & ((1 << PART_BITS) - 1)] = True
        return pd.DataFrame({"part": frame["part"].iloc[:1], "held": [np.packbits(held).tobytes()]})

    rows = bits.distinct().withColumn("part", F.shiftright("bit", PART_BITS)).groupBy("part").applyInPandas(part, "part long, held binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    for r in rows.collect():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.held, np.uint8)
    return out


def window_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(row, first, item_id): where the windows of test items stand in documents (row, text), by joins alone."""

    def theirs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for item, text in zip(frame["item_id"], frame["text"]):
                own = words(text)
                out += [(item, " ".join(own[k : k + n]), bit) for k, bit in enumerate(_bits(_windows(own, n)).tolist())]
            yield pd.DataFrame(out, columns=["item_id", "gram", "bit"])

    grams = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    grams = written(grams.mapInPandas(theirs, "item_id long, gram string, bit long").distinct(), "test-windows")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(grams.select("bit")))

    def ours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row, text in zip(frame["row"], frame["text"]):
                own = words(text)
                bits = _bits(_windows(own, n))
                held = np.flatnonzero((shared.value[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1)
                out += [(row, k, " ".join(own[k : k + n])) for k in held.tolist()]
            yield pd.DataFrame(out, columns=["row", "first", "gram"])

    found = docs.select("row", "text").filter("text is not null").mapInPandas(ours, "row long, first int, gram string")
    salted = grams.select("item_id", "gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"]).select("row", "first", "item_id")


def leaks_joined(docs: DataFrame, items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """leaks() for a test set of any size."""
    return window_hits(docs.select(F.col("doc_id").cast("long").alias("row"), "text"), items, n).select(F.col("row").alias("doc_id"), "item_id").distinct()


def _cut(text: str, firsts: set[int], n: int, most: float) -> tuple[str, int, bool]:
    """The text without the leaked spans, their number, and whether it is kept."""
    covered = len({w for f in firsts for w in range(f, f + n)})
    spans = _spans(text, firsts, n)
    kept = covered <= most * len(words(text))
    for begin, end in reversed(spans):
        text = text[:begin] + text[end:]
    return text, len(spans), kept


def without_leaks(docs: DataFrame, items: DataFrame, n: int = N_WORDS, most: float = 0.5, limit: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, text, n_spans): texts with the leaked spans cut out; one narrow pass, or beyond the bound by window_hits().

    A document of whose words more than the share `most` leaked is left out. Null texts stay null.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("n_spans", T.IntegerType())])
    held = _collect(items, "item_id", "text", limit)
    if held is None:
        rows = written(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "leak-rows")
        firsts = window_hits(rows, items, n).groupBy("row").agg(F.collect_set("first").alias("firsts"))
        source = rows.join(firsts, "row", "left").select("doc_id", "text", "firsts")
    else:
        source = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(TestSet(held, n) if held is not None else None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            firsts: dict[int, set[int]] = {}
            if shared.value is None:
                firsts = {doc: set(own.tolist()) for doc, own in enumerate(frame["firsts"]) if own is not None}
            else:
                for doc, first, _ in shared.value.scan(texts):
                    firsts.setdefault(doc, set()).add(first)
            counts, kept = [0] * len(texts), [True] * len(texts)
            for doc, own in firsts.items():
                texts[doc], counts[doc], kept[doc] = _cut(texts[doc], own, n, most)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts, "n_spans": counts})[kept]

    return source.mapInPandas(run, schema)
