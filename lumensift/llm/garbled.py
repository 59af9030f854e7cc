"""Problem 10: text that was decoded with the wrong character encoding.

Two narrow passes. The first counts adjacent character pairs over the whole corpus;
characters fall into SYMBOLS classes, so the table of pairs has a fixed bound
(SYMBOLS squared) however large the corpus is. The second scores each pair by its
mutual information, isolates runs of improbable pairs as maximum-scoring segments, and
tries inverse mappings (the bytes of a legacy code page read as UTF-8) only inside
those runs. A mapping is taken where the restored run is likelier than the one found.
U+FFFD is scored like any other symbol; inside such a run, and only there, it marks text that
is garbled beyond repair.

Null and empty texts are never garbled. One row per input row; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = 2048
#: Ranges (first, last code point) that keep a symbol for each character; others share one per block.
SINGLE = [(0x0000, 0x024F), (0x0370, 0x052F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2200, 0x22FF), (0x2500, 0x25FF), (0xFFFD, 0xFFFD)]
#: Code pages that UTF-8 is commonly misread as.
PAGES = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "cp866", "koi8-r"]
#: East Asian pages of several bytes a character that UTF-8 is misread as.
WIDE = ["gb18030", "cp932", "big5", "euc_kr", "euc_jp"]
#: Single-byte pages taken for one another (page used, page meant).
USED, MEANT = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp1250"], ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250"]
#: Pseudo-count for rare characters, as a share of all pairs: below it, a high mutual information proves nothing.
RARE = 0.003
#: Nats that a pair must lie below independence to count as improbable.
BIAS = 1.0
#: Nats for each restored sequence, as a valid UTF-8 sequence hardly arises by chance; and least gain of a mapping.
PRIOR, LEAST = 1.0, 2.0
#: Least gain where one single-byte page was read as another: any bytes are valid there, so only likelihood speaks.
LEAST_SINGLE = 8.0
#: How often a text may have been misread in a row.
DEPTH = 3
#: Characters worked on at once, and readings of runs that a worker remembers (a full table is begun anew).
BLOCK, KEPT = 2_000_000, 300_000


def symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint16)
    used = 0
    for low, high in SINGLE:
        used += high - low + 1
    rest = SYMBOLS - used
    table[:] = used + (np.arange(0x110000) >> 8) % rest
    at = 0
    for low, high in SINGLE:
        table[low : high + 1] = np.arange(at, at + high - low + 1)
        at += high - low + 1
    return table


_SYMBOLS: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    if not _SYMBOLS:
        _SYMBOLS.append(symbol_table())
    return _SYMBOLS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def pair_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pair, n) over all texts; summed within each task before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for frame in frames:
            s = symbols("\n\n".join(frame["text"])).astype(np.int32)
            total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen.astype(np.int32), "n": total[seen]})

    source = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    return source.mapInPandas(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Mutual information and likelihood of adjacent characters."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        joint = np.zeros((SYMBOLS, SYMBOLS), np.float32)
        joint.ravel()[pairs] = counts
        left, right, total = joint.sum(1), joint.sum(0), max(1.0, float(joint.sum()))
        rare, unit = RARE * total, max(1.0, total * 1e-5)
        logs = np.log(joint + np.float32(0.5))
        #: How far each pair lies below independence, with the rare characters' share raised, less the bias.
        self.improbable = (np.log(left + rare)[:, None] + np.log(right + rare)[None, :] - np.float32(np.log(total) + BIAS) - logs).astype(np.float32)
        self.chance = logs - np.log(left + unit)[:, None].astype(np.float32)

        symbols("")
        self.number = memoryview(_SYMBOLS[0])

    def scores(self, s: np.ndarray) -> np.ndarray:
        """The improbability of each adjacent pair."""
        return self.improbable.ravel()[s[:-1].astype(np.int32) * SYMBOLS + s[1:]]

    def likelihood(self, text: str) -> float:
        if len(text) > 80:
            s = symbols(text)
            return float(self.chance[s[:-1], s[1:]].sum())
        number, chance = self.number, self.chance
        s = [number[ord(c)] for c in text]
        return float(sum([chance[p] for p in zip(s, s[1:])]))


def _mapping(page: str) -> tuple[dict[str, int], re.Pattern]:
    """Character to byte of a code page (undefined bytes stay C1 controls), and a pattern of UTF-8 sequences so written."""
    byte: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes((b,)).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        byte.setdefault(c, b)
    if page in ("cp1252", "cp1250", "cp1251"):
        for b in range(0x80, 0xA0):
            byte.setdefault(chr(b), b)

    def of(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in byte.items() if low <= b <= high) + "]"

    t = of(0x80, 0xBF)
    return byte, re.compile(f"(?:{of(0xC2, 0xDF)}{t}|{of(0xE0, 0xEF)}{t}{t}|{of(0xF0, 0xF4)}{t}{t}{t})+")


_PAGES: dict[str, tuple[dict[str, int], re.Pattern]] = {}
_SINGLE: list[tuple[set[str], dict[int, str]]] = []


def _page(page: str) -> tuple[dict[str, int], re.Pattern]:
    if page not in _PAGES:
        _PAGES[page] = _mapping(page)
    return _PAGES[page]


def _undo(text: str, page: str) -> tuple[str, int]:
    """The text with the sequences that are UTF-8 in the page's bytes restored, and their number."""
    byte, pattern = _page(page)
    done = 0

    def back(m: re.Match) -> str:
        nonlocal done
        try:
            out = bytes(byte[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        done += len(out)
        return out

    return pattern.sub(back, text), done


_FOREIGN = re.compile(r"[^\x00-\x7f\ufffd]{2,}")


def _undo_wide(text: str, page: str) -> tuple[str, int]:
    """The text with the foreign stretches restored that are UTF-8 in an East Asian page's bytes, and the number of characters."""
    done = 0

    def back(m: re.Match) -> str:
        nonlocal done
        try:
            out = m.group().encode(page).decode("utf-8")
        except UnicodeError:
            return m.group()
        done += len(out)
        return out

    return _FOREIGN.sub(back, text), done


def _single() -> list[tuple[set[str], dict[int, str]]]:
    """For each pair of pages, the characters of the one used and what their bytes mean in the other."""
    if not _SINGLE:
        for used in USED:
            byte, _ = _page(used)
            for meant in MEANT:
                if used == meant:
                    continue
                table = {}
                for c, b in byte.items():
                    try:
                        table[ord(c)] = bytes((b,)).decode(meant)
                    except UnicodeDecodeError:
                        pass
                _SINGLE.append(({chr(c) for c in table}, table))
    return _SINGLE


def restore(run: str, before: str, after: str, model: Model) -> str | None:
    """The likeliest reading of a run between its neighbours, or None where it is best as it is."""
    best, now = None, run
    for _ in range(DEPTH):
        old = model.likelihood(before + now + after)
        gains = []
        for k, page in enumerate([*PAGES, *WIDE]):
            new, done = _undo(now, page) if k < len(PAGES) else _undo_wide(now, page)
            if done:
                gains.append((model.likelihood(before + new + after) - old + PRIOR * done, -k, new))
        if not gains or max(gains)[0] < LEAST:
            break
        best = now = max(gains)[2]
    if best is None:
        high = {c for c in run if c > "\x7f" and c != "\ufffd"}
        read: dict[str, int] = {}
        for k, (chars, table) in enumerate(_single()):
            if high and high <= chars:
                read.setdefault(run.translate(table), k)
        read.pop(run, None)
        old = model.likelihood(before + run + after) if read else 0.0
        gains = [(model.likelihood(before + new + after) - old, -k, new) for new, k in read.items()]
        if gains and max(gains)[0] >= LEAST_SINGLE + LEAST_SINGLE * (len(high) == 1 and len(run) == 1) / 4:
            best = max(gains)[2]
    return best


def segments(ends: np.ndarray, at: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring segments (first and last pair) over the positive pairs `at`, each within its text (`texts`, ascending).

    `ends` holds the running sums of the scores. Neighbouring positives are joined as long as the
    pairs between them cost less than either side has gained (Ruzzo and Tompa 1999); each open segment
    knows the last one before it that began lower, so the search back never goes over a segment twice.
    """
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # first pair, last pair, sum before it, sum up to it, last one that began lower
    before, upto = ends[at], ends[at + 1]
    now = -1
    for i, low, high, text in zip(at.tolist(), before.tolist(), upto.tolist(), texts.tolist()):
        if text != now:
            out += [(f, t) for f, t, *_ in stack]
            stack, now = [], text
        first, last = i, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((first, last, low, high, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return out + [(f, t) for f, t, *_ in stack]


class Repairer:
    """Repairs texts by a model, remembering the reading of each run between its neighbours."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _reading(self, run: str, before: str, after: str) -> str | None:
        key = (before, run, after)
        if key not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[key] = restore(run, before, after, self.model)
        return self.known[key]

    def __call__(self, texts: list[str | None]) -> list[tuple[str | None, int, int]]:
        """(text, runs restored, runs beyond repair) for each text."""
        results: list[tuple[str | None, int, int]] = [(t, 0, 0) for t in texts]
        block: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if text and not text.isascii():
                block.append(k)
                size += len(text)
                if size > BLOCK:
                    self._block(texts, block, results)
                    block, size = [], 0
        if block:
            self._block(texts, block, results)
        return results

    def _block(self, texts: list[str | None], block: list[int], results: list[tuple[str | None, int, int]]) -> None:
        whole = "\n\n".join(texts[k] for k in block) + "\n\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        foreign = codes > 0x7F
        scores = self.model.scores(symbols(whole))
        begins = np.cumsum([0, *(len(texts[k]) + 2 for k in block)])
        scores[begins[1:] - 2] = scores[begins[1:] - 1 - (begins[1:] == len(whole))] = -1e3  # no segment reaches into the next text
        at = np.flatnonzero((scores > 0) & (foreign[:-1] | foreign[1:]))
        ends = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
        pieces: dict[int, list[tuple[int, int, str]]] = {}
        lost: dict[int, int] = {}
        last_doc, last_end = -1, 0
        owner = np.searchsorted(begins, at, "right") - 1
        for first, last in segments(ends, at, owner):
            doc = int(np.searchsorted(begins, first, "right")) - 1
            low, high = int(begins[doc]), int(begins[doc + 1]) - 2
            if doc != last_doc:
                last_doc, last_end = doc, low
            begin, end = max(first, last_end), min(last + 2, high)
            while begin > last_end and whole[begin - 1] > "\x7f":
                begin -= 1
            while end < high and whole[end] > "\x7f":
                end += 1
            while begin < end and whole[begin] <= "\x7f":
                begin += 1
            while end > begin and whole[end - 1] <= "\x7f":
                end -= 1
            if begin >= end:
                continue
            run = whole[begin:end]
            if "\ufffd" in run:
                lost[doc] = lost.get(doc, 0) + len(re.findall("\ufffd+", run))
            new = self._reading(run, whole[max(low, begin - 2) : begin], whole[end : min(high, end + 2)])
            last_end = end
            if new is not None:
                pieces.setdefault(doc, []).append((begin - low, end - low, new))
        for n in pieces.keys() | lost.keys():
            out = texts[block[n]]
            for begin, end, new in reversed(pieces.get(n, [])):
                out = out[:begin] + new + out[end:]
            results[block[n]] = (out, len(pieces.get(n, [])), lost.get(n, 0))


def fitted(docs: DataFrame, text_col: str = "text"):
    """The corpus model, broadcast: its table is bounded by SYMBOLS squared, not by the corpus."""
    rows = pair_counts(docs, text_col).toPandas()
    spark = docs.sparkSession
    return spark.sparkContext.broadcast((rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)))


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: bool = True) -> DataFrame:
    """(id, text, n_restored, n_lost): the documents with a garbled stretch (`only`) or all of them."""
    shared = fitted(docs, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repairer(Model(*shared.value))
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            out = pd.DataFrame(repair(texts), columns=["text", "n_restored", "n_lost"])
            out.insert(0, id_col, frame[id_col].to_numpy())
            yield out[(out["n_restored"] > 0) | (out["n_lost"] > 0)] if only else out

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, F.col(text_col).alias("text"))
    if only:
        # ASCII is the same in every code page here, so a text of ASCII alone can hold no garbled stretch.
        source = source.filter(F.col("text").rlike(r"[^\x00-\x7f]"))
    return source.mapInPandas(run, f"{id_col} {kind}, text string, n_restored int, n_lost int")
