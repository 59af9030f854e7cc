"""Problem 2: noise in text from scanned pages, and the continuous paragraphs behind it.

Lines of a page are labelled header, folio, body, break (a blank line) or start (a line that opens a
paragraph) by a hidden Markov model over layout features: place on the page, recurrence of the line on
other pages of its attachment (misreadings and numbers aside), what number it holds and whether that
number runs along with the pages, length, and how it goes on from the line before (end mark, short last
line, indent, capital). Starting from seed shares, the model is fitted by Viterbi training on all
pages, whose counts are summed in each round. The labels alone make the paragraphs: a start opens one,
with or without a blank line before it, and a body line behind a blank line or at a page's top carries
the last one on, over the page's end too.

Words cut at line ends are made whole, and misread, split and spaced-out words are put right by the
corpus' own vocabulary. What is misread for what is learnt from it: a rare word that equals a far more
frequent one but for one or two characters inside it counts for that confusion, and a confusion that
CONFUSED words show holds. A rare word that one or two learnt confusions part from a far more frequent
one was that word; a letter that is mostly seen in such words is no letter of any language here.

Recurrence, running numbers and the vocabulary are grouped aggregations over all pages, joined back on
salted keys; no attachment is gathered in one task. What is broadcast (frequent words and corrections) is
counted first; beyond SHARED words each page's tokens are joined with them instead. Null and blank
texts carry no noise and give no paragraphs. Pages repeated under one key count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.io import written

HEADER, FOLIO, BODY, BREAK, START = STATES = range(5)
#: Lines at the top and bottom of a page that may be running lines, pages on which a line recurs, and rounds of the fit.
EDGE, RECURS, ROUNDS = 3, 2, 3
#: A misread word is this much rarer than the word it was, which occurs at least so often.
RARER, LEAST = 15, 5
#: Words that show a confusion (and their least share of those that show the commonest), letters that stay around it, and confusions at most.
CONFUSED, CONFUSED_SHARE, AROUND, CONFUSIONS = 3, 0.01, 4, 200
#: Words that may be broadcast; beyond it tokens are joined. Shares of a running line's pages.
SHARED, SALTS = 1_000_000, 8
#: Hyphen-like marks.
HYPHENS = "-­‐‑¬"
_JOIN = re.compile(rf"(?<=\w)[{HYPHENS}][ \t]*\n[ \t]*(?=\w)")
_CUT = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*\n[ \t]*[^\W\d_]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
_WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
_ROMAN = re.compile(r"(?i)^(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_ALONE = re.compile(r"(?i)^[\W_]*(?:page|p\.|seite|s\.|pag\.?|стр\.)?[\W_]*([0-9OolI]{1,4}|[ivxlc]{1,7})[\W_]*(?:(?:/|of|von|de)\s*\d+)?[\W_]*$")
_BESIDE = re.compile(r"(?i)^\W*(?:page\s+)?(\d{1,4}|[ivxlc]{1,7})(?:\s{2,}|\t|\s*[|·•–—]\s*)\S|\S(?:\s{2,}|\t|\s*[|·•–—]\s*)(?:page\s+)?(\d{1,4}|[ivxlc]{1,7})\W*$|^(\d{1,4})\s+\D|\D\s+(\d{1,4})$")


def number(token: str) -> int | None:
    """The value of an Arabic (also slightly misread) or Roman number."""
    if token[:1].isdigit() or token[-1:].isdigit():
        token = token.translate(str.maketrans("OolI", "0011"))
    if token.isdigit():
        return int(token)
    m = _ROMAN.match(token)
    if m and token:
        low = token.lower()
        values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in low]
        return sum(-v if i + 1 < len(values) and values[i + 1] > v else v for i, v in enumerate(values))
    return None


def alone(line: str) -> int | None:
    m = _ALONE.match(line)
    return number(m.group(1)) if m else None


def beside(line: str) -> list[int]:
    """Numbers at either end of a line."""
    return [v for m in _BESIDE.finditer(line) for g in m.groups() if g and (v := number(g)) is not None]


def confusion_keys(confusions: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], dict[int, str]]:
    """The confusions as replacements that make both readings equal: longer ones one by one, single letters by classes."""
    longer = sorted(((x, y) for x, y in confusions if len(x) > 1 or len(y) > 1), key=lambda c: (-max(map(len, c)), c))
    top: dict[str, str] = {}

    def of(c: str) -> str:
        while top.get(c, c) != c:
            c = top[c]
        return c

    for x, y in confusions:
        if len(x) == len(y) == 1 and of(x) != of(y):
            top[of(x)] = of(y)
    return [(x, y) if len(x) >= len(y) else (y, x) for x, y in longer], {ord(c): of(c) for c in top}


def line_key(line: str, same: tuple[list[tuple[str, str]], dict[int, str]]) -> str:
    """A line in which misreadings and numbers make no difference; '' if little is left."""
    low = re.sub(r"(?<![^\W\d_])[\divxlc]+(?![^\W\d_])", "", line.lower())
    longer, single = same
    for x, y in longer:
        low = low.replace(x, y)
    low = re.sub(r"[\W\d_]+", "", low.translate(single))
    return low if len(low) >= 4 else ""


def line_keys(line: str, same: tuple[list[tuple[str, str]], dict[int, str]]) -> list[str]:
    """A line's key and those of its halves, so that a misreading of an unusual kind spoils only one."""
    key = line_key(line, same)
    half = len(key) // 2
    return [key, "<" + key[:half], ">" + key[-half:]] if len(key) >= 16 else [key] if key else []


def edges(text: str, same) -> list[tuple[int, list[str], list[int]]]:
    """(line number, keys, numbers) of the lines at the page's ends."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line and not line.isspace()]
    if len(full) < 2:
        return []
    ends = sorted({*full[:EDGE], *full[-EDGE:]})
    return [(i, line_keys(lines[i], same), [v] if (v := alone(lines[i])) is not None else beside(lines[i])) for i in ends]


def features(text: str, recurs: dict[int, int], runs: dict[int, int]) -> list[int]:
    """One symbol per line: place (5) x recurrence (3) x number (4) x length (2) x going on (4), or the last symbol for a blank line."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line and not line.isspace()]
    if not full:
        return [SYMBOLS - 1] * len(lines)
    widths = sorted(len(lines[i]) for i in full)
    usual = widths[len(widths) // 2]
    out = [SYMBOLS - 1] * len(lines)
    last, before = len(full), ""
    for at, i in enumerate(full):
        line = lines[i]
        place = 0 if at == 0 else 1 if at == 1 else 4 if at == last - 1 else 3 if at == last - 2 else 2
        # none, a number alone that runs along, a number alone that does not, a number at the line's end that runs along
        is_alone = len(line) <= 30 and alone(line) is not None
        num = (1 if runs.get(i, 0) else 2) if is_alone else 3 if runs.get(i, 0) else 0
        # carries on, may do either, opens by the end of the line before it, opens by an indent
        first = line.lstrip()[0]
        ended = before.rstrip()[-1:] in _END
        if line[0] in " \t" and before[:1] not in (" ", "\t"):
            on = 3
        elif ended and len(before) < 0.7 * usual and not first.islower():
            on = 2
        else:
            on = 0 if first.islower() and not (before and ended) else 1
        out[i] = (((place * 3 + min(2, recurs.get(i, 0))) * 4 + num) * 2 + (len(line) < 0.7 * usual)) * 4 + on
        before = line
    return out


_END = tuple(".!?…:;।؟。！？”\"»)]")
SYMBOLS = 5 * 3 * 4 * 2 * 4 + 1
#: Pages that go through the lines together.
TOGETHER = 512


class Labeller:
    """The hidden Markov model: start, change and symbol shares, in logs."""

    def __init__(self):
        emit = np.full((5, SYMBOLS), 1e-4)
        for s in range(SYMBOLS - 1):
            on, num, again, place = s % 4, s // 8 % 4, s // 32 % 3, s // 96
            edge = (1.0, 0.5, 0.002, 0.5, 1.0)[place]
            emit[HEADER, s] = edge * (0.002, 0.1, 1.0)[again] * (1.0, 1e-3, 1e-3, 2.0)[num]
            emit[FOLIO, s] = edge * (1e-4, 1.0, 0.04, 1e-4)[num]
            text = (1.0 if place == 2 else 0.3) * (1.0, 0.05, 0.002)[again] * (1.0, 2e-3, 0.02, 0.02)[num]
            emit[BODY, s] = text * (1.0, 0.5, 0.01, 0.01)[on]
            emit[START, s] = text * (0.002, 0.5, 1.0, 1.0)[on]
        emit[:, -1], emit[BREAK], emit[BREAK, -1] = 1e-9, 1e-9, 1.0
        change = np.array([[0.05, 0.2, 0.05, 0.3, 0.4], [0.2, 0.01, 0.05, 0.29, 0.45], [0.01, 0.01, 0.81, 0.13, 0.04], [0.03, 0.03, 0.02, 0.05, 0.87], [0.01, 0.01, 0.81, 0.13, 0.04]])
        self._set(np.array([0.3, 0.1, 0.03, 0.02, 0.55]), change, emit)
        self.seed = emit / emit.sum(axis=1, keepdims=True)

    def _set(self, start: np.ndarray, change: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.change, self.emit = (np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, change, emit))

    def __call__(self, pages: list) -> list[np.ndarray]:
        """The likeliest labels of each page's symbols; pages of like length go through the lines together."""
        sizes = np.array([len(p) for p in pages], np.int64)
        order = np.argsort(-sizes, kind="stable")
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pages)
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            own = own[sizes[own] > 0]
            if not len(own):
                break
            long = int(sizes[own[0]])
            symbols = np.zeros((len(own), long), np.int64)
            for row, k in enumerate(own):
                symbols[row, : sizes[k]] = pages[k]
            total, back = self.start + self.emit.T[symbols[:, 0]], np.zeros((len(own), long, len(STATES)), np.int8)
            for t in range(1, long):
                n = int(np.searchsorted(-sizes[own], -t, "left"))  # pages are sorted, so those with a line t stand first
                step = total[:n, :, None] + self.change
                back[:n, t] = step.argmax(axis=1)
                total[:n] = step.max(axis=1) + self.emit.T[symbols[:n, t]]
            path = np.zeros((len(own), long), np.int64)
            now = total.argmax(axis=1)
            for t in range(long - 1, -1, -1):
                n = int(np.searchsorted(-sizes[own], -t, "left"))
                path[:n, t] = now[:n]
                now[:n] = back[np.arange(n), t, now[:n]] if t else now[:n]
            for row, k in enumerate(own):
                out[k] = path[row, : sizes[k]]
        return out

    def counted(self, pages: list) -> np.ndarray:
        """Starts, changes and symbols on the pages' likeliest paths, in one row of numbers."""
        start, change, emit = np.zeros(5), np.zeros((5, 5)), np.zeros((5, SYMBOLS))
        for symbols, path in zip(pages, self(pages)):
            if len(path):
                start[path[0]] += 1
                np.add.at(change, (path[:-1], path[1:]), 1)
                np.add.at(emit, (path, symbols), 1)
        return np.concatenate([start, change.ravel(), emit.ravel()])

    def refit(self, counts: np.ndarray) -> "Labeller":
        """A round of Viterbi training; the seed shares stay in it as pseudo-counts."""
        start, change, emit = np.exp(self.start) * 20, np.exp(self.change) * 20, self.seed * 400
        self._set(start + counts[:5], change + counts[5:30].reshape(5, 5), emit + counts[30:].reshape(5, SYMBOLS))
        return self

    def fit(self, pages: list) -> "Labeller":
        for _ in range(ROUNDS):
            self.refit(self.counted(pages))
        return self


def _page_rows(pages: DataFrame) -> DataFrame:
    rows = pages.select("attachment_key", F.col("page_number").cast("int").alias("page_number"), "text")
    return rows.filter("attachment_key is not null and page_number is not null").filter(F.col("text").rlike(r"\S")).dropDuplicates(["attachment_key", "page_number"])


def laid_out(pages: DataFrame, confusions: list[tuple[str, str]]) -> DataFrame:
    """(attachment_key, page_number, text, marks): each page with what its end lines recur and run along, and its attachment's number of pages."""
    same = confusion_keys(confusions)

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, p, t in zip(frame["attachment_key"], frame["page_number"], frame["text"]):
                seen: set[str] = set()
                rows.append((a, p, -1, "p", 1))
                for i, keys, numbers in edges(t, same):
                    for token in [*("k" + k for k in keys), *(f"o{o}" for o in {n - p for n in numbers})]:
                        # A page counts once for what two of its lines have.
                        rows.append((a, p, i, token, int(token not in seen)))
                        seen.add(token)
            yield pd.DataFrame(rows, columns=["attachment_key", "page_number", "line", "token", "first"])

    schema = "attachment_key string, page_number int, line int, token string, first int"
    lines = written(pages.mapInPandas(ends, schema), "page-ends")
    again = lines.groupBy("attachment_key", "token").agg(F.sum("first").alias("n")).filter((F.col("n") >= RECURS) | (F.col("token") == "p"))
    # A running line or an attachment may have any number of pages: its rows meet its count in shares.
    again = again.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    met = lines.withColumn("salt", F.pmod("page_number", F.lit(SALTS)).cast("int")).join(again, ["attachment_key", "token", "salt"])
    marks = met.groupBy("attachment_key", "page_number").agg(F.collect_list(F.struct("line", F.substring("token", 1, 1).alias("kind"), "n")).alias("marks"))
    return pages.join(marks, ["attachment_key", "page_number"], "left")


def line_marks(marks) -> tuple[dict[int, int], dict[int, int]]:
    """How a page's lines recur (0 to 2) and on how many pages their numbers run along, by line."""
    recurs: dict[int, int] = {}
    runs: dict[int, int] = {}
    n_pages = 0
    for m in marks if marks is not None else []:
        if m["kind"] == "p":
            n_pages = m["n"]
        else:
            of = recurs if m["kind"] == "k" else runs
            of[m["line"]] = max(of.get(m["line"], 0), m["n"])
    # Twice among many pages may be chance: a running line is on a good part of them.
    return {i: n if n > RECURS or n * 3 >= n_pages else n - 1 for i, n in recurs.items()}, runs


def described(laid: DataFrame) -> DataFrame:
    """(attachment_key, page_number, text, symbols, runs): each page's symbols, and its lines whose numbers run along."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            marks = [line_marks(m) for m in frame["marks"]]
            out = frame[["attachment_key", "page_number", "text"]].copy()
            out["symbols"] = [features(t, recurs, runs) for t, (recurs, runs) in zip(frame["text"], marks)]
            out["runs"] = [sorted(runs) for _, runs in marks]
            yield out

    return laid.mapInPandas(run, "attachment_key string, page_number int, text string, symbols array<int>, runs array<int>")


def fitted(pages: DataFrame) -> Labeller:
    """The model of all pages' symbols: each round sums the counts of every task's pages, so only a fixed number of sums comes to the driver."""
    model = Labeller()
    for _ in range(ROUNDS):

        def run(frames: Iterator[pd.DataFrame], model: Labeller = model) -> Iterator[pd.DataFrame]:
            total = sum(model.counted(frame["symbols"].tolist()) for frame in frames)
            if isinstance(total, np.ndarray):
                yield pd.DataFrame({"place": np.flatnonzero(total), "n": total[total > 0]})

        sums = np.zeros(30 + 5 * SYMBOLS)
        for place, n in pages.select("symbols").mapInPandas(run, "place long, n double").groupBy("place").agg(F.sum("n")).collect():
            sums[place] = n
        model.refit(sums)
    return model


def body(text: str, labels) -> tuple[str, bool]:
    """The page without running lines and folios, with a blank line before each paragraph and nowhere else; and whether its first paragraph carries on the page before."""
    out: list[str] = []
    on = None
    for line, label in zip(text.split("\n"), labels):
        if label == BODY or label == START:
            on = label == BODY if on is None else on
            if label == START and out:
                out.append("")
            out.append(line)
    return "\n".join(out), bool(on)


def words_of(text: str) -> list[str]:
    """Words in lower case, those cut at a line's end made whole."""
    return _WORD.findall(_JOIN.sub("", text).lower())


def split_pairs(text: str, words: list[str], often) -> set[str]:
    """Neighbouring words of a line that are one frequent word together, as 'left right'; marks may stand before the first and after the second."""
    near = {(a, b) for a, b in zip(words, words[1:]) if a + b in often and len(a) + len(b) >= 5 and a.isalpha() and b.isalpha()}
    if not near:
        return set()
    low = _JOIN.sub("", text).lower()
    return {f"{a} {b}" for a, b in near if re.search(rf"(?<![^\s\"“„«»(\[]){re.escape(a)}[^\S\n]+{re.escape(b)}(?![^\s.,;:!?)\]\"”»«…])", low)}


def readings(word: str, confusions: list[tuple[str, str]]) -> set[str]:
    """What a word may have been: one learnt misreading undone, in long words two."""
    def once(w: str) -> set[str]:
        out = set()
        for read, meant in confusions:
            at = w.find(read)
            while at >= 0:
                out.add(w[:at] + meant + w[at + len(read) :])
                at = w.find(read, at + 1)
        return out

    first = once(word)
    both = first | {v for w in first for v in once(w)} if len(word) >= 7 else first
    return both - {word}


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences of every word, summed in each task before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for frame in frames:
            for t in frame["text"]:
                counts.update(words_of(t))
            if len(counts) > 200_000:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = Counter()
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"word": str, "n": "int64"})

    return texts.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def holes(word: str) -> Iterator[tuple[str, str, bool]]:
    """(rest, part, telling): the word without one or two of its characters, those, and whether they tell of a misreading there.

    Endings tell nothing, as words take many of these; a digit in a word does anywhere.
    """
    for size in (1, 2):
        for i in range(len(word) - size + 1):
            if len(word) - size >= AROUND:
                part = word[i : i + size]
                yield word[:i] + "\0" + word[i + size :], part, i + size < len(word) or not part.isalpha()


def _rare(counts: DataFrame) -> DataFrame:
    """The words of Latin letters that some other word can outnumber."""
    top = counts.agg(F.max("n")).first()[0] or 0
    return counts.filter((F.col("n") * RARER <= top) & F.col("word").rlike(r"^[\p{IsLatin}\p{N}]+$") & F.col("word").rlike(r"\p{L}\p{L}"))


def learnt(counts: DataFrame) -> list[tuple[str, str]]:
    """The confusions (read, meant), commonest first: how many rare words part from far more frequent ones by one or two characters. A word counts for a confusion once."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(w, n, *h) for w, n in zip(frame["word"], frame["n"]) if len(w) <= 40 for h in holes(w)]
            yield pd.DataFrame(rows, columns=["word", "n", "rest", "part", "telling"]).astype({"word": str, "n": "int64", "rest": str, "part": str, "telling": bool})

    schema = "word string, n long, rest string, part string, telling boolean"
    rare = _rare(counts).mapInPandas(cut, schema).filter("telling").withColumnsRenamed({"word": "found", "n": "n_found", "part": "read"})
    usual = counts.filter(F.col("n") >= LEAST * 3).mapInPandas(cut, schema).withColumnRenamed("part", "meant")
    pairs = rare.join(usual, "rest").filter("found <> word and read <> meant and length(read) + length(meant) <= 3").filter(F.col("n") >= RARER * F.col("n_found"))
    # Other spellings of the same letters are no misreadings.
    pairs = pairs.filter("replace(found, 'ß', 'ss') <> replace(word, 'ß', 'ss')")
    # The characters themselves differ: what is the same at either end belongs to the rest.
    pairs = pairs.filter("left(read, 1) <> left(meant, 1) and right(read, 1) <> right(meant, 1)")
    seen = pairs.select("found", "read", "meant").distinct().groupBy("read", "meant").agg(F.count("*").alias("words"))
    rows = seen.filter(F.col("words") >= CONFUSED).orderBy(F.desc("words"), "read", "meant").limit(CONFUSIONS).collect()
    return [(r["read"], r["meant"]) for r in rows if r["words"] >= CONFUSED_SHARE * rows[0]["words"]]


def corrections(counts: DataFrame, confusions: list[tuple[str, str]]) -> DataFrame:
    """(found, meant) of misread words. Joins over the vocabulary, none of it is broadcast by hand."""

    def undo(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(w, n, v) for w, n in zip(frame["word"], frame["n"]) if 3 <= len(w) <= 40 for v in readings(w, confusions)]
            yield pd.DataFrame(rows, columns=["found", "n_found", "word"]).astype({"found": str, "n_found": "int64", "word": str})

    often = counts.filter(F.col("n") >= LEAST)
    read = _rare(counts).mapInPandas(undo, "found string, n_found long, word string").join(often, "word").filter(F.col("n") >= RARER * F.col("n_found"))
    read = read.filter("replace(found, 'ß', 'ss') <> replace(word, 'ß', 'ss')")
    return read.groupBy("found").agg(F.max(F.struct("n", "word")).alias("m")).select("found", F.col("m.word").alias("meant"))


def foreign(counts: DataFrame, fixes: DataFrame, confusions: list[tuple[str, str]]) -> dict[str, str]:
    """Letters that no language here writes, with what they were: most occurrences of words that hold one are corrected."""
    single = {x: y for x, y in reversed(confusions) if len(x) == 1 and x.isalpha()}
    if not single:
        return {}
    words = counts.join(fixes.select(F.col("found").alias("word"), F.lit(1).alias("fixed")), "word", "left")
    sums = words.agg(*[F.struct(F.sum(F.when(F.col("word").contains(x), F.col("n"))).alias("all"), F.sum(F.when(F.col("word").contains(x) & F.col("fixed").isNotNull(), F.col("n"))).alias("fixed")).alias(f"c{i}") for i, x in enumerate(single)]).first()
    return {x: y for i, (x, y) in enumerate(single.items()) if (sums[f"c{i}"]["fixed"] or 0) * 2 > (sums[f"c{i}"]["all"] or 0)}


class Fixer:
    """What a text's words are to be corrected to."""

    def __init__(self, often: dict[str, int], meant: dict[str, str], letters: dict[str, str]):
        self.often, self.meant = often, meant
        self.letters, self.strange = letters, re.compile("[" + re.escape("".join(letters)) + "]") if letters else None

    def __call__(self, text: str) -> dict[str, str]:
        words = words_of(text)
        fix = {w: self.meant[w] for w in set(words) & self.meant.keys()}
        for pair in split_pairs(text, words, self.often):
            a, b = pair.split(" ")
            if min(self.often.get(a, 0), self.often.get(b, 0)) * 3 <= self.often[a + b]:
                fix[pair] = a + b
        return fix

    def misread(self, text: str) -> bool:
        return bool(_SPACED.search(text)) or self.strange is not None and bool(self.strange.search(text))


class Scanned:
    """Pages with their labels and the corpus' corrections."""

    def __init__(self, pages: DataFrame, paragraphs: DataFrame | None = None, shared: int = SHARED):
        once = written(_page_rows(pages), "page-texts")
        texts = once.select("text")
        if paragraphs is not None:
            texts = texts.unionByName(paragraphs.filter("text is not null").select("text"))
        counts = written(vocabulary(texts), "page-words")
        self.often = counts.filter(F.col("n") >= LEAST)
        confusions = learnt(counts)
        self.corrections = written(corrections(counts, confusions), "page-corrections")
        self.letters = foreign(counts, self.corrections, confusions)
        self.pages = written(described(laid_out(once, confusions)), "page-symbols")
        context = once.sparkSession.sparkContext
        self.model = context.broadcast(fitted(self.pages))
        #: Whether words and corrections are few enough to go to every task; else they are joined.
        self.few = self.often.count() <= shared and self.corrections.count() <= shared
        often, meant = ({r["word"]: r["n"] for r in self.often.collect()}, {r["found"]: r["meant"] for r in self.corrections.collect()}) if self.few else ({}, {})
        self.fixer = context.broadcast(Fixer(often, meant, self.letters))

    def _fixed(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """`rows` (keys, text, ...) with a column `fix`: each text's corrections where they come by joins, else null."""
        if self.few:
            return rows.withColumn("fix", F.lit(None).cast("map<string,string>"))
        numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "page-rows")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for k, t in zip(frame["_row"], frame["text"]):
                    words = words_of(t)
                    pairs = split_pairs(t, words, {a + b for a, b in zip(words, words[1:])})
                    out += [(k, w, None, None) for w in set(words)] + [(k, p.replace(" ", ""), *p.split(" ")) for p in pairs]
                yield pd.DataFrame(out, columns=["_row", "token", "a", "b"])

        tokens = written(numbered.select("_row", "text").mapInPandas(run, "_row long, token string, a string, b string"), "page-tokens")
        read = tokens.filter("a is null").join(self.corrections.withColumnRenamed("found", "token"), "token").select("_row", "token", "meant")
        n_of = lambda c: self.often.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
        halves = tokens.filter("a is not null").join(n_of("token"), "token").join(n_of("a"), "a", "left").join(n_of("b"), "b", "left")
        halves = halves.filter("least(coalesce(n_a, 0), coalesce(n_b, 0)) * 3 <= n_token").select("_row", F.concat_ws(" ", "a", "b").alias("found"), F.col("token").alias("meant"))
        fixes = read.withColumnRenamed("token", "found").unionByName(halves).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("found", "meant"))).alias("fix"))
        empty = F.create_map().cast("map<string,string>")
        return numbered.join(fixes, "_row", "left").withColumn("fix", F.coalesce("fix", empty)).drop("_row")

    def noise(self) -> DataFrame:
        """(attachment_key, page_number, kind): hyphen, ocr, header and folio, one row per page and kind."""
        model, fixer = self.model, self.fixer

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                paths = model.value(frame["symbols"].tolist())
                for a, p, text, path, runs, fix in zip(frame["attachment_key"], frame["page_number"], frame["text"], paths, frame["runs"], frame["fix"]):
                    lines, labels, runs = text.split("\n"), path.tolist(), set(runs)
                    folio = any(x == FOLIO or x == HEADER and (i in runs or _BESIDE.search(lines[i].strip()) is not None) for i, x in enumerate(labels))
                    ocr = bool(fix) or fixer.value.misread(text) or fix is None and bool(fixer.value(text))
                    kinds = [("header", HEADER in labels), ("folio", folio), ("hyphen", bool(_CUT.search(body(text, labels)[0]))), ("ocr", ocr)]
                    rows += [(a, p, kind) for kind, there in kinds if there]
                yield pd.DataFrame(rows, columns=["attachment_key", "page_number", "kind"])

        # One row a page comes in, so there is nothing to make distinct.
        return self._fixed(self.pages, ["attachment_key", "page_number"]).mapInPandas(run, "attachment_key string, page_number int, kind string")

    def paragraphs(self) -> DataFrame:
        """(attachment_key, page_number, paragraph, text, last_page): repaired paragraphs by the page they begin on, those carried over a page's end joined."""
        model, fixer = self.model, self.fixer

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for a, p, text, path, fix in zip(frame["attachment_key"], frame["page_number"], frame["text"], model.value(frame["symbols"].tolist()), frame["fix"]):
                    inner, on = body(text, path.tolist())
                    own = rebuilt(inner, fixer.value(text) if fix is None else dict(fix), fixer.value.letters)
                    rows += [(a, p, i, t, on and i == 0, i == len(own) - 1 and t[-1] not in _END, len(own)) for i, t in enumerate(own)]
                yield pd.DataFrame(rows, columns=["attachment_key", "page_number", "paragraph", "text", "carried", "open", "n"])

        schema = "attachment_key string, page_number int, paragraph int, text string, carried boolean, open boolean, n int"
        own = written(self._fixed(self.pages, ["attachment_key", "page_number"]).mapInPandas(run, schema), "page-paragraphs")
        return carried_over(own)

    def repaired(self, paragraphs: DataFrame) -> DataFrame:
        """(attachment_key, paragraph_id, text): every paragraph row repaired with the corpus' corrections, one row each; blank ones stay empty."""
        fixer = self.fixer
        whole = paragraphs.filter("paragraph_id is not null and text is not null").groupBy("attachment_key", "paragraph_id").agg(F.max("text").alias("text"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = frame[["attachment_key", "paragraph_id"]].copy()
                out["text"] = ["\n\n".join(rebuilt(t, fixer.value(t) if fix is None else dict(fix), fixer.value.letters)) for t, fix in zip(frame["text"], frame["fix"])]
                yield out

        return self._fixed(whole, ["attachment_key", "paragraph_id"]).mapInPandas(run, "attachment_key string, paragraph_id string, text string")


def carried_over(own: DataFrame) -> DataFrame:
    """Paragraphs of pages, a page's last one joined with the next page's first where that carries it on.

    Neighbouring pages meet by their numbers, so an attachment of any size is no one task's work; where a page is
    one paragraph that is carried on itself, heads are looked up in doubling steps.
    """
    keys = ["attachment_key", "page_number"]
    ends = own.filter("open").select("attachment_key", (F.col("page_number") + 1).alias("page_number"), F.col("paragraph").alias("before"))
    heads = own.filter("carried").join(ends, keys).select(*keys, (F.col("page_number") - 1).alias("head"), F.col("before"), (F.col("open") & (F.col("n") == 1)).alias("through"))
    heads = written(heads, "page-heads")
    while True:
        via = heads.filter("through").select("attachment_key", F.col("page_number").alias("head"), F.col("head").alias("further"), F.col("before").alias("first"))
        moved = heads.join(via, ["attachment_key", "head"], "left")
        if moved.filter("further is not null").isEmpty():
            break
        heads = written(moved.select(*keys, F.coalesce("further", "head").alias("head"), F.coalesce("first", "before").alias("before"), "through"), "page-heads")
    placed = own.join(heads.select(*keys, F.lit(0).alias("paragraph"), "head", "before"), [*keys, "paragraph"], "left")
    parts = placed.select("attachment_key", F.coalesce("head", "page_number").alias("at"), F.coalesce("before", "paragraph").alias("paragraph"), F.struct("page_number", "text").alias("part"))
    whole = parts.groupBy("attachment_key", F.col("at").alias("page_number"), "paragraph").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    cut = rf"(?<=\p{{L}})[{HYPHENS}]\z"
    joined = F.aggregate("parts", F.lit(""), lambda t, p: F.when(t == "", p["text"]).when(t.rlike(cut), F.concat(F.regexp_replace(t, cut, ""), p["text"])).otherwise(F.concat_ws(" ", t, p["text"])))
    return whole.select(*keys, "paragraph", joined.alias("text"), F.element_at("parts", -1)["page_number"].alias("last_page"))


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def rebuilt(text: str, fix: dict[str, str], letters: dict[str, str] | None = None) -> list[str]:
    """Paragraphs of a page's body: cut words whole, lines joined, misread and split words put right."""
    out = []
    for block in re.split(r"\n[ \t]*(?:\n[ \t]*)+", text):
        flat = re.sub(r"\s+", " ", _JOIN.sub("", block)).strip()
        if not flat:
            continue
        flat = _SPACED.sub(lambda m: m.group().replace(" ", ""), flat)
        for found, meant in fix.items():
            if " " in found:
                flat = re.sub(rf"(?i)(?<![^\W_]){re.escape(found)}(?![^\W_])", lambda m, meant=meant: _cased(m.group(), meant), flat)
        flat = _WORD.sub(lambda m: _cased(m.group(), fix[m.group().lower()]) if m.group().lower() in fix else m.group(), flat)
        for strange, meant in (letters or {}).items():
            flat = flat.replace(strange, meant)
        out.append(flat)
    return out
