"""Problem 4: the language of every record, and of every one-language stretch of a mixed one, with a confidence.

Evidence is fused as log-odds. The text gives a likelihood for each sentence (word and letter-triple
frequencies of the languages); the declared label, the address suffix (where a table has an
address) and the prior of the record's host weigh in for each record. The prior has three levels:
the shares of languages among the host's records by their texts, in whatever table they lie,
smoothed towards those of the host's group, these towards those of all records, all computed by
grouped aggregation and without the record itself. A best path over the sentences, with a price for
each change of language, parts a mixed text into stretches. Text in letters that none of the
languages has is 'other'.

The language model is fitted on at most PER_LANGUAGE labelled records of each language, chosen by a
hash of their keys, and at most FIT_CHARS code points of each; wrong labels in it are outvoted by
refitting on the sentences' own best languages (ROUNDS times). Words of a sentence are not independent,
so their summed evidence is too sure of itself: the confidence is tempered by what was measured on
the half of the sample that a model of the other half had not seen. All records and whole texts are classified.

Null and blank texts and texts without a letter have no language and no rows. Records repeated
under one key count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumensift.io import written

LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl", "ru", "zh", "ja", "other"]
OTHER = len(LANGUAGES) - 1
#: Nats by which a word that shares no letter with any of the languages' words speaks for none of them.
UNLIKE = 2.0
#: Code points of a record in the fit, and temperatures that are tried for the confidence.
FIT_CHARS, TEMPERATURES = 5000, (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0)
#: A host with a thousandth of all records is hot: there are at most a thousand, which every task gets.
HOT_SHARE = 1000
#: Bound on the fit: labelled records of each language, words a record counts for, and refittings.
PER_LANGUAGE, VOICE, ROUNDS = 300, 50, 2
#: Nats that one word may speak against a language, price of a change of language, and least lead and words of a sentence that may open a stretch.
MOST, CHANGE, LEAD, LEAST_WORDS = 5.0, 9.0, 8.0, 4
#: Odds that a declared label or an address suffix is right; pseudo-records of a host.
LABEL_RIGHT, SUFFIX_RIGHT, HOST_PSEUDO = 0.8, 0.6, 5.0
KEPT = 300_000
#: Other notations of the languages, and words for a label that is not known.
NAMES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr",
    "spa": "es", "spanish": "es", "español": "es", "castilian": "es", "ita": "it", "italian": "it", "italiano": "it", "por": "pt", "portuguese": "pt", "português": "pt",
    "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl", "rus": "ru", "russian": "ru", "русский": "ru", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "中文": "zh",
    "jpn": "ja", "jp": "ja", "japanese": "ja", "日本語": "ja",
}
UNKNOWN = ["", "und", "undefined", "undetermined", "unknown", "unk", "n/a", "na", "none", "null", "nil", "mul", "mis", "zxx", "?", "-", "--", "xx", "not known", "other"]
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "ru": "ru", "cn": "zh", "tw": "zh", "jp": "ja"}
#: Letters beside digits (codes, hashes) are no words.
_WORD = re.compile(r"[぀-ヿ]+|[㐀-鿿豈-﫿]+|(?<![0-9])[^\W\d_぀-ヿ㐀-鿿豈-﫿]++(?![0-9])")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_STOP = re.compile(r"(?:[.!?…]+[\"”’»)\]“]*(?=\s)|[。！？]+[”’」』]*|\n\s*\n)\s*")


def normal_label(label: Column) -> Column:
    """A declared label as a code of LANGUAGES; '' for one that is missing or says it is not known; else itself in lower case."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", " ")))
    base = F.regexp_extract(low, r"(?U)^([\p{L}]+)", 1)
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.when(low.isin(UNKNOWN) | (base == ""), "").otherwise(F.coalesce(names[low], names[base], base))


def split(text: str) -> list[tuple[int, int]]:
    """Sentence-like spans, blank ones left out."""
    spans, at = [], 0
    for m in _STOP.finditer(text):
        if text[at : m.end()].strip():
            spans.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        spans.append((at, len(text)))
    return spans


def tokens(text: str) -> list[str]:
    """Words in lower case; each Han or kana sign is one."""
    out: list[str] = []
    for w in _WORD.findall(text.lower()):
        if _WIDE.match(w):
            out += w
        else:
            out.append(w)
    return out


def _triples(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """Evidence of a word: nats by which each language is behind the best, at most MOST."""

    def __init__(self, sentences: list[tuple[list[str], int]], weights: list[float] | None = None):
        words, triples = [Counter() for _ in LANGUAGES], [Counter() for _ in LANGUAGES]
        for k, (own, lang) in enumerate(sentences):
            weight, counts = weights[k] if weights else 1.0, words[lang]
            for w in own:
                counts[w] += weight
        for lang, counts in enumerate(words):
            for w, n in counts.items():
                for t in _triples(w):
                    triples[lang][t] += n
        self.known = np.array([sum(c.values()) for c in words]) > 0
        vocabulary = sorted({w for c in words for w in c})
        self.triples = {t: i for i, t in enumerate(sorted({t for c in triples for t in c}))}
        self.shares = self._table(triples, self.triples, 0.5)
        table = self._table(words, {w: i for i, w in enumerate(vocabulary)}, 0.2)
        self.table = dict(zip(vocabulary, self._evidence(table[:-1])))
        self.letters = {c for w in vocabulary for c in w}

    def _table(self, counts: list[Counter], number: dict[str, int], add: float) -> np.ndarray:
        """Log shares, with a last row for what was never seen."""
        out = np.full((len(number) + 1, len(LANGUAGES)), add)
        for lang, own in enumerate(counts):
            for x, n in own.items():
                out[number[x], lang] += n
        return np.log(out / out.sum(axis=0, keepdims=True))

    def _evidence(self, rows: np.ndarray) -> np.ndarray:
        rows = np.where(self.known, rows, -np.inf)
        return np.maximum(rows - rows.max(axis=1, keepdims=True), -MOST).astype(np.float32)

    def word(self, w: str) -> np.ndarray:
        e = self.table.get(w)
        if e is None:
            places = [self.triples.get(t, -1) for t in _triples(w)]
            if self.letters.isdisjoint(w):
                e = np.full(len(LANGUAGES), -UNLIKE, np.float32)
                e[OTHER] = 0.0
                return e
            e = self._evidence(np.mean(self.shares[places], axis=0)[None])[0]
        return e


class Scorer:
    """Sums of evidence of sentences; a worker remembers words (a full table is begun anew)."""

    def __init__(self, model: Model):
        self.model = model
        self._restart()

    def _restart(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.empty((4096, len(LANGUAGES)), np.float32)

    def numbers(self, own: list[str]) -> list[int]:
        number = self.number
        out = []
        for w in own:
            i = number.get(w)
            if i is None:
                i = number[w] = len(number)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[i] = self.model.word(w)
            out.append(i)
        return out

    def scores(self, lists: list[list[str]]) -> np.ndarray:
        """(sentences, languages)"""
        if len(self.number) > KEPT:
            self._restart()
        flat: list[int] = []
        sizes = np.array([len(own) for own in lists])
        for own in lists:
            flat += self.numbers(own)
        out = np.zeros((len(lists), len(LANGUAGES)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
            out[full] = np.add.reduceat(self.rows[np.array(flat)].astype(np.float64), starts, axis=0)
        return out


def path(scores: np.ndarray, sizes: list[int]) -> list[int]:
    """The languages of a text's sentences: the best path where each change costs CHANGE and stretches without a clear sentence fall to their neighbours."""
    if len(scores) == 1:
        return [int(scores[0].argmax())]
    best = scores.argmax(axis=1)
    if (best == best[0]).all():
        return best.tolist()
    total, back = scores[0].copy(), []
    for row in scores[1:]:
        stay, jump = total, total.max() - CHANGE
        back.append(np.where(stay >= jump, np.arange(len(total)), int(total.argmax())))
        total = np.maximum(stay, jump) + row
    lang = [int(total.argmax())]
    for b in reversed(back):
        lang.append(int(b[lang[-1]]))
    lang.reverse()
    clear = [False] * len(lang)
    for i, row in enumerate(scores):
        second = np.partition(row, -2)[-2]
        clear[i] = sizes[i] >= LEAST_WORDS and row[lang[i]] - second >= LEAD
    main = int(scores.sum(axis=0).argmax())
    out, i = lang[:], 0
    while i < len(lang):
        j = i
        while j < len(lang) and lang[j] == lang[i]:
            j += 1
        if lang[i] != main and not any(clear[i:j]):
            out[i:j] = [main] * (j - i)
        i = j
    return out


def fit(records: DataFrame) -> tuple[Model, float]:
    """The model of (key, text, declared) and its confidence's temperature: a bounded sample to the driver, nothing else."""
    labelled = records.filter(F.col("declared").isin(LANGUAGES[:OTHER]))
    pick = F.row_number().over(W.partitionBy("declared").orderBy(F.xxhash64("key"), "key"))
    sample = labelled.withColumn("_n", pick).filter(F.col("_n") <= PER_LANGUAGE).select("declared", F.substring("text", 1, FIT_CHARS).alias("text")).collect()
    parts, weights, halves = [], [], []
    for n, r in enumerate(sample):
        own = [p for b, e in split(r.text) if (p := tokens(r.text[b:e]))]
        # A record speaks for at most VOICE words, so that no long text with a wrong label outweighs many others.
        weights += [min(1.0, VOICE / sum(map(len, own)))] * len(own)
        parts += [(p, LANGUAGES.index(r.declared)) for p in own]
        halves += [n % 2] * len(own)
    model = _refitted(parts, weights)
    seen, kept = [[x for x, h in zip(parts, halves) if h == half] for half in (0, 1)]
    if not seen or not kept:
        return model, 1.0
    half = _refitted(seen, [w for w, h in zip(weights, halves) if h == 0])
    return model, temperature(Scorer(half).scores([own for own, _ in kept]), np.array([lang for _, lang in kept]))


def _refitted(parts: list[tuple[list[str], int]], weights: list[float]) -> Model:
    model = Model(parts, weights)
    for _ in range(ROUNDS):
        best = Scorer(model).scores([own for own, _ in parts]).argmax(axis=1)
        model = Model([(own, int(lang)) for (own, _), lang in zip(parts, best)], weights)
    return model


def temperature(scores: np.ndarray, declared: np.ndarray) -> float:
    """The temperature under which held-out labels are likeliest, a share of them being wrong at random."""
    def loss(t: float, wrong: float) -> float:
        z = scores / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p[np.arange(len(p)), declared] / p.sum(axis=1)
        return -float(np.log((1 - wrong) * p + wrong / len(LANGUAGES)).mean())

    return min((loss(t, wrong), t) for t in TEMPERATURES for wrong in (0.01, 0.02, 0.05, 0.1, 0.2, 0.3))[1]


def _stretches(records: DataFrame, model: Model) -> DataFrame:
    """(table, key, declared, host, suffix, stretches) by the text alone: array of (begin, end, words, scores)."""
    shared = records.sparkSession.sparkContext.broadcast(model)
    schema = "source string, key string, declared string, host string, grp string, suffix string, main int, stretches array<struct<begin:int,end:int,lang:int,scores:array<double>>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in frames:
            texts = frame["text"].tolist()
            for at in range(0, len(texts), 500):
                block = texts[at : at + 500]
                spans = [split(t) for t in block]
                lists = [tokens(t[b:e]) for t, own in zip(block, spans) for b, e in own]
                scores = scorer.scores(lists)
                rows, n = [], 0
                for own in spans:
                    mine, sizes = scores[n : n + len(own)], [len(x) for x in lists[n : n + len(own)]]
                    n += len(own)
                    if not sum(sizes):
                        rows.append((None, []))
                        continue
                    langs, parts, i = path(mine, sizes), [], 0
                    while i < len(own):
                        j = i
                        while j < len(own) and langs[j] == langs[i]:
                            j += 1
                        parts.append((own[i][0], own[j - 1][1], langs[i], mine[i:j].sum(axis=0).tolist()))
                        i = j
                    rows.append((int(mine.sum(axis=0).argmax()), parts))
                out = frame.iloc[at : at + 500][["source", "key", "declared", "host", "grp", "suffix"]].copy()
                out["main"] = pd.array([m for m, _ in rows], dtype="Int32")
                out["stretches"] = [[{"begin": b, "end": e, "lang": lang, "scores": s} for b, e, lang, s in parts] for _, parts in rows]
                yield out[out["main"].notna().to_numpy()]

    return records.select("source", "key", "declared", "host", "grp", "suffix", "text").mapInPandas(run, schema)


def records(df: DataFrame, source: str, key: str, text: str, label: str | None, host: str | None, address: str | None = None, group: Column | None = None) -> DataFrame:
    """One table's rows in the operator's form. The address's last label is its suffix; a host's group need stand in one of its records only."""
    suffix = F.regexp_extract(F.lower(F.col(address)), r"^(?:[a-z]+://)?[^/:?#]*\.([a-z]{2,})(?:[/:?#]|$)", 1) if address else F.lit("")
    return df.select(
        F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), normal_label(F.col(label) if label else F.lit(None).cast("string")).alias("declared"),
        (F.col(host) if host else F.lit(None)).cast("string").alias("host"), (group if group is not None else F.lit(None)).cast("string").alias("grp"), suffix.alias("suffix"), F.col(text).alias("text"),
    ).filter("key is not null").filter(F.col("text").rlike(r"\p{L}"))


def host_priors(by_text: DataFrame) -> tuple[DataFrame, list[float], int]:
    """((host, own, n_host, of_group, n_group), shares of all records, number of records): languages counted by host and by the host's group.

    Sums are made in each task first; no host's or group's records are gathered.
    """
    places = range(len(LANGUAGES))
    counts = by_text.groupBy("host", "main").agg(F.count("*").alias("n"), F.min("grp").alias("grp"))
    every = {r.main: r.n for r in counts.groupBy("main").agg(F.sum("n").alias("n")).collect()}
    n = sum(every.values())
    overall = [(every.get(i, 0) + 1) / (n + len(LANGUAGES)) for i in places]
    sums = F.array(*[F.sum(F.when(F.col("main") == i, F.col("n")).otherwise(0)) for i in places])
    hosts = counts.filter("host is not null").groupBy("host").agg(sums.alias("own"), F.sum("n").alias("n_host"), F.min("grp").alias("grp"))
    of_group = F.array(*[F.sum(F.get("own", F.lit(i))) for i in places])
    groups = hosts.filter("grp is not null").groupBy("grp").agg(of_group.alias("of_group"), F.sum("n_host").alias("n_group"))
    # A group may hold any number of hosts: its sums meet them in shares.
    shares = 16
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    both = hosts.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(shares)).cast("int")).join(salted, ["grp", "salt"], "left")
    return both.select("host", "own", "n_host", "of_group", "n_group"), overall, n


def identify(rows: DataFrame) -> DataFrame:
    """(source, key, declared, stretch, begin, end, lang, confidence, n_langs): one row per one-language stretch of each record."""
    model, heat = fit(rows)
    by_text = written(_stretches(rows, model).dropDuplicates(["source", "key"]), "languages")
    hosts, overall, total = host_priors(by_text)
    hosts = written(hosts, "language-hosts")
    base = F.array(*[F.lit(p) for p in overall])
    index = F.sequence(F.lit(0), F.lit(OTHER))
    # A record's own text is left out of the counts of its host and group, so that it does not speak twice.
    self_out = lambda sums, i: F.coalesce(F.get(sums, i), F.lit(0)) - F.when(F.col(sums).isNotNull() & (F.col("main") == i), 1).otherwise(0)
    group_share = lambda i: (self_out("of_group", i) + HOST_PSEUDO * F.get(base, i)) / (F.coalesce(F.col("n_group"), F.lit(1)) - 1 + HOST_PSEUDO)
    shares = F.transform(index, lambda i: F.log((self_out("own", i) + HOST_PSEUDO * group_share(i)) / (F.coalesce(F.col("n_host"), F.lit(1)) - 1 + HOST_PSEUDO)))
    names = F.array(*[F.lit(x) for x in LANGUAGES])
    miss = math.log((1 - LABEL_RIGHT) / (len(LANGUAGES) - 1) / LABEL_RIGHT), math.log((1 - SUFFIX_RIGHT) / (len(LANGUAGES) - 1) / SUFFIX_RIGHT)
    suffixes = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    said, place = F.col("declared"), suffixes[F.col("suffix")]
    prior = F.transform(index, lambda i: F.get("host_shares", i)
        + F.when(said.isin(LANGUAGES) & (said != F.get(names, i)), miss[0]).otherwise(0.0)
        + F.when(place.isNotNull() & (place != F.get(names, i)), miss[1]).otherwise(0.0))
    # Hot hosts are few by their definition and go to every task, so that none of their records move for them.
    hot = F.broadcast(hosts.filter(F.col("n_host") * HOT_SHARE >= total))
    cold = hosts.filter(F.col("n_host") * HOT_SHARE < total)
    met = by_text.join(hot, "host").unionByName(by_text.join(hot.select("host"), "host", "left_anti").join(cold, "host", "left"))
    fused = met.withColumn("host_shares", shares).withColumn("prior", prior)
    parts = fused.select("source", "key", "declared", "prior", F.posexplode("stretches").alias("stretch", "s"))
    odds = parts.withColumn("odds", F.zip_with("s.scores", "prior", lambda a, b: a + b)).withColumn("top", F.array_max("odds"))
    odds = odds.withColumn("lang", F.get(names, F.array_position("odds", F.col("top")).cast("int") - 1))
    odds = odds.withColumn("confidence", 1 / F.aggregate("odds", F.lit(0.0), lambda t, x: t + F.exp((x - F.col("top")) / heat)))
    n = F.size(F.collect_set("lang").over(W.partitionBy("source", "key")))
    return odds.select("source", "key", "declared", "stretch", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"), "lang", "confidence").withColumn("n_langs", n)


def mislabelled(found: DataFrame) -> DataFrame:
    """(record_table, record_key, lang): the languages of records whose label is missing or wrong, or whose text has several. 'other' has no row, as it names none."""
    case = (F.col("declared") == "") | (F.col("n_langs") > 1) | (F.col("declared") != F.col("lang"))
    return found.filter(case).filter("lang <> 'other'").select(F.col("source").alias("record_table"), F.col("key").alias("record_key"), "lang").distinct()
