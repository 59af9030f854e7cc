"""Problem 6: near-duplicate texts by a multi-index Hamming join over min-hash signatures.

A text's signature is SLOTS min-hashes of its shingles (SHINGLE consecutive words, a word
being the longest run of letters and digits of the lower-cased text). The distance of two
signatures is the number of slots in which they differ. Signatures are split into PARTS
chunks; if two differ in at most RADIUS slots, by pigeonhole some chunk differs in no more
than its share of errors, so each chunk is indexed under every way of leaving out that many
slots and all pairs within RADIUS meet, exactly. An exact check of the shingles follows.

A key that more than HOT texts share (templates, licences) is not joined: its texts are laid out in
blocks and each two blocks are one task's comparison of signatures, in which a pair is given at its
first common key alone; so a pair of a hot group comes up once, and no task sees a whole group.

Texts with the same words form one class and are joined once, through a representative;
so copies cost one row each, however many there are. In pairs() each copy is paired with the first
COPIES ids of its class and of the classes linked with it, whatever a class's size; up to that many
copies these are all pairs, and of more they still hold every member and every link between
different texts, in proportion to the rows.

Null, empty and texts of fewer than SHINGLE words have no shingles and no part in it.
Rows repeated under one chunk_id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.io import written

#: Slots, chunks they are split into, and the signature distance within which every pair is found.
SLOTS, PARTS, RADIUS = 20, 4, 10
#: Beyond this distance a pair that met by chance is not compared (at a similarity of 0.7 six in a million lie there).
FAR = 15
#: First ids of a class that stand for it in pairs.
COPIES = 100
#: Texts that may share a key of the join, texts of a block beyond it, and shares in which keys meet their counts.
HOT, HOT_BLOCK, SALTS = 200, 2000, 16
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def chunk_errors() -> list[int]:
    """Errors each chunk must allow so that RADIUS errors cannot exceed every chunk's: sum (e + 1) > RADIUS."""
    base, extra = divmod(RADIUS + 1, PARTS)
    return [base - 1 + (i < extra) for i in range(PARTS)]


def index_keys() -> list[list[int]]:
    """The slots of every key: of each chunk, every choice that leaves out its allowed errors."""
    size = SLOTS // PARTS
    return [list(kept) for part, errors in enumerate(chunk_errors()) for kept in combinations(range(part * size, (part + 1) * size), size - errors)]


class Hasher:
    """Word and shingle hashes; a worker remembers the words it has seen (a full table is begun anew)."""

    KEPT = 500_000

    def __init__(self, shingle: int):
        self.shingle, self.known = shingle, {}
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
        self.terms = rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)

    def values(self, own: list[str]) -> list[int]:
        known = self.known
        out = []
        for w in own:
            h = known.get(w)
            if h is None:
                if len(known) >= self.KEPT:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out

    def shingles(self, values: np.ndarray) -> np.ndarray:
        """Hashes of all runs of `shingle` neighbouring values."""
        n = max(0, len(values) - self.shingle + 1)
        total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.shingle):
                total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + values[j : j + n]
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(32)
        return total

    def signatures(self, lists: list[list[str]]) -> np.ndarray:
        """(texts, SLOTS) min-hashes; each text must have at least `shingle` words."""
        flat: list[int] = []
        for own in lists:
            flat += self.values(own)
        sizes = np.array([len(own) for own in lists])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        hashes = self.shingles(np.array(flat, np.uint64))
        # Runs that reach into the next text are taken out.
        inside = np.ones(len(hashes), bool)
        for j in range(1, self.shingle):
            at = begins[1:] - j
            inside[at[at < len(hashes)]] = False
        hashes = hashes[inside]
        starts = np.concatenate([[0], np.cumsum(sizes - self.shingle + 1)[:-1]])
        out = np.empty((len(lists), SLOTS), np.uint32)
        with np.errstate(over="ignore"):
            for k in range(SLOTS):
                mixed = ((hashes * self.factors[k] + self.terms[k]) >> np.uint64(32)).astype(np.uint32)
                out[:, k] = np.minimum.reduceat(mixed, starts)
        return out


def _batches(texts: list[str | None], shingle: int, most: int = 400_000) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Texts with shingles, some `most` words at a time."""
    at, lists, n = [], [], 0
    for k, text in enumerate(texts):
        own = words(text) if text else []
        if len(own) >= shingle:
            at.append(k)
            lists.append(own)
            n += len(own)
            if n > most:
                yield at, lists
                at, lists, n = [], [], 0
    if at:
        yield at, lists


def signed(docs: DataFrame, shingle: int, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, c1, c2, sig): each id once, its class (two halves of a hash of its words) and signature. Texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for batch in batches:
            ids = batch.column(0)
            for at, lists in _batches(batch.column(1).to_pylist(), shingle):
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest("\x1f".join(own)) for own in lists), np.int64).reshape(-1, 2)
                sigs = hasher.signatures(lists).view(np.int32)
                ends = pa.array(np.arange(0, sigs.size + 1, SLOTS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(ends, pa.array(sigs.ravel()))], names=["id", "c1", "c2", "sig"]
                )

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return source.mapInArrow(run, "id string, c1 long, c2 long, sig array<int>").dropDuplicates(["id"])


def candidates(reps: DataFrame, hot: int = HOT, block: int = HOT_BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, of representatives (rep, sig) that share an index key and differ in at most FAR slots."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), *[F.col("sig")[s] for s in slots]).alias("k")) for i, slots in enumerate(index_keys())])
    index = reps.select("rep", F.explode(keys).alias("x")).select("rep", "x.i", "x.k")
    # Most keys are one text's own: only those of several go on, met in shares as a key may be that of any number of texts.
    counts = index.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = written(index.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(counts, ["k", "salt"]).drop("salt"), "neardup-index")
    cold = shared.filter(F.col("n") <= hot).select("rep", "k")
    met = cold.alias("x").join(cold.alias("y"), "k").filter("x.rep < y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    with_a = met.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = with_a.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    differ = F.aggregate(F.zip_with("sig_a", "sig_b", lambda p, q: (p != q).cast("int")), F.lit(0), lambda t, v: t + v)
    found = both.filter(differ <= FAR).select("a", "b")
    many = shared.filter(F.col("n") > hot)
    return found if many.isEmpty() else found.unionByName(_in_blocks(many.join(reps, "rep"), block)).distinct()


def close(x: np.ndarray, y: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) of the pairs of signatures within FAR that have `key` as their first common key."""
    same = np.zeros((len(x), len(y)), np.uint8)
    for slot in range(SLOTS):
        same += x[:, slot, None] == y[None, :, slot]
    a, b = np.nonzero(same >= SLOTS - FAR)
    equal = x[a] == y[b]
    slots = index_keys()
    first = equal[:, slots[key]].all(axis=1)
    for before in range(key):
        first &= ~equal[:, slots[before]].all(axis=1)
    return a[first], b[first]


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of texts (rep, sig) that share a key (k, the i-th, of n texts): each two blocks of a key's texts are compared in one task."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("i", "k", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "sig")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        low, high, key = int(frame["low"].iloc[0]), int(frame["high"].iloc[0]), int(frame["i"].iloc[0])
        reps, sig = frame["rep"].to_numpy(object), np.stack(frame["sig"].to_list())
        left, right = np.flatnonzero(frame["own"].to_numpy() == low), np.flatnonzero(frame["own"].to_numpy() == high)
        out: list[tuple[str, str]] = []
        for at in range(0, len(left), 500):
            own = left[at : at + 500]
            a, b = close(sig[own], sig[right], key)
            out += [(p, q) if p < q else (q, p) for p, q in zip(reps[own[a]], reps[right[b]]) if p < q or low != high and q < p]
        return pd.DataFrame(out, columns=["a", "b"])

    return placed.groupBy("k", "low", "high").applyInPandas(compare, "a string, b string")


def similar(pairs: DataFrame, docs: DataFrame, shingle: int, least: float, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b, similarity) of at least `least`, by their shingles themselves."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sets(text: str) -> set:
            own = words(text)
            return set(zip(*(own[j:] for j in range(shingle))))

        for frame in frames:
            kept: dict[str, set] = {}
            rows = []
            for a, b, ta, tb in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"]):
                if len(kept) > 2000:
                    kept.clear()
                sa = kept[a] if a in kept else kept.setdefault(a, sets(ta))
                sb = kept[b] if b in kept else kept.setdefault(b, sets(tb))
                both = len(sa & sb)
                if both >= least * (len(sa) + len(sb) - both):
                    rows.append((a, b, both / (len(sa) + len(sb) - both)))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity"])

    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(involved, "id", "left_semi").dropDuplicates(["id"])
    texts = written(texts, "neardup-texts")
    held = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return held.mapInPandas(check, "a string, b string, similarity double")


class NearDuplicates:
    """Classes of equal texts (`members`: id, rep) and the links between their representatives (`links`: a, b, similarity)."""

    def __init__(self, docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "chunk_id", text_col: str = "text"):
        rows = written(signed(docs, shingle, id_col, text_col), "neardup-signed")
        classes = rows.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"))
        classes = written(classes, "neardup-classes")
        #: Only classes of several texts need the join; a class of one is its own representative.
        several = classes.filter("n > 1").select("c1", "c2", "rep", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        copies = rows.select("id", "c1", "c2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(several, ["c1", "c2", "salt"]).select("id", "rep", "n")
        self.copies = written(copies, "neardup-copies")
        self.classes = classes.select("rep", "n")
        found = written(candidates(classes.select("rep", "sig")), "neardup-pairs")
        self.links = written(similar(found, docs, shingle, least, id_col, text_col), "neardup-links")

    def pairs(self, copies: int = COPIES) -> DataFrame:
        """(chunk_a, chunk_b) of linked ids, a copy with the first `copies` ids of its class and of the classes linked with it."""
        side = self.copies.select("id", "rep")
        first = written(side.withColumn("_n", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("_n") <= copies).drop("_n"), "neardup-first")
        links = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Every link is gone through from both its ends: first ids of the one class, all of the other.
        from_first = links.join(first.select(F.col("rep").alias("a"), F.col("id").alias("p")), "a", "left").select(F.coalesce("p", "a").alias("p"), "b")
        linked = _shared(from_first, side, "b")
        within = _shared(first.select(F.col("id").alias("p"), F.col("rep").alias("b")), side, "b").filter("p <> q")
        return linked.unionByName(within).select(F.least("p", "q").alias("chunk_a"), F.greatest("p", "q").alias("chunk_b")).distinct()

    def groups(self) -> DataFrame:
        """(id, class_id, n_copies, n_links): every text with shingles, its class of equal texts and the class's links to others."""
        degree = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        classes = self.classes.join(degree, "rep", "left").select("rep", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        many = self.copies.select("id", "rep").join(classes.filter("n > 1"), "rep")
        one = classes.filter("n = 1").withColumn("id", F.col("rep"))
        return many.unionByName(one, allowMissingColumns=True).select("id", F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), "n_links")


def _shared(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(p, q): rows (p, key) with all members (id) of their class (the key itself where it has none), a class's members in SALTS shares."""
    salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = members.select(F.col("rep").alias(key), F.col("id").alias("q"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    alone = rows.join(members.select(F.col("rep").alias(key)).distinct(), key, "left_anti").select("p", F.col(key).alias("q"))
    return salted.join(own, [key, "salt"]).select("p", "q").unionByName(alone)
