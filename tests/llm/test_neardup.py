import random

import numpy as np
from pyspark.sql import functions as F

from lumensift.llm import neardup as N

SCHEMA = "chunk_id string, text string, rep string"


def shingles(text, n):
    w = N.words(text or "")
    return set(zip(*(w[j:] for j in range(n))))


def brute(rows, n, least):
    sets = {k: shingles(t, n) for k, t, _ in rows if k is not None}
    keys = sorted(k for k, s in sets.items() if s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def collection(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        for c in range(rng.randint(1, 5)):
            own = base[:]
            for _ in range(rng.randint(0, max(1, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((f"g{g:02d}c{c}", " ".join(own), "x"))
    return rows


def test_against_brute_force(spark):
    rows = collection(1)
    rows += [("copy1", rows[0][1].upper() + "!", "x"), ("copy2", rows[0][1], "x"), rows[3], ("none", None, "x"), ("empty", "", "x"), ("two", "two words", "x"), (None, rows[0][1], "x"), ("long", "z y x " * 9000, "x"), ("long2", "z y x " * 9000, "x")]
    found = N.NearDuplicates(spark.createDataFrame(rows, SCHEMA), shingle=3, least=0.7)
    want = brute(rows, 3, 0.7)
    assert {tuple(r) for r in found.pairs().collect()} == want
    groups = {r.id: r for r in found.groups().collect()}
    assert set(groups) == {k for k, t, _ in rows if k and shingles(t, 3)}
    assert groups["long2"].class_id == "long" and groups["copy1"].n_copies == 3 == groups["g00c0"].n_copies
    # A copy is paired with the first ids of its class alone: every member, and every link between different texts.
    few = {tuple(r) for r in found.pairs(copies=1).collect()}
    assert few <= want and ("copy1", "copy2") in few and ("copy1", "g00c0") in few and ("copy2", "g00c0") not in few
    rep = {r.id: r.class_id for r in found.groups().collect()}
    assert {(rep[a], rep[b]) for a, b in few if rep[a] != rep[b]} | {(rep[b], rep[a]) for a, b in few} >= {(rep[a], rep[b]) for a, b in want if rep[a] != rep[b]}


def test_hot_keys(spark):
    """Templates that share most keys are compared in blocks, with the same pairs as by the join."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for c in range(90):
        own = base[:]
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        rows.append((f"c{c:02d}", " ".join(own), "x"))
    reps = N.signed(spark.createDataFrame(rows, SCHEMA), 3).select(F.col("id").alias("rep"), "sig")
    whole = {tuple(r) for r in N.candidates(reps, hot=10**6).collect()}
    assert whole and {tuple(r) for r in N.candidates(reps, hot=3, block=20).collect()} == whole


def test_empty(spark):
    found = N.NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_pigeonhole():
    """Any two signatures within RADIUS share a key."""
    assert sum(e + 1 for e in N.chunk_errors()) > N.RADIUS
    rng = np.random.default_rng(0)
    keys = N.index_keys()
    for _ in range(2000):
        differ = set(rng.choice(N.SLOTS, N.RADIUS, replace=False).tolist())
        assert any(not differ & set(k) for k in keys)
