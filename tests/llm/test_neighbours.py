import numpy as np

from lumensift.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, id string"


def brute(rows, k, least):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.asarray(v, np.float32).astype(float)
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    s = np.round(x @ x.T, 12)
    out = set()
    for a, row in enumerate(s):
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-row[j], ids[j]))[:k]
        out |= {(ids[a], ids[j]) for j in order if row[j] >= least}
    return out


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.standard_normal((n, 16))
    return [(i, v.tolist(), "x") for i, v in enumerate(x)]


def test_recall(spark):
    rows = data(2500)
    got = {(r.a, r.b) for r in N.neighbours(spark.createDataFrame(rows, SCHEMA), k=5, dim=16, least=0.85).collect()}
    want = brute(rows, 5, 0.85)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_tight_group():
    """One group of 20,000 of any tightness: nine in ten of the true ten, from a bounded number of places."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    x = centre / np.linalg.norm(centre) + rng.standard_normal((20_000, 64)) * 0.4 / 8
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    met = set()
    for group in range(N.GROUPS):
        a, b, _ = N.matches(x, ids, group, 10, 0.85)
        assert np.bincount(a).max() <= 10
        met |= set((a * len(x) + b).tolist())
    asked = rng.choice(len(x), 300, replace=False)
    cos = x[asked] @ x.T
    cos[np.arange(300), asked] = -2
    want = {int(q) * len(x) + int(b) for q, row in zip(asked, np.argsort(-cos, axis=1)[:, :10]) for b in row}
    assert len(want & met) >= 0.9 * len(want)


def test_walk():
    """Depths are the longest common prefixes that give enough places; buckets are the runs that share them."""
    rng = np.random.default_rng(1)
    low = rng.standard_normal((700, 16)).astype(np.float32)
    forest = N.trees(low, 0)
    depth = N.depths(forest, 700, 60)

    def held(v, d):
        total = 0
        for order, shared in forest:
            begins, at = N.buckets(shared, d), int(np.flatnonzero(order == v)[0])
            i = int(np.searchsorted(begins, at, "right"))
            total += begins[i] - begins[i - 1]
        return total

    for v in range(0, 700, 53):
        assert held(v, int(depth[v])) >= 60 and (depth[v] == N.BITS or held(v, int(depth[v]) + 1) < 60)


def test_hot_class(spark):
    rows = data(40) + [(1000 + i, data(40)[7][1], "x") for i in range(400)]
    got = {(r.a, r.b) for r in N.neighbours(spark.createDataFrame(rows, SCHEMA), k=3, dim=16, least=0.9).collect()}
    assert got == brute(rows, 3, 0.9)


def test_odd_vectors_and_copies(spark):
    rows = data(60)
    rows += [(100 + i, rows[0][1], "x") for i in range(12)] + [rows[5], (200, None, "x"), (201, [0.0] * 16, "x"), (202, [1.0] * 4, "x"), (203, [float("nan")] + [1.0] * 15, "x"), (204, [None] + [1.0] * 15, "x"), (None, rows[1][1], "x"), (205, [float("inf")] * 16, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.a, r.b) for r in N.neighbours(df, k=3, dim=16).collect()}
    assert got == brute(rows, 3, -1.0)
    assert N.neighbours(df.limit(0), dim=16).count() == 0
    assert N.neighbours(spark.createDataFrame(rows[:1], SCHEMA), dim=16).count() == 0


def test_unlike_neighbours(spark, monkeypatch):
    # Workers keep the module's own REACH, so the vectors are more than the windows of all trees hold.
    monkeypatch.setattr(N, "TILE", 900, raising=False)
    monkeypatch.setattr(N, "TASKS", 4, raising=False)
    x = np.random.default_rng(3).standard_normal((4000, 16)).astype(np.float32)
    got = {(r.a, r.b) for r in N.neighbours(spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA), k=5, dim=16).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    assert got == {(a, int(b)) for a, row in enumerate(np.argsort(-cos, axis=1)[:, :5]) for b in row}
