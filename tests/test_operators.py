import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumensift.config import EngineConfig
from lumensift.operators import chunking, closure, context, diverse, knn, rank, selection


def windows(n, cfg):
    """The windows by stepping."""
    if n <= cfg.chunk_max:
        return [(0, n)]
    w = min(cfg.chunk_target, cfg.chunk_max)
    step, out, start = max(1, w - min(cfg.chunk_overlap, w - 1)), [], 0
    while True:
        end = min(start + w, n)
        if 0 < n - end < cfg.chunk_min:
            end = n
        out.append((start, end))
        if end == n:
            return out
        start += step


def test_window_bounds_closed_form(spark):
    rng = random.Random(3)
    for _ in range(25):
        cfg = EngineConfig(chunk_target=rng.randint(1, 60), chunk_min=rng.randint(0, 30), chunk_max=rng.randint(1, 80), chunk_overlap=rng.randint(0, 40))
        sizes = rng.sample(range(1, 400), 12)
        got = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", chunking.window_bounds(F.col("n"), cfg).alias("w")).collect()
        for r in got:
            assert [(x.begin, x.end) for x in r.w] == windows(r.n, cfg), (cfg, r.n)


def test_chunk_documents(spark):
    cfg = EngineConfig(chunk_target=20, chunk_min=5, chunk_max=25, chunk_overlap=4)
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([("a", "p", "k", text), ("b", "p", "k", " three  little words \n"), ("c", "p", "k", " \x1c "), ("d", "p", "k", None)], "attachment_key string, parent_key string, citation_key string, text string")
    rows = chunking.chunk_documents(df, cfg).orderBy("attachment_key", "chunk_index").collect()
    big = [r.text.split() for r in rows if r.attachment_key == "a"]
    assert all(len(c) <= 25 for c in big) and all(x[-4:] == y[:4] for x, y in zip(big, big[1:]))
    assert [r.text for r in rows if r.attachment_key == "b"] == ["three  little words"]
    assert {r.attachment_key for r in rows} == {"a", "b"}


def test_chunk_pages(spark):
    cfg = EngineConfig(chunk_target=12, chunk_min=2, chunk_max=12, chunk_overlap=2)
    page = lambda n: (n, " ".join(f"p{n}w{i}" for i in range(10)))
    df = spark.createDataFrame([("a", *page(1)), ("a", *page(2)), ("a", *page(3)), ("a", 4, "  "), ("b", 7, "x"), ("b", 8, " "), ("b", 9, "y")], "attachment_key string, page_number int, text string")
    rows = chunking.chunk_pages(df, cfg).orderBy("attachment_key", "chunk_index").collect()
    assert [(r.page_start, r.page_end) for r in rows if r.attachment_key == "a"] == [(1, 2), (2, 3), (3, 3)]
    assert [(r.page_start, r.page_end, r.text) for r in rows if r.attachment_key == "b"] == [(7, 9, "x y")]


def test_knn_and_filters(spark):
    df = spark.createDataFrame([("a", "k1", "Smith; Roe", [1.0, 0.0]), ("b", "k2", "Poe", [1.0, 0.0]), ("c", "k3", "Smithson", [0.0, 1.0]), ("d", "k4", "", None)], "chunk_id string, citation_key string, authors string, embedding array<double>")
    assert [r.chunk_id for r in knn.knn(df, [1.0, 0.1], 2).collect()] == ["a", "b"]
    assert {r.chunk_id for r in df.filter(knn.predicate(knn.Filters(author="Smith, Poe"))).collect()} == {"a", "b", "c"}
    assert {r.chunk_id for r in df.filter(knn.predicate(knn.Filters(citation_key="k1,k2", author="Poe", year=3))).collect()} == {"b"}
    assert knn.predicate(knn.Filters(tag="x")) is None and knn.predicate(None) is None
    left = df.filter("chunk_id = 'a'").select(F.col("chunk_id").alias("src"), F.col("embedding").alias("src_vec"))
    assert [r.chunk_id for r in knn.knn_join(left, df.filter("chunk_id <> 'a'"), 1).collect()] == ["b"]
    every = df.filter("embedding is not null").select(F.col("chunk_id").alias("src"), F.col("embedding").alias("src_vec"))
    whole = sorted(map(tuple, knn.knn_join(every, df, 2).select("src", "chunk_id", "rank").collect()))
    assert sorted(map(tuple, knn.knn_join(every, df, 2, most_left=1).select("src", "chunk_id", "rank").collect())) == whole and len(whole) == 6


def test_ranking_drops_references_and_prefers_matches(spark):
    rows = [("r", "references", "health literacy", 0.99, 0), ("o", "results", "other words", 0.95, 1), ("t", "introduction", "health literacy means skill", 0.80, 2), ("n", None, "health literacy", 0.1, 3)]
    df = spark.createDataFrame(rows, "chunk_id string, section_type string, text string, score double, pos int")
    got = rank.rank_candidates(df, "health literacy").collect()
    assert [r.chunk_id for r in got] == ["t", "o", "n"] and abs(got[0].candidate_score - 1.20) < 1e-9


def test_merge_points(spark):
    rows = [("A  claim.", ["E1"], "short", 0), ("B", ["E2"], "x", 1), ("a claim", ["E3", "E1"], "longer one", 2)]
    df = spark.createDataFrame(rows, "statement string, evidence_ids array<string>, source_excerpt string, pos int")
    got = rank.merge_points(df, []).orderBy("point_id").collect()
    assert [(r.point_id, r.statement, r.evidence_ids, r.source_excerpt) for r in got] == [("P01", "A  claim.", ["E1", "E3"], "longer one"), ("P02", "B", ["E2"], "x")]


def test_group_documents(spark):
    rows = [("c1", "a", "p", "x", "T1", 2000, "l1", 0.5, 1), ("c2", "b", "p", "x", "T2", 2001, "l2", 0.9, 2), ("c3", "a", "p", "x", "T3", 2002, "l3", 0.9, 3), ("c4", "", "par", "x", "T4", None, "l4", 0.1, 4)]
    df = spark.createDataFrame(rows, "chunk_id string, citation_key string, parent_key string, attachment_key string, title string, year int, zotero_link string, score double, pos int")
    got = rank.group_documents(df, 15).collect()
    assert [(r.document, r.chunk_count, r.title, r.zotero_link, r.chunks) for r in got] == [("a", 2, "T1", "l3", ["c3", "c1"]), ("b", 1, "T2", "l2", ["c2"]), ("par", 1, "T4", "l4", ["c4"])]


LIST_ITEM = re.compile(r"\s*(?:[•*+-]|\d+[.)]|[a-z][.)]|\([ivx]+\))", re.I)


def goes_on(left, right):
    left = left.rstrip()
    return left.endswith(":") or LIST_ITEM.match(right) is not None or re.search(r"[.!?][\"')\]]?$", left) is None


def stepped(texts, anchor, before, after, most):
    """The passage of an anchor by walking and folding (texts by index)."""
    low, high = anchor, anchor
    present = [i for i in range(anchor - before, anchor + after + 1) if i in texts]
    low, high = min(present), max(present)
    while low - 1 in texts and goes_on(texts[low - 1], texts[low]):
        low -= 1
    while high + 1 in texts and goes_on(texts[high], texts[high + 1]):
        high += 1
    words, text, used = [], "", []
    for i in sorted(i for i in texts if low <= i <= high and (i in present or i < min(present) or i > max(present))):
        own = texts[i].split()
        n = next((n for n in range(min(75, len(words), len(own)), 3, -1) if words[-n:] == own[:n]), 0)
        rest = own[n:]
        if i != anchor and len(words) + len(rest) > most:
            continue
        joined = " ".join(rest)
        text = texts[i].strip() if not text else text if not rest else (text + ("\n" if LIST_ITEM.match(joined) else " ") + joined).strip()
        words, used = words + rest, [*used, i]
    return text, used


def test_passages_against_stepping(spark):
    """Random chunks with shared borders, lists, gaps and odd budgets, each anchor against the walk."""
    rng = random.Random(8)
    rows, asked = [], []
    for d in range(25):
        at, last, texts = rng.randint(0, 3), [], {}
        for _ in range(rng.randint(1, 7)):
            own = [rng.choice(["tide", "moss", "fern", "lark", "clay", "reed"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 14))]
            own = last[-rng.choice([0, 2, 5, 6]) or len(last) :] + own if last else own
            text = rng.choice(["", "", "", "* ", "b) "]) + " ".join(own) + rng.choice([".", ".", "!", ":", "", '."'])
            texts[at] = text
            last = text.split()
            at += rng.choice([1, 1, 1, 2])
        rows += [(f"d{d}:{i}:h", f"d{d}", t) for i, t in texts.items()]
        asked.append((f"d{d}", texts))
    df = spark.createDataFrame(rows, "chunk_id string, attachment_key string, text string")
    for before, after, most in ((1, 1, 10_000), (0, 0, 30), (2, 1, 22)):
        got = {r.anchor_id: (r.text, [int(c.split(":")[1]) for c in r.context_chunk_ids]) for r in context.expand(df, context.ordered_siblings(df), before, after, most).collect()}
        for d, texts in asked:
            for i in texts:
                assert got[f"{d}:{i}:h"] == stepped(texts, i, before, after, most), (d, i, before, after, most)
    near = {(r.anchor_id, r.chunk_id) for r in context.neighbours(df, context.ordered_siblings(df), 1, 0).collect()}
    assert near == {(f"{d}:{i}:h", f"{d}:{j}:h") for d, texts in asked for i in texts for j in (i - 1, i) if j in texts}


def test_representatives_in_rounds(spark):
    rng = np.random.default_rng(6)
    rows = [(k, f"{k}{i:03d}", i, rng.normal(size=8).tolist()) for k, n in (("big", 60), ("small", 5), ("three", 3)) for i in range(n)] + [("big", "null", 99, None)]
    df = spark.createDataFrame(rows, "citation_key string, chunk_id string, chunk_index int, embedding array<double>")
    whole = sorted(map(tuple, diverse.representatives(df, 4).collect()))
    assert sorted(map(tuple, diverse.representatives(df, 4, whole=10).collect())) == whole and len(whole) == 11


def test_representatives():
    basis = np.repeat(np.eye(3), 4, axis=0) + 0.01 * np.arange(12)[:, None] * np.array([0, 0, 0.01])
    picks = diverse.pick_representatives(basis, 3, 0.2)
    assert {p // 4 for p in picks} == {0, 1, 2}
    assert len(diverse.pick_representatives(np.ones((800, 4)), 15, 0.2)) == 15
    assert diverse.pick_representatives(np.eye(3), 15, 0.2) == [0, 1, 2]


def test_overlaps():
    assert diverse.pick_overlaps(np.array([0.9, 0.8, 0.7, 0.4]), np.array([[1.0, 0], [1, 0], [0, 1], [0, 1]]), 0.65, 2) == [0, 2]


def test_closure(spark):
    rows = [("a", "Reading List", None), ("b", "Sub", "a"), ("c", "Deep", "b"), ("d", "Other", None), ("e", "Loop", "f"), ("f", "Loop2", "e")]
    df = spark.createDataFrame(rows, "key string, name string, parent string")
    assert sorted(r.key for r in closure.descendants(df, ["READING list"]).collect()) == ["a", "b", "c"]
    assert sorted(r.key for r in closure.descendants(df, ["loop"]).collect()) == ["e", "f"]
    assert closure.descendants(df, ["none"]).count() == 0


# Selection on hot keys ------------------------------------------------------------
SCHEMA = "k string, s double, i long, score string, key int"  # two columns with clashing names


def brute(rows, n):
    out = set()
    own = {}
    for k, s, i, *_ in {r[:3] for r in rows}:
        if k and k.strip() and s is not None and s == s:
            own.setdefault(k, set()).add((-s, i))
    for k, v in own.items():
        out |= {(k, i) for _, i in sorted(v)[:n]}
    return out


@pytest.mark.parametrize("levels", [3, 10_000])
def test_top_rows_against_brute_force(spark, levels, monkeypatch):
    monkeypatch.setattr(selection, "GATHER", 4)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = random.Random(levels)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", rng.randint(0, levels) / 7, i, "x", 1) for i in range(700)]
    rows += rows[:60] + [(None, 1.0, 9001, "x", 1), (" ", 1.0, 9002, "x", 1), ("hot", None, 9003, "x", 1), ("hot", float("nan"), 9004, "x", 1), ("few", -5.0, 9005, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.k, r.i) for r in selection.top_rows(df, "k", "s", "i", 3).collect()}
    assert got == brute(rows, 3)


def test_quantiles_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHER", 4)
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", float(rng.randint(-50, 50)) if i % 2 else rng.gauss(0, 1e6), i, "x", 1) for i in range(500)]
    got = {r.k: (r.n, r.q50, r.q90) for r in selection.key_quantiles(spark.createDataFrame(rows, SCHEMA), "k", "s", [0.5, 0.9], "i").collect()}
    for k in {r[0] for r in rows}:
        v = sorted(r[1] for r in rows if r[0] == k)
        assert got[k] == (len(v), v[-(-len(v) * 5 // 10) - 1], v[-(-len(v) * 9 // 10) - 1])


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert selection.top_rows(empty, "k", "s", "i", 3).count() == 0
    assert selection.key_quantiles(empty, "k", "s", [0.5], "i").count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = [("hot", float(i % 50), i, "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(selection, "BROADCAST_STATES", 0)
    monkeypatch.setattr(selection, "GATHER", 4)
    assert {(r.k, r.i) for r in selection.top_rows(df, "k", "s", "i", 5).collect()} == brute(rows, 5)
