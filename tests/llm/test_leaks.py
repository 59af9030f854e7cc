import numpy as np
import pytest

from lumensift.llm import leaks as L

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"
DOCS = [
    (1, "Start. ONE, two; three-four (five) six seven: eight nine ten 'eleven' twelve! End", "x"),
    (2, "one two three four five six seven eight nine ten eleven", "x"),
    (3, None, "x"), (4, "", "x"), (1, "Start. ONE, two; three-four (five) six seven: eight nine ten 'eleven' twelve! End", "x"),
    (5, "two three four five six seven eight nine ten eleven twelve thirteen", "x"), (6, "İ " + ITEM + " tail of words that stay in the text and more of them " * 3, "x"), (7, "w " * 20_000 + ITEM, "x"),
]
WANT = {(1, 10), (5, 10), (6, 10), (7, 10), (1, 11), (5, 11), (6, 11), (7, 11)}


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM, "q"), (11, "Zero " + ITEM, "q"), (12, "too short", "q"), (13, None, "q"), (10, ITEM, "q")], "item_id long, text string, doc_id string")
    return docs, items


def test_leaks_both_ways(spark):
    docs, items = frames(spark)
    assert sorted(map(tuple, L.leaks(docs, items).collect())) == sorted(WANT)
    assert sorted(map(tuple, L.leaks(docs, items, limit=0).collect())) == sorted(WANT)
    assert L.leaks(docs, items.limit(0)).count() == 0 and L.leaks(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("limit", [L.BROADCAST_CHARS, 0])
def test_removal(spark, limit):
    docs, items = frames(spark)
    rows = {r.doc_id: (r.text, r.n_spans) for r in L.without_leaks(docs, items, limit=limit).collect()}
    assert 5 not in rows and 1 not in rows  # over half of their words leaked
    assert rows[2][1] == 0 and rows[3] == (None, 0) and rows[4] == ("", 0)
    assert rows[6][0].startswith("İ ") and "seven" not in rows[6][0] and rows[6][1] == 1
    assert L.without_leaks(docs.limit(0), items, limit=limit).count() == 0
    assert {r.doc_id for r in L.without_leaks(docs, items.limit(0), limit=limit).collect()} == {d for d, *_ in DOCS}


def test_filter(spark):
    """The filter holds every window of the test set, and few others."""
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1)
    bits = L._bits(hashes)
    held = L._filter(spark.createDataFrame([(int(b),) for b in bits], "bit long"))
    assert int(np.unpackbits(held).sum()) == len(set(bits.tolist())) and ((held[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all()
