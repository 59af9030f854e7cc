import numpy as np
import pytest

from lumensift.llm import garbled as G

TEXT = ["Die größere Prüfung über Öl: „schön“ – und Ärger.", "Le résumé déjà lu à l'été, c'est ça.", "El año pasó así, según María.", "Plain English words, nothing more here.", "Научная работа описывает общую картину."] * 600


@pytest.fixture(scope="module")
def repair():
    s = G.symbols("\n\n".join(TEXT)).astype(np.int64)
    counts = np.bincount(s[:-1] * G.SYMBOLS + s[1:], minlength=G.SYMBOLS**2)
    seen = np.flatnonzero(counts)
    return G.Repairer(G.Model(seen, counts[seen].astype(float)))


@pytest.mark.parametrize("page", ["latin-1", "cp437", "cp850", "mac_roman"])
def test_round_trip(repair, page):
    for text in TEXT[:3]:
        bad = text.encode("utf-8").decode(page)
        (got, done, lost), = repair([bad])
        assert got == text and done > 0 and lost == 0


def test_twice_garbled_and_clean(repair):
    text = TEXT[1]
    assert repair([text.encode().decode("latin-1").encode().decode("latin-1")])[0][0] == text
    assert all(done == 0 and lost == 0 and got == t for t, (got, done, lost) in zip(TEXT[:5], repair(TEXT[:5])))


def test_lost_and_none(repair):
    assert repair(["Die gr��ere Pr�fung"])[0][2] == 2
    assert repair([None, "", "abc"]) == [(None, 0, 0), ("", 0, 0), ("abc", 0, 0)]


def test_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXT)] + [(9000, TEXT[0].encode().decode("latin-1"), 1), (9001, None, 1), (9002, "", 1), (9000, TEXT[0].encode().decode("latin-1"), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair int")
    got = G.restored(df).collect()
    assert {r.doc_id for r in got} == {9000} and len(got) == 2 and got[0].text == TEXT[0]
    assert G.restored(df.limit(0)).count() == 0


def test_segments_against_recursion():
    """The maximum-scoring segments are the best stretch, then the best of what lies on either side of it."""
    rng = np.random.default_rng(2)

    def best(s, low, high):
        top = max(((s[i:j].sum(), i - j, -i, i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0,))
        if top[0] <= 0:
            return []
        *_, i, j = top
        return [*best(s, low, i), (i, j - 1), *best(s, j, high)]

    for _ in range(60):
        s = np.round(rng.normal(-0.3, 1, 24), 6)
        ends, at = np.concatenate([[0.0], np.cumsum(s)]), np.flatnonzero(s > 0)
        assert sorted(G.segments(ends, at, np.zeros(len(at), int))) == best(s, 0, len(s))
    # None goes over a text's end.
    s = np.array([2.0, -0.1, 2.0])
    assert G.segments(np.concatenate([[0.0], np.cumsum(s)]), np.array([0, 2]), np.array([0, 1])) == [(0, 0), (2, 2)]


def test_lost_only_within_runs(repair):
    """U+FFFD counts where the pairs around it are improbable, not by its mere presence."""
    s = G.symbols("\n\n".join(TEXT + ["a � b and a � b again. "] * 3000)).astype(np.int64)
    counts = np.bincount(s[:-1] * G.SYMBOLS + s[1:], minlength=G.SYMBOLS**2)
    seen = np.flatnonzero(counts)
    usual = G.Repairer(G.Model(seen, counts[seen].astype(float)))
    assert usual(["a � b and a � b"])[0][2] == 0 and repair(["a � b and a � b"])[0][2] == 2


@pytest.mark.parametrize("page, text", [("gb18030", "研究结果表明样本很小"), ("cp932", "研究の結果は明確で"), ("big5", "研究結果")])
def test_wide_pages(page, text):
    """UTF-8 read as an East Asian page comes back, where that page has characters for all its bytes."""
    for n in range(len(text), 1, -1):
        try:
            bad = text[:n].encode().decode(page)
        except UnicodeDecodeError:
            continue
        assert G._undo_wide(f"ab {bad} c", page) == (f"ab {text[:n]} c", n)
        return
    assert page == "big5"  # few texts pass through it whole
