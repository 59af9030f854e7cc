import random
import re

from lumensift.llm import pieces as P


def sentence(rng):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "word"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 25))) + "."


def document(rng, n):
    return "".join(sentence(rng) + ("\n\n" if rng.random() < 0.2 else " ") for _ in range(n))


def count(t):
    return len(re.findall(r"[^ \t\r\n]+", t))


def ends(text):
    return [m.end() for m in re.finditer(r"[.。]", text)]


def check(text):
    cutter = P.Cutter(text, ends(text))
    out = cutter.pieces()
    assert out[0][0] == 0 and out[-1][1] == len(text)
    for i, (b, e) in enumerate(out):
        assert count(text[b:e]) <= P.MAX_WORDS and 0 < e - b <= P.MAX_CHARS
        if i:
            assert b <= out[i - 1][1] < e and b > out[i - 1][0]
    return cutter, out


def test_limits_overlap_and_boundaries():
    rng = random.Random(5)
    for n in (60, 90, 200):
        text = document(rng, n)
        cutter, out = check(text)
        for (_, e), (b, _) in zip(out, out[1:]):
            assert count(text[b:e]) == P.OVERLAP
            assert e in cutter.paragraphs or e in cutter.sentences


def test_odd_texts():
    for text in ["x" * 20_000, "字" * 9000, "字。" * 7000, " \n" * 9000, "a " * 30_000, "a " * 5000]:
        check(text)


def test_edits_stay_local():
    rng = random.Random(6)
    text = document(rng, 300)
    pieces = {text[b:e] for b, e in P.Cutter(text, ends(text)).pieces()}
    edited = text[:400] + " some new words here" + text[400:]
    again = {edited[b:e] for b, e in P.Cutter(edited, ends(edited)).pieces()}
    assert len(pieces - again) <= 3


def test_rows(spark):
    rng = random.Random(7)
    text = document(rng, 120)
    paras = [f"p{i}" for i in range(len([p for p in re.split(r"\n\s*\n", text) if p.strip()]))]
    rows = [("big", text, ["p0:s1"], paras, "x"), ("big", text, ["p0:s1"], paras, "x"), ("small", "few words", [], [], "x"), ("none", None, None, None, "x"), ("bare", "字" * 6001, None, [None], "x"), (None, text, [], [], "x"), ("words", "w " * 801, [], [], "x"), ("limit", "w " * 800, [], [], "x"), ("blank", " \n" * 4000, ["s"], ["p"], "x")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, sentence_ids array<string>, paragraph_ids array<string>, piece string")
    got = P.pieces(df).collect()
    assert {r.chunk_id for r in got} == {"big", "bare", "words", "blank"}
    big = sorted((r for r in got if r.chunk_id == "big"), key=lambda r: r.piece)
    assert sorted({p for r in big for p in r.paragraph_ids}) == sorted(paras) and big[0].paragraph_ids[0] == "p0"
    assert P.pieces(df.limit(0)).count() == 0


def test_overlap_of_long_words():
    """Words of 40 points: 75 of them are 3,075 points, which neighbours share whole."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(40)) for _ in range(700))
    _, out = check(text)
    assert all(count(text[b:e]) == P.OVERLAP for (_, e), (b, _) in zip(out, out[1:]))


def test_ids_of_units(spark):
    """Ids follow the sentence operator's units (an abbreviation ends none); another number of units than ids is said."""
    part = "As Dr. Roe noted, the sample was small. It grew later.\n\n"
    text = (part * 200).strip()
    ids = [f"p{i}:s{j}" for i in range(200) for j in (1, 2)]
    paras = [f"p{i}" for i in range(200)]
    rows = [("fits", text, ids, paras), ("fewer", text, ids[:-1], paras)]
    got = {}
    for r in P.pieces(spark.createDataFrame(rows, "chunk_id string, text string, sentence_ids array<string>, paragraph_ids array<string>")).collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert all(r.ids_exact for r in got["fits"]) and not any(r.ids_exact for r in got["fewer"])
    for r in got["fits"]:
        n = len([x for x in re.split(r"(?<=small\.)|(?<=later\.)", r.text) if x.strip()])
        assert len(r.sentence_ids) == n and r.sentence_ids == [s for s in ids if s in r.sentence_ids]
