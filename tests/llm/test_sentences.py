from lumensift.llm import sentences as S

CASES = {
    "abbr": ("As Dr. A. Roe noted, e.g. in Fig. 3.7, it rose by .5 to 1.2. Then it fell, etc. The end", ["As Dr. A. Roe noted, e.g. in Fig. 3.7, it rose by .5 to 1.2.", "Then it fell, etc.", "The end"]),
    "quote": ("“We went. It was late!” said one of them. “We stayed.” That was all. They asked “why?” and “how?” first.", ["“We went. It was late!” said one of them.", "“We stayed.”", "That was all.", "They asked “why?” and “how?” first."]),
    "marks": ("It ended.[12] 638 readers left.Others stayed (see p. 3). (They did.) iPads helped.", ["It ended.[12]", "638 readers left.", "Others stayed (see p. 3).", "(They did.)", "iPads helped."]),
    "german": ("Die 3. Auflage kostet z. B. 5,30 Euro. „Das ist gut!“, sagte sie. Am 4. Mai usw. Das war es.", ["Die 3. Auflage kostet z. B. 5,30 Euro.", "„Das ist gut!“, sagte sie.", "Am 4. Mai usw.", "Das war es."]),
    "french": ("« Il vient ! » dit-elle, c.-à-d. demain. Est-ce vrai ? « Oui. » Bien.", ["« Il vient ! » dit-elle, c.-à-d. demain.", "Est-ce vrai ?", "« Oui. »", "Bien."]),
    "spanish": ("EE. UU. aportó más. ¿Por qué? ¡La Sra. Roe lo sabe!", ["EE. UU. aportó más.", "¿Por qué?", "¡La Sra. Roe lo sabe!"]),
    "russian": ("«Да!» — сказала она из г. Москва. Письма и т. д. Вместе с тем всё.", ["«Да!» — сказала она из г. Москва.", "Письма и т. д.", "Вместе с тем всё."]),
    "chinese": ("他说：“好。很好。”然后走了。平均分为4.44。", ["他说：“好。很好。”", "然后走了。", "平均分为4.44。"]),
    "japanese": ("参加者は「よい。大事だ。」と述べた。なぜか？そうだ", ["参加者は「よい。大事だ。」と述べた。", "なぜか？", "そうだ"]),
    "hindi": ("डॉ. Roe के अनुसार औसत 6.66 था। क्या यह सच है? हाँ।", ["डॉ. Roe के अनुसार औसत 6.66 था।", "क्या यह सच है?", "हाँ।"]),
    "arabic": ("قال د. Roe إن المتوسط 3.39 نقطة. هل هذا صحيح؟ «نعم!» انتهى.", ["قال د. Roe إن المتوسط 3.39 نقطة.", "هل هذا صحيح؟", "«نعم!»", "انتهى."]),
    "url": ("See www.site.example/a.b and https://x.example. Done... We left", ["See www.site.example/a.b and https://x.example.", "Done...", "We left"]),
}


def test_cases(spark):
    rows = [(k, "p", text, "x") for k, (text, _) in CASES.items()] + [("n", "p", None, "x"), ("e", "p", "", "x"), ("b", "p", " \n ", "x"), ("abbr", "p", CASES["abbr"][0], "x"), ("sp", "p", "  One.  Two  \n", "x"), ("long", "p", "Aa bb. " * 8000, "x"), ("dots", "p", "." * 20_000, "x")]
    df = spark.createDataFrame(rows, "a string, p string, text string, sentence string")
    got = {}
    for r in S.sentences(df, ["a", "p"]).collect():
        got.setdefault(r.a, []).append((r.sentence, r.text, r.sent_end))
    for k, (text, want) in CASES.items():
        own = sorted(got[k])
        assert [t for _, t, _ in own] == want, k
        assert all(text[:e].endswith(t) for _, t, e in own)
    assert [(t, e) for _, t, e in sorted(got["sp"])] == [("One.", 6), ("Two", 11)]
    assert not {"n", "e", "b"} & set(got) and len(got["long"]) == 8000 and len(got["dots"]) == 1


def test_empty(spark):
    assert S.sentences(spark.createDataFrame([], "a string, text string"), ["a"]).count() == 0
