import numpy as np
import pytest
from pyspark.sql import functions as F

from lumensift.llm import languages as L

BASE = {
    "en": "The reader of this study found that the sample was small and the results were not clear. We asked the teachers about their work in the schools.",
    "de": "Die Leser dieser Studie fanden, dass die Stichprobe klein war und die Ergebnisse nicht klar waren. Wir fragten die Lehrer nach der Arbeit in den Schulen.",
    "fr": "Les lecteurs de cette étude ont trouvé que le groupe était petit et que les résultats ne sont pas clairs. Nous avons demandé aux maîtres dans les écoles.",
    "ru": "Читатели этого исследования нашли, что выборка была мала и результаты не ясны. Мы спросили учителей о работе в школах.",
    "ja": "この研究の読者は標本が小さいと考えた。結果は明確ではなかった。",
}


def rows(spark, extra=()):
    base = [(f"{k}{i}", t, k, f"h{k}", "x") for k, t in BASE.items() for i in range(6)]
    df = spark.createDataFrame([*base, *extra], "key string, text string, label string, host string, main string")
    return L.records(df, "t", "key", "text", "label", "host")


EXTRA = [
    ("none", BASE["en"], None, None, "x"), ("word", BASE["de"], " N/A ", "hde", "x"), ("wrong", BASE["fr"], "en", "hfr", "x"), ("other", BASE["en"], "English", "hen", "x"), ("region", BASE["en"], "en-GB", "hen", "x"),
    ("mixed", BASE["en"] + "\n\n" + BASE["de"], "en", None, "x"), ("null", None, "en", None, "x"), ("blank", "  \n", "en", None, "x"), ("digits", "12 34 5.", "en", None, "x"), ("none", BASE["en"], None, None, "x"),
    ("short", "Der Text", None, "hde", "x"), ("code", BASE["en"] + " 10.55/40c3k3cekd8001f0d64hi5gajeejcf3a9jaja0k0j9hc63e0b8cig06bf6ed344", "en", None, "x"), ("long", (BASE["en"] + " ") * 300, "de", None, "x"),
]


def test_identify(spark):
    found = L.identify(rows(spark, EXTRA))
    got = {}
    for r in found.collect():
        got.setdefault(r.key, []).append((r.stretch, r.lang, r.confidence))
    assert [x[1] for x in sorted(got["mixed"])] == ["en", "de"] and not {"null", "blank", "digits"} & set(got)
    assert got["short"][0][1] == "de" and len(got["none"]) == 1 and all(0 < c <= 1 for v in got.values() for *_, c in v)
    assert [x[1] for x in got["code"]] == ["en"]
    cases = {(r.record_key, r.lang) for r in L.mislabelled(found).collect()}
    assert cases == {("none", "en"), ("word", "de"), ("wrong", "fr"), ("mixed", "en"), ("mixed", "de"), ("short", "de"), ("long", "en")}


@pytest.mark.parametrize("label, want", [("DE ", "de"), ("de-AT", "de"), ("Spanish", "es"), ("zh_CN", "zh"), ("jpn", "ja"), ("und", ""), ("n/a", ""), (None, ""), ("  ", ""), ("Klingon", "klingon")])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "t string").select(L.normal_label(F.col("t")).alias("v")).first().v == want


def test_held_out_accuracy():
    """Fitted on half of the sentences with a fifth of the labels wrong, the other half is told apart."""
    langs = list(BASE)
    train = [(L.tokens(BASE[k]), L.LANGUAGES.index(k if n % 5 else "en")) for k in langs for n in range(10)]
    model = L.Model(train)
    test = {"en": "The teachers were not clear about the small schools.", "de": "Die Lehrer waren nicht klar und die Schulen klein.", "fr": "Les maîtres ne sont pas dans les écoles.", "ru": "Учителя не нашли результаты в школах.", "ja": "読者は結果が小さいと考えた。"}
    scores = L.Scorer(model).scores([L.tokens(t) for t in test.values()])
    assert [L.LANGUAGES[i] for i in scores.argmax(axis=1)] == list(test)


def test_other(spark):
    """Texts in letters of none of the languages are none of them, and have no row among the mislabelled."""
    extra = [("hindi", "इस अध्ययन के पाठकों ने पाया कि नमूना छोटा था और परिणाम स्पष्ट नहीं थे।", None, None, "x"), ("thai", "ผู้อ่าน งานวิจัย พบว่า กลุ่มตัวอย่าง มีขนาดเล็ก " * 3, "tha", None, "x")]
    found = L.identify(rows(spark, extra))
    assert {r.key: r.lang for r in found.filter("key in ('hindi', 'thai')").collect()} == {"hindi": "other", "thai": "other"}
    assert not {r.record_key for r in L.mislabelled(found).collect()} & {"hindi", "thai"}


def test_host_levels(spark):
    """A host's records in other tables and its group's hosts speak for it; a record does not speak for itself."""
    one = spark.createDataFrame([("a", "h", "g", 0), ("b", "h", None, 0), ("c", "i", "g", 1), ("d", None, None, 2)], "key string, host string, grp string, main int")
    hosts, overall, n = L.host_priors(one)
    got = {r.host: (r.own[:3], r.n_host, r.of_group[:3], r.n_group) for r in hosts.collect()}
    assert got == {"h": ([2, 0, 0], 2, [2, 1, 0], 3), "i": ([0, 1, 0], 1, [2, 1, 0], 3)} and n == 4 and abs(sum(overall) - 1) < 1e-9
    short = [("s1", "Der Text", None, "hen", "x")]
    conf = {h: L.identify(rows(spark, [("s1", "Text", None, h, "x")])).filter("key = 's1'").first().lang for h in ("hen", "hde")}
    assert conf == {"hen": "en", "hde": "de"} and short


def test_calibration():
    """Tempered confidences are as often right as they say, where evidence is counted several times over."""
    rng = np.random.default_rng(0)
    n, k = 4000, len(L.LANGUAGES)
    true = rng.integers(0, k, n)
    fair = rng.normal(0, 1, (n, k))
    fair[np.arange(n), true] += 2.0
    # Each word's evidence repeated fourfold: sums are four times too sure.
    declared = np.where(rng.random(n) < 0.1, rng.integers(0, k, n), true)
    heat = L.temperature(fair * 2.0 * 4, declared)
    p = np.exp(fair * 8 / heat)
    p /= p.sum(axis=1, keepdims=True)
    sure = p.max(axis=1)
    right = p.argmax(axis=1) == true
    for low in (0.4, 0.6, 0.8):
        mine = (sure >= low) & (sure < low + 0.2)
        assert abs(right[mine].mean() - sure[mine].mean()) < 0.12


def test_empty(spark):
    assert L.identify(rows(spark).limit(0)).count() == 0
