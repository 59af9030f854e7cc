import random

import pytest

from lumensift.llm import pages as P

WORDS = "the reader found that sample results were clear and funding theme numeracy questionnaire outlined among schools percent several national teachers village".split()


def page(rng, n_lines=12):
    lines = [" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(n_lines)]
    lines[4], lines[5], lines[6], lines[-1] = lines[4] + ".", "", lines[6].capitalize(), lines[-1] + "."
    lines[0] = lines[0].capitalize()
    return lines


def attachments(seed=0):
    rng = random.Random(seed)
    rows, truth = [], set()
    for a in range(6):
        scanned = a < 3
        for n in range(1, 9):
            body = page(rng)
            if scanned:
                if n % 2:
                    body[2] = body[2] + " funda" + "-"
                    body[3] = "mental " + body[3]
                    truth.add((f"a{a}", n, "hyphen"))
                if n in (2, 3):
                    own = ["thcme", "villagc", "pcrcent", "tcachers", "scvcral"][(2 * a + n) % 5]
                    body[7] = body[7].replace(body[7].split()[0], own, 1)
                    truth.add((f"a{a}", n, "ocr"))
                if n == 4:
                    body[8] += " t h e m e"
                    body[9] = "question naire " + body[9]
                    truth.add((f"a{a}", n, "ocr"))
                if n > 1:
                    body = [f"Quarterly Notes on Reading{a}", *body]
                    truth.add((f"a{a}", n, "header"))
                body.append(str(40 + n))
                truth.add((f"a{a}", n, "folio"))
            rows.append((f"a{a}", n, "\n".join(body), "x"))
    return rows, truth


SCHEMA = "attachment_key string, page_number int, text string, kind string"


@pytest.mark.parametrize("shared", [P.SHARED, 0])
def test_noise_and_paragraphs(spark, shared):
    rows, truth = attachments()
    extra = [rows[0], ("n", 1, None, "x"), ("b", 1, " \n", "x"), (None, 1, "words", "x"), ("one", 1, "a single line", "x"), ("long", 1, "results were clear\n" * 3000, "x")]
    found = P.Scanned(spark.createDataFrame(rows + extra, SCHEMA), shared=shared)
    got = {tuple(r) for r in found.noise().collect() if r.attachment_key.startswith("a")}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    text = {}
    for r in found.paragraphs().collect():
        text.setdefault((r.attachment_key, r.page_number), []).append(r.text)
    assert "fundamental" in " ".join(text["a0", 3]) and "pcrcent" not in " ".join(text["a0", 3]) and "percent" in " ".join(text["a0", 3])
    assert "Quarterly" not in " ".join(text["a0", 4]) and "questionnaire" in " ".join(text["a0", 4])
    assert ("n", 1) not in text and text["one", 1] == ["a single line"]


def test_empty(spark):
    found = P.Scanned(spark.createDataFrame([], SCHEMA))
    assert found.noise().count() == 0 and found.paragraphs().count() == 0


def test_numbers_and_keys():
    assert [P.alone(x) for x in ("- 12 -", "[112]", "xiv", "Page 7", "1984 was", "l2", "mild")] == [12, 112, 14, 7, None, 12, None]
    assert P.beside("119   Open chart") == [119] and P.beside("Open chart   122") == [122] and P.beside("Studies 28 (1996)") == []
    same = P.confusion_keys([("c", "e"), ("rn", "m"), ("d", "cl")])
    assert P.line_key("Opcn chart and thc annotation of rnemo dosed 12", same) == P.line_key("15 Open chart and the annotation of memo closed", same)
    assert P.rebuilt("one funda-\nmental\ntheme\n\nnext", {}) == ["one fundamental theme", "next"]


def test_paragraph_rows(spark):
    rows, _ = attachments()
    parts = [("a0", "p1", "sample funda-\nmental results\nthcme were clear"), ("a0", "p2", "the question naire were clear"), ("z", "p1", "t h e m e and\nvillage"), (None, "p9", "clear funda-\nmental"), ("z", "p3", " \n"), ("z", "p4", None), ("z", None, "lost")]
    paragraphs = spark.createDataFrame(parts + parts[:1], "attachment_key string, paragraph_id string, text string")
    found = P.Scanned(spark.createDataFrame(rows, SCHEMA), paragraphs).repaired(paragraphs)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted([("a0", "p1", "sample fundamental results theme were clear"), ("a0", "p2", "the questionnaire were clear"), ("z", "p1", "theme and village"), (None, "p9", "clear fundamental"), ("z", "p3", "")], key=str)


def test_fit_takes_all_pages(spark):
    rows = [(f"a{i // 10}", i % 10 + 1, "\n".join(["Notes", *["words and words"] * (1 + i % 5), "", str(i)]), [] if i % 3 else None) for i in range(2400)]
    laid = spark.createDataFrame(rows, "attachment_key string, page_number int, text string, marks array<struct<line:int,kind:string,n:int>>")
    want = P.Labeller().fit([P.features(text, {}, {}) for _, _, text, _ in rows])
    got = P.fitted(P.described(laid))
    assert all(abs(a - b).max() < 1e-9 for a, b in ((got.start, want.start), (got.change, want.change), (got.emit, want.emit)))


def test_learnt_confusions(spark):
    """Rare words beside frequent ones teach what is misread for what; endings teach nothing."""
    usual = ["household", "described", "numeracy", "teachers", "villages", "fragments"]
    rows = [(w, 400) for w in usual] + [("houscbold", 1), ("dcscribed", 1), ("numcracy", 2), ("tcachers", 1), ("teacherd", 2), ("villaged", 1), ("fragmentd", 1), ("household9", 1), *((w, 400) for w in ("maßstab", "größte", "außerdem", "schließt")), *((w, 1) for w in ("massstab", "grösste", "ausserdem", "schliesst"))]
    counts = spark.createDataFrame(rows, "word string, n long")
    assert P.learnt(counts) == [("c", "e")]
    fixes = {r.found: r.meant for r in P.corrections(counts, [("c", "e"), ("b", "h")]).collect()}
    assert fixes == {"houscbold": "household", "dcscribed": "described", "numcracy": "numeracy", "tcachers": "teachers"}
    assert P.learnt(counts.limit(0)) == []


def test_labels_make_paragraphs(spark):
    """Without blank lines a short ended line and a capital part paragraphs; lower case behind a blank line or at a page's top carries on."""
    full = "the reader found that sample results were clear and more of"
    dense = "\n".join(["The reader" + full[10:], *[full] * 4, "it ended here.", "Another" + full[3:], *[full] * 4, "the end."])
    blank = "\n".join(["The reader" + full[10:], full, full, "", full, full, "the end."])
    rows = [(f"d{i}", 1, dense) for i in range(20)] + [(f"b{i}", 1, blank) for i in range(20)]
    rows += [("over", 1, "\n".join(["The reader" + full[10:], *[full] * 5, full[:-2] + "vil-"])), ("over", 2, "\n".join(["lages of" + full, *[full] * 5])), ("over", 3, "\n".join([full, full, "it ended.", "", "A new" + full, "and its end."]))]
    got = {}
    for r in P.Scanned(spark.createDataFrame(rows, "attachment_key string, page_number int, text string")).paragraphs().collect():
        got.setdefault(r.attachment_key, []).append((r.page_number, r.paragraph, r.last_page, r.text))
    assert len(got["d0"]) == 2 and len(got["b0"]) == 1
    first, second = sorted(got["over"])
    assert first[:3] == (1, 0, 3) and "villages of" in first[3] and first[3].endswith("it ended.") and second[3].startswith("A new")
