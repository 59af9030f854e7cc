"""Queries that have no SQL, over small tables, against plain Python."""

import re
import unicodedata

from lumensift import catalog
from lumensift.functions import text as X


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def reference_like(text):
    dois = len(re.findall(r"\bdoi\s*:\s*|https?://doi\.org/", text.casefold()))
    authors = len(re.findall(r"\b[A-Z][a-z]+(?:\s+et\s+al\.)?[, ]+\(?20\d{2}\)?", text))
    return dois >= 2 or (authors >= 3 and len(re.findall(r"\b(?:19|20)\d{2}\b", text)) >= 4)


def test_reference_like(spark, tmp_path):
    cited = "Smith, 2001; Jones et al. (2004), Brown 2010"
    texts = [
        f"{cited}, 1999.", f"“{cited}, 1999.”", f"Über {cited}, 1999é", f"{cited} und 1999", f"{cited}, \u0661\u0669\u0669\u0669 2003", f"{cited}, 20\u0661\u0662",
        "DOI: 10.1/a 文献 doi：x doi :10.2/b", "文doi:1 doi:2", "e\u0301doi:1 \u0301doi:2", "²doi:1 doi:2", "doi\x1c:1 doi\u2003:2", "https://doi.org/1 é http://DOI.org/2", "plain", "", "Smith\x1fet\x1fal. 2001, Li\u00a0et al. 2002, Wu, 2003 2004",
    ]
    langs = ["en", "de", None, "zh", "x"]
    rows = [(i, t, langs[i % 5]) for i, t in enumerate(texts)] + [(99, None, "en")]
    d = saved(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.is_reference for r in catalog.queries()["reference_like"](spark, d).collect()}
    assert got == {i: reference_like(t) for i, t in enumerate(texts)}
    assert len(set(got.values())) == 2


def merge_points(rows):
    merged = {}
    for chunk, paper, text in sorted(rows, key=lambda r: r[0]):
        if not (text or "").strip():
            continue
        key = paper, re.sub(r"\W+", " ", text.casefold()).strip()
        first, ids, longest = merged.get(key, (text, [], ""))
        merged[key] = first, [*ids, chunk], text if len(text) > len(longest) else longest
    return [(paper, f"P{n:02d}", *point) for n, ((paper, _), point) in enumerate(merged.items(), 1)]


def test_merge_points(spark, tmp_path):
    same = "The same twenty-four letters and more"
    texts = [same + " A.", same + " B.", same + ", a!", "Größe und Maß", "GRÖSSE — und maß…", "हिन्दी", "हिन्दु", "e\u0301tude", "étude", "統計の要約", "统计摘要", "", " \u3000", None, "x²", "x 2", "…", "—"]
    rows = [(f"c{i:03d}", f"p{i % 2}" if i % 7 else None, texts[(i // 2) % len(texts)]) for i in range(150)]
    d = saved(spark, tmp_path, "chunks", rows, "chunk_id string, citation_key string, text string")
    got = catalog.queries()["merge_points"](spark, d).select("citation_key", "point_id", "statement", "evidence_ids", "source_excerpt").collect()
    assert sorted(map(tuple, got), key=lambda r: int(r[1][1:])) == merge_points(rows)


def phrase(text):
    text = re.sub(r"[\u2010-\u2015\-]+", " ", unicodedata.normalize("NFKC", text).casefold())
    text = re.sub(r"\s+", " ", text).strip()
    for british, american in X.SPELLINGS:
        text = re.sub(rf"\b{british}\b", american, text)
    return text


def assessment_join(rows):
    """Hit ids of the best 50, from (hit_id, section_type, score, text)."""
    rank = {"results": 3, "discussion": 2}
    rows = sorted(((rank[s], score, i, t) for i, s, score, t in rows if s in rank and score is not None and t is not None), key=lambda r: (-r[0], -r[1], r[2]))
    first = {}
    for _, _, i, t in rows:
        if key := phrase(t):
            first.setdefault(key, i)
    return list(first.values())[:50]


def test_assessment_join(spark, tmp_path):
    start = "These sixty characters are the same in each of the passages: "
    texts = [start + "first end", start + "second end", start + "first  END", start + "first end.", "Größe – das Maß", "GRÖSSE das MASS", "ｆｕｌｌ width", "full width", "labour centre", "Labor—Center", "統計の要約", "हिन्दी", "हिन्दु", "", " - ", "\u2014", None]
    rows = [(i, ["results", "discussion", "methods", None][i % 4], None if i % 13 == 5 else (i * 37 % 50) / 50, texts[i % len(texts)]) for i in range(200)]
    d = saved(spark, tmp_path, "chunk_hits", rows, "hit_id long, section_type string, score double, text string")
    got = [r.hit_id for r in catalog.queries()["assessment_join"](spark, d).collect()]
    assert got == assessment_join(rows) and len(got) > 8
