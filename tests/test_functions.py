import pytest
from pyspark.sql import functions as F

from lumensift.functions import boilerplate as B
from lumensift.functions import cite, vector
from lumensift.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


T = None


@pytest.fixture(autouse=True)
def column(spark):
    global T
    T = F.col("t")


@pytest.mark.parametrize("raw, want", [
    ("exam-\nple", "exam\nple"), ("a\r\nb", "a b"), ("one\n\n\n\ntwo", "one\n\ntwo"), ("x  \t y", "x y"), ("1\n   2", "1\n2"), ("  ", ""), (None, None),
])
def test_normalise_text(spark, raw, want):
    assert one(spark, raw, X.normalise_text(T)) == want


@pytest.mark.parametrize("title, want", [("3. Materials and  Methods", "methods"), ("Literaturverzeichnis", "references"), (None, "other"), ("", "other"), ("RÉFÉRENCES", "references"), ("Appendix", "other")])
def test_section(spark, title, want):
    assert one(spark, title, X.section_type(T)) == want


def test_sentences_and_paragraphs(spark):
    assert one(spark, 'One. Two? (Three) four. five! "Six"', X.simple_sentences(T)) == ["One.", "Two?", "(Three) four. five!", '"Six"']
    got = one(spark, "a\n\n \n\nb", X.paragraph_array(T))
    assert [p.text for p in got] == ["a", "b"] and got[0].ordering == 0


@pytest.mark.parametrize("ident, want", [("att:3:hash", 3), ("chunk-1", 0), ("a:b:c", 0), (None, 0), ("", 0)])
def test_chunk_index(spark, ident, want):
    assert one(spark, ident, X.chunk_index(T)) == want


@pytest.mark.parametrize("concept, text, want", [
    ("health literacy", "On Health Literacy now", "exact_phrase"), ("health literacy", "the health-literacy of", "normalized_phrase"), ("organisation culture", "An organization culture", "normalized_phrase"),
    ("health literacy", "health of many", "partial_term_match"), ("health literacy", "healthy words", "no_match"), ("c++ (x)", "about c++ (x) here", "exact_phrase"),
])
def test_lexical_level(spark, concept, text, want):
    assert one(spark, text, X.lexical_level(F.lit(concept), T)) == want


def test_variants():
    assert X.query_variants("  ") == []
    assert len(X.query_variants("literacy")) == 7 and len(X.query_variants("work organisation")) == 14
    assert X.example_variants("care")[1] == "examples of care"
    assert len(X.facet_queries("k")) == 63


def test_definition_and_example_text(spark):
    assert one(spark, "It is old. Care refers to help. End", X.definition_text(T)) == "Care refers to help"
    assert one(spark, "No cue here", X.definition_text(T)) == "No cue here"
    assert one(spark, "It is. They held talks. End", X.example_text(T)) == "They held talks"
    assert one(spark, "A, such as b. C", X.example_text(T)) == "A, such as b. C"


def test_excerpts(spark):
    assert one(spark, "Short. " + "w" * 20, X.excerpt(T)) == "Short. " + "w" * 20
    long = " ".join(["word"] * 100)
    got = one(spark, long, X.excerpt(T))
    assert got.endswith("...") and len(got) <= 240 and " wor..." not in got
    assert one(spark, "abcdef", X.evidence_excerpt(T, 4)) == "ab\n[...middle omitted...]\nef"
    assert one(spark, "abcd", X.evidence_excerpt(T, 4)) == "abcd"


def test_cleaners(spark):
    assert one(spark, "a\x00b", X.without_nul(T)) == "ab"
    assert one(spark, "Text. [P01, P02].", X.without_bracket(T)) == "Text."
    assert one(spark, '```json\n{"a": 1}\n```', X.without_fences(T)) == '{"a": 1}'
    assert one(spark, "Ça — va!", X.statement_key(T)) == "ça va"
    assert one(spark, "STRASSE straße", X.fold(T)) == "strasse strasse"


@pytest.mark.parametrize("text, kind", [
    ("All rights reserved.", "copyright"), ("neither the publisher nor the author; all rights reserved", "disclaimer"), ("About the author", "biography"), ("Praise for this", "marketing"),
    ("Chapter 1 a Chapter 2 b Part IV c", "toc"), ("a, 1\nb, 2\nc, 3\nd, 4", "index"), ("a, 1\rb, 2\rc, 3\rd, 4", None), ("Roe, A. & Doe, B. & Poe, C. & Moe, D. ", "references"), ("We used interviews.", None), (" ", None), (None, None),
])
def test_boilerplate(spark, text, kind):
    assert one(spark, text, B.boilerplate(T)) == kind


def test_facet_exclusion(spark):
    toc = "Chapter 1 a Chapter 2 b Part IV c"
    assert not one(spark, toc, B.excluded_for(T, F.lit("topic"))) and one(spark, toc, B.excluded_for(T, F.lit("limitation"))) and not one(spark, None, B.excluded_for(T, F.lit("topic")))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.9, 0.1]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r.v for r in df.select(vector.cosine(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got[0] > 0.9 and got[1:] == [0.0, 0.0, 0.0]
    rows = spark.createDataFrame([("p", [1.0, 3.0]), ("p", [3.0, 5.0]), ("p", [1.0])], "k string, v array<double>")
    assert vector.centroid(rows, ["k"], "v", 2).first().centroid == [4 / 3, 8 / 3]
    with pytest.raises(ValueError):
        vector.similarity(F.lit(1.0), "hamming")


def test_citations(spark):
    df = spark.createDataFrame([("k", [5, 3, 4, 10, 3]), ("s", [7]), ("n", [])], "key string, pages array<int>")
    assert [r.v for r in df.select(cite.cited(F.col("key"), F.col("pages")).alias("v")).collect()] == ["k (pp. 3-5, 10)", "s (p. 7)", "n"]
    links = spark.createDataFrame([("A", 3), ("A", 0), ("", 2)], "a string, p int").select(cite.deep_link(F.col("a"), F.col("p")).alias("v")).collect()
    assert [r.v for r in links] == ["zotero://open-pdf/library/items/A?page=3", "zotero://open-pdf/library/items/A", ""]
    labels = spark.createDataFrame([(3, 3), (3, 5), (None, 1), (2, None)], "a int, b int").select(cite.page_label(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in labels] == ["PDF p. 3", "PDF pp. 3–5", None, "PDF p. 2"]
    p = spark.createDataFrame([(["P01", "P05"], ["a", "b"]), ([], None)], "i array<string>, k array<string>").select(cite.provenance(F.col("i"), F.col("k")).alias("v")).collect()
    assert [r.v for r in p] == ["[P01, P05 | a; b]", "[evidence unavailable | citation key unavailable]"]
