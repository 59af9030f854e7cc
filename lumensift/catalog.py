"""The queries over the driver's tables, by name, and the SQL of those that SQL can express.

`embeddings` serves as a store of chunk vectors (paper = label), `chunks` and `similarity_chunks` as the
real store, `documents` as source texts, `region`, `nation` and `supplier` as a tree of collections with items.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.config import DEFAULT
from lumensift.functions import boilerplate as B
from lumensift.functions import cite, vector
from lumensift.functions import text as X
from lumensift.io import table, written
from lumensift.operators import chunking, closure, context, diverse, knn, rank, selection
from lumensift.plans import audit, find, similar
from lumensift.sources import manifest, pages, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

QUERY_VECTOR = [round(math.sin(i + 1), 6) for i in range(64)]
CONCEPT = "patient portal"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# Stores over the tables ------------------------------------------------------
def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.concat(F.lit("paper"), "label").alias("citation_key"), F.col("vec_id").alias("chunk_index"), "embedding")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("chunk_id is not null").dropDuplicates(["chunk_id"])


def chunk_store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their vectors in the stored form."""
    v = table(spark, d, "similarity_chunks").filter("chunk_id is not null and size(embedding) = 64").select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    rows = chunks(spark, d).select("chunk_id", "attachment_key", "parent_key", F.coalesce("citation_key", F.lit("")).alias("citation_key"), F.coalesce("parent_key", "attachment_key").alias("document_id"), "chunk_index", "page_start", "page_end", "section_type", "section_title", "text")
    return rows.join(v, "chunk_id").withColumn("title", F.lit("")).withColumn("authors", F.lit("")).withColumn("year", F.lit(0)).withColumn("doi", F.lit(""))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("attachment_key"), F.concat(F.lit("d"), "doc_id").alias("parent_key"), "citation_key", "text", "doc_id")


def states(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each attachment."""
    rows = table(spark, d, "manifest").filter("attachment_key is not null")
    order = [F.desc_nulls_last("indexed_at"), F.desc_nulls_last("pipeline_version"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("number_of_chunks"), F.desc_nulls_last("pdf_hash")]
    return rank.keep_one(rows, ["attachment_key"], order)


STATES = """states AS (SELECT * FROM manifest WHERE attachment_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY attachment_key ORDER BY indexed_at DESC NULLS LAST, pipeline_version DESC NULLS LAST, content_hash DESC NULLS LAST, number_of_chunks DESC NULLS LAST, pdf_hash DESC NULLS LAST) = 1)"""
VEC = "[" + ",".join(f"{x!r}::DOUBLE" for x in QUERY_VECTOR) + "]"
CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL)"
WORDS = r"list_filter(string_split_regex({0}, '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]+'), lambda x: x <> '')"
TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]+', ''), '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]+$', '')"


def words_sql(c: str) -> str:
    return WORDS.format(c)


def trim_sql(c: str) -> str:
    return TRIM.format(c)


def cos_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


VECTORS = "v AS (SELECT 'c' || vec_id AS chunk_id, 'paper' || label AS citation_key, vec_id AS chunk_index, embedding FROM embeddings)"

# Hot keys ---------------------------------------------------------------------
HITS = """h AS (SELECT DISTINCT citation_key, hit_id, score FROM chunk_hits
  WHERE citation_key IS NOT NULL AND trim(citation_key) <> '' AND score IS NOT NULL AND NOT isnan(score))"""


@query(f"""WITH {HITS} SELECT citation_key, hit_id FROM h QUALIFY row_number() OVER (PARTITION BY citation_key ORDER BY score DESC, hit_id) <= 3""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of each citation key."""
    return selection.top_rows(table(spark, d, "chunk_hits"), "citation_key", "score", "hit_id", 3).select("citation_key", "hit_id")


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY citation_key ORDER BY score) AS i, count(*) OVER (PARTITION BY citation_key) AS n FROM h)
SELECT citation_key, any_value(n) AS n, max(CASE WHEN i = greatest(1, ceil(n * 0.5::DOUBLE)) THEN score END) AS q50,
       max(CASE WHEN i = greatest(1, ceil(n * 0.9::DOUBLE)) THEN score END) AS q90 FROM r GROUP BY citation_key""")
def p3_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact median and ninth decile of each citation key's scores."""
    return selection.key_quantiles(table(spark, d, "chunk_hits"), "citation_key", "score", [0.5, 0.9], "hit_id")


# Nearest neighbours -------------------------------------------------------------
KNN = f"SELECT chunk_id, citation_key, round({cos_sql('embedding', VEC)}, 6) AS score FROM v"


@query(f"WITH {VECTORS} {KNN} ORDER BY {cos_sql('embedding', VEC)} DESC, chunk_id LIMIT 50")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn(vectors(spark, d), QUERY_VECTOR, 50).select("chunk_id", "citation_key", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS} {KNN} WHERE citation_key IN ('paper1', 'paper3') ORDER BY {cos_sql('embedding', VEC)} DESC, chunk_id LIMIT 20")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = knn.predicate(knn.Filters(citation_key="paper1, paper3"))
    return knn.knn(vectors(spark, d), QUERY_VECTOR, 20, where).select("chunk_id", "citation_key", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS} {KNN} WHERE citation_key <> 'paper0' ORDER BY {cos_sql('embedding', VEC)} DESC, chunk_id LIMIT 20")
def knn_exclude_paper(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn(vectors(spark, d), QUERY_VECTOR, 20, F.col("citation_key") != "paper0").select("chunk_id", "citation_key", F.round("score", 6).alias("score"))


@query(f"""WITH {VECTORS}, t AS (SELECT *, {cos_sql('embedding', VEC)} AS score FROM v ORDER BY score DESC, chunk_id LIMIT 50)
SELECT citation_key AS document, round(max(score), 6) AS score, count(*) AS chunk_count, list(chunk_id ORDER BY score DESC, chunk_id) AS chunks
FROM t GROUP BY citation_key ORDER BY max(score) DESC, count(*) DESC, citation_key LIMIT 15""")
def find_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the best hits of a query vector, by paper."""
    best = knn.knn(vectors(spark, d), QUERY_VECTOR, DEFAULT.retrieval_top_k)
    rows = best.withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))
    rows = rows.select("chunk_id", "citation_key", F.lit(None).cast("string").alias("parent_key"), F.lit("").alias("attachment_key"), F.lit("").alias("title"), F.lit(0).alias("year"), F.lit("").alias("zotero_link"), "score", "pos")
    return rank.group_documents(rows, DEFAULT.display_top_papers).select("document", F.round("score", 6).alias("score"), "chunk_count", "chunks")


REPS = "reps AS (SELECT chunk_id AS src, embedding AS src_vec FROM v WHERE citation_key = 'paper0' ORDER BY chunk_index LIMIT 15)"
NEAR = f"""near AS (SELECT src, citation_key AS candidate, chunk_id, {cos_sql('embedding', 'src_vec')} AS score FROM v, reps WHERE citation_key <> 'paper0'
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, chunk_id) <= 20)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    reps = v.filter("citation_key = 'paper0'").orderBy("chunk_index").limit(15).select(F.col("chunk_id").alias("src"), F.col("embedding").alias("src_vec"))
    return knn.knn_join(reps, v.filter("citation_key <> 'paper0'"), DEFAULT.similar_neighbours)


@query(f"WITH {VECTORS}, {REPS}, {NEAR} SELECT src, chunk_id, round(score, 6) AS score FROM near")
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("src", "chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {VECTORS}, {REPS}, {NEAR}, best AS (SELECT candidate, src, max(score) AS score FROM near GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, src) AS n FROM best),
a AS (SELECT candidate, count(*) FILTER (WHERE score >= 0.30) AS covered, avg(score) FILTER (WHERE n <= 5) AS strength FROM p GROUP BY candidate)
SELECT candidate, covered, round(strength, 6) AS strength, round(covered / 15.0::DOUBLE, 6) AS coverage, round(0.7 * strength + 0.3 * (covered / 15.0::DOUBLE), 6) AS similarity FROM a WHERE covered > 0""")
def paper_similarity(spark: SparkSession, d: str) -> DataFrame:
    pairs = _near(spark, d).select(F.col("citation_key").alias("candidate"), "src", "score")
    out = similar.coverage_scores(pairs, 15, 0.30)
    return out.select("candidate", "covered", *[F.round(c, 6).alias(c) for c in ("strength", "coverage", "similarity")])


@query()
def representatives_mmr(spark: SparkSession, d: str) -> DataFrame:
    return diverse.representatives(vectors(spark, d))


@query()
def overlaps_mmr(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d)
    v = vectors(spark, d).select(F.col("chunk_id").alias("src"), F.col("embedding").alias("source_vec"))
    best = rank.keep_one(near, ["citation_key", "src"], [F.desc("score"), "chunk_id"]).join(v, "src")
    return diverse.overlaps(best.select(F.col("citation_key").alias("candidate"), F.col("src").alias("source_chunk"), "source_vec", F.col("chunk_id").alias("candidate_chunk"), F.col("score").alias("similarity")), 0.30)


@query()
def similar_papers(spark: SparkSession, d: str) -> DataFrame:
    """The papers most like the one with most usable chunks, by the real store."""
    rows = chunk_store(spark, d)
    key = rows.filter("citation_key <> ''").groupBy("citation_key").count().orderBy(F.desc("count"), "citation_key").first()
    if key is None:
        return spark.createDataFrame([], "candidate string, covered long, strength double, coverage double, similarity double, title string")
    return similar.similar_papers(rows, key.citation_key).papers


@query(f"""WITH {VECTORS}, e AS (SELECT citation_key, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM v),
n AS (SELECT citation_key, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT citation_key, i, sum(x) AS x FROM e GROUP BY ALL)
SELECT citation_key, i::INT AS place, round(x / n, 6) AS mean FROM s JOIN n USING (citation_key)""")
def centroid(spark: SparkSession, d: str) -> DataFrame:
    out = vector.centroid(vectors(spark, d), ["citation_key"], "embedding", 64)
    return out.select("citation_key", F.posexplode("centroid").alias("p", "m")).select("citation_key", (F.col("p") + 1).alias("place"), F.round("m", 6).alias("mean"))


@query(f"WITH {VECTORS} SELECT chunk_id, round({cos_sql('embedding', VEC)}, 6) AS cosine FROM v")
def centrality(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("chunk_id", F.round(vector.cosine(F.col("embedding"), vector.literal(QUERY_VECTOR)), 6).alias("cosine"))


# Chunking ------------------------------------------------------------------------
def _windows_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 800 THEN 0 ELSE greatest(0, ceil(({n} - 500 - 200 + 1) / 425.0)::INT) END"


@query(f"""WITH t AS (SELECT 'd' || doc_id AS attachment_key, {trim_sql('text')} AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT *, {words_sql('t')} AS w FROM t WHERE t <> ''),
k AS (SELECT *, len(w) AS n, {_windows_sql('len(w)')} AS last FROM w), x AS (SELECT *, unnest(range(0, last + 1)) AS i FROM k),
c AS (SELECT attachment_key, i AS chunk_index, CASE WHEN n <= 800 THEN t ELSE array_to_string(list_slice(w, i * 425 + 1, CASE WHEN i = last THEN n ELSE i * 425 + 500 END), ' ') END AS text FROM x)
SELECT attachment_key || ':' || chunk_index || ':' || left(sha256(text), 12) AS chunk_id, chunk_index::INT AS chunk_index, length(text) AS n_chars FROM c""")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(documents(spark, d)).select("chunk_id", "chunk_index", F.length("text").alias("n_chars"))


@query(f"""WITH p AS (SELECT DISTINCT ON (attachment_key, page_number) attachment_key, page_number, {words_sql('text')} AS w FROM document_pages WHERE text IS NOT NULL),
e AS (SELECT attachment_key, page_number, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM p),
f AS (SELECT attachment_key, list(x ORDER BY page_number, j) AS w, list(page_number ORDER BY page_number, j) AS g FROM e GROUP BY ALL),
k AS (SELECT *, len(w) AS n, {_windows_sql('len(w)')} AS last FROM f), x AS (SELECT *, unnest(range(0, last + 1)) AS i FROM k),
b AS (SELECT *, i * 425 + 1 AS s, CASE WHEN i = last THEN n ELSE i * 425 + 500 END AS t FROM x)
SELECT attachment_key, i::INT AS chunk_index, g[s]::INT AS page_start, g[t]::INT AS page_end, left(sha256(array_to_string(list_slice(w, s, t), ' ')), 12) AS content_hash FROM b""")
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_pages").filter("text is not null").dropDuplicates(["attachment_key", "page_number"])
    return chunking.chunk_pages(rows).select("attachment_key", "chunk_index", "page_start", "page_end", "content_hash")


@query(f"WITH {CHUNKS} SELECT chunk_id, left(sha256(text), 12) AS digest, coalesce(try_cast(string_split(chunk_id, ':')[2] AS INT), 0) AS idx FROM c WHERE text IS NOT NULL")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("text is not null").select("chunk_id", X.content_hash(F.col("text")).alias("digest"), X.chunk_index(F.col("chunk_id")).alias("idx"))


# Text ----------------------------------------------------------------------------
def _again(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


NORMAL = _again("text", [(r"\r\n", r"chr10"), (r"\n{3,}", "chr10chr10"), (r"[ \t]+", " "), (r"\n +", "chr10"), (r"([A-Za-z])\n([A-Za-z])", r"\1 \2"), (r"([A-Za-z])\n([A-Za-z])", r"\1 \2"), (r"([A-Za-z])-\n", r"\1chr10"), (r"\n{2,}", "chr10chr10")]).replace("chr10", "\n")


@query(f"SELECT doc_id, sha256({trim_sql(NORMAL)}) AS digest FROM documents WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("text is not null").select("doc_id", F.sha2(X.normalise_text(F.col("text")), 256).alias("digest"))


@query(rf"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]+([A-Z(\["''])', '\1' || chr(57344) || '\2', 'g'), chr(57344)) AS p FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_filter(list_transform(p, lambda x: {trim_sql('x')}), lambda x: x <> '') AS p FROM t) SELECT doc_id, unnest(p) AS text, (generate_subscripts(p, 1) - 1)::INT AS ordering FROM l""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).filter("text is not null").select("doc_id", F.posexplode(X.simple_sentences(F.col("text"))).alias("ordering", "text"))


@query(rf"""WITH t AS (SELECT doc_id, string_split_regex(text, '\n[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]*\n') AS p FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i FROM t), x AS (SELECT doc_id, (i - 1)::INT AS ordering, {trim_sql('text')} AS text FROM e) SELECT doc_id, ordering, length(text) AS n_chars FROM x WHERE text <> ''""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(X.paragraph_array(F.col("text"))).alias("p"))
    return rows.select("doc_id", F.col("p.ordering").alias("ordering"), F.length("p.text").alias("n_chars"))


SECTION_SQL = "CASE " + " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in X.SECTIONS) + " ELSE 'other' END"


@query(f"""WITH {CHUNKS}, s AS (SELECT DISTINCT section_title FROM c UNION SELECT title FROM items),
t AS (SELECT section_title, regexp_replace(lower(trim(section_title)), '\\s+', ' ', 'g') AS t FROM s) SELECT section_title, CASE WHEN section_title IS NULL OR section_title = '' THEN 'other' ELSE {SECTION_SQL} END AS section FROM t""")
def detect_section(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select("section_title").union(table(spark, d, "items").select("title")).distinct()
    return rows.select("section_title", X.section_type(F.col("section_title")).alias("section"))


PAGE_LIKE = [("Neither the publisher nor the author is liable.", 1), ("All Rights Reserved. ISBN 3", 2), ("© 2019 The Press", 3), ("About the author: she lives in Bath with her dog", 4), ("Praise for the book", 5), ("Chapter 1 One\nChapter 2 Two\nPart III Three", 6),
    ("alpha, 1\nbeta, 2, 3\ngamma, 4\ndelta, 5, 6", 7), ("Smith, J. & Roe, A. and Poe, E. & Lee, B. ", 8), ("Plain words on a method", 9), ("   ", 10)]
_rx = lambda patterns: "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
BOILER = f"""CASE WHEN NOT regexp_matches(text, '\\S') THEN NULL WHEN regexp_matches(text, '(?i){_rx(B.DISCLAIMER)}') THEN 'disclaimer' WHEN regexp_matches(text, '(?i){_rx(B.COPYRIGHT)}') THEN 'copyright'
 WHEN regexp_matches(text, '(?i){_rx(B.BIOGRAPHY)}') THEN 'biography' WHEN regexp_matches(text, '(?i){_rx(B.MARKETING)}') OR len(regexp_extract_all(text, '{_rx([B.BLURB])}')) >= 2 THEN 'marketing'
 WHEN len(regexp_extract_all(text, '(?i){_rx([B.TOC])}')) >= 3 THEN 'toc' WHEN len(regexp_extract_all(text, '(?m){_rx([B.INDEX_LINE])}')) >= 4 THEN 'index' WHEN len(regexp_extract_all(text, '{_rx([B.REFERENCE])}')) >= 4 THEN 'references' END"""
FIXTURE_SQL = "VALUES " + ", ".join("('" + t.replace("'", "''") + f"', {n})" for t, n in PAGE_LIKE)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null").select("text", "doc_id")
    return rows.unionByName(spark.createDataFrame([(t, -n) for t, n in PAGE_LIKE], "text string, doc_id long"))


TEXTS = f"t AS (SELECT text, doc_id FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM (SELECT column0 AS text, -column1 AS doc_id FROM ({FIXTURE_SQL}) AS f(column0, column1)))"


@query(f"WITH {TEXTS} SELECT doc_id, {BOILER} AS kind FROM t")
def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", B.boilerplate(F.col("text")).alias("kind"))


@query(f"""WITH {TEXTS}, k AS (SELECT doc_id, {BOILER} AS kind FROM t), f AS (SELECT unnest(['topic', 'limitation']) AS facet)
SELECT doc_id, facet, coalesce(kind IS NOT NULL AND NOT (kind = 'toc' AND facet = 'topic'), false) AS excluded FROM k, f""")
def boilerplate_facet(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).withColumn("facet", F.explode(F.array(F.lit("topic"), F.lit("limitation"))))
    return rows.select("doc_id", "facet", B.excluded_for(F.col("text"), F.col("facet")).alias("excluded"))


SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]"
START = r"(?:^|[^\p{L}\p{N}_])"


@query(rf"""WITH n AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{START}doi{SPACE}*:')) + len(regexp_extract_all(lower(text), 'https?://doi\.org/')) AS dois,
 len(regexp_extract_all(text, '{START}[A-Z][a-z]+(?:{SPACE}+et{SPACE}+al\.)?[, ]+\(?20\p{{Nd}}{{2}}')) AS authors,
 len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '(?:19|20)\p{{Nd}}{{2}}'))) AS years FROM documents WHERE text IS NOT NULL)
SELECT doc_id, dois >= 2 OR (authors >= 3 AND years >= 4) AS is_reference FROM n""")
def reference_like(spark: SparkSession, d: str) -> DataFrame:
    """Over every text, whatever its language, label and script."""
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", X.reference_like(F.col("text")).alias("is_reference"))


LEVEL = rf"""CASE WHEN contains(lower(text), '{CONCEPT}') THEN 'exact_phrase' WHEN contains(regexp_replace(regexp_replace(lower(text), '[‐-―\-]+', ' ', 'g'), '\s+', ' ', 'g'), '{CONCEPT}') THEN 'normalized_phrase'
 WHEN regexp_matches(regexp_replace(lower(text), '[‐-―\-]+', ' ', 'g'), '\b(patient|portal)\b') THEN 'partial_term_match' ELSE 'no_match' END"""


@query(f"WITH {CHUNKS} SELECT chunk_id, {LEVEL} AS level FROM c WHERE text IS NOT NULL")
def lexical_level(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("text is not null").select("chunk_id", X.lexical_level(F.lit(CONCEPT), F.col("text")).alias("level"))


@query()
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of a concept among all hits, by adjusted score."""
    rows = table(spark, d, "chunk_hits").filter("text is not null and score is not null").dropDuplicates(["hit_id"]).withColumn("pos", F.col("hit_id"))
    out = rank.rank_candidates(rows.select("hit_id", "chunk_id", "section_type", "text", "score", "pos"), CONCEPT)
    return out.select("hit_id", "lexical_match", F.round("candidate_score", 6).alias("candidate_score"))


CUES = "[" + ",".join(f"'{c}'" for c in X.DEFINITION_CUES) + "]"


@query(f"""WITH {CHUNKS}, t AS (SELECT chunk_id, {trim_sql('text')} AS t FROM c WHERE text IS NOT NULL), s AS (SELECT *, list_filter(list_transform(string_split(t, '. '), lambda x: {trim_sql('x')}), lambda x: x <> '') AS p FROM t)
SELECT chunk_id, md5(coalesce(list_filter(p, lambda x: len(list_filter({CUES}, lambda q: contains(lower(x), q))) > 0)[1], string_split(t, '. ')[1])) AS digest FROM s""")
def definition_text(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("text is not null").select("chunk_id", F.md5(X.definition_text(F.col("text"))).alias("digest"))


PHRASES, VERBS = ("[" + ",".join(f"'{c}'" for c in cs) + "]" for cs in (X.EXAMPLE_PHRASES, X.EXAMPLE_VERBS))


@query(f"""WITH {CHUNKS}, t AS (SELECT chunk_id, {trim_sql('text')} AS t FROM c WHERE text IS NOT NULL), s AS (SELECT *, list_filter(list_transform(string_split(t, '. '), lambda x: {trim_sql('x')}), lambda x: x <> '') AS p FROM t)
SELECT chunk_id, md5(CASE WHEN len(list_filter({PHRASES}, lambda q: contains(lower(t), q))) > 0 THEN t ELSE coalesce(list_filter(p, lambda x: len(list_filter({VERBS}, lambda q: contains(lower(x), q))) > 0)[1], string_split(t, '. ')[1]) END) AS digest FROM s""")
def example_text(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("text is not null").select("chunk_id", F.md5(X.example_text(F.col("text"))).alias("digest"))


@query(rf"""WITH {CHUNKS}, f AS (SELECT chunk_id, array_to_string({words_sql('text')}, ' ') AS t FROM c WHERE text IS NOT NULL),
g AS (SELECT chunk_id, t, coalesce(nullif(regexp_extract(t, '^(.*?[.!?]) ', 1), ''), t) AS s FROM f), h AS (SELECT chunk_id, CASE WHEN length(s) >= 40 THEN s ELSE t END AS x FROM g)
SELECT chunk_id, CASE WHEN length(x) > 240 THEN regexp_replace(left(x, 237), ' [^ ]*$', '') || '...' ELSE x END AS excerpt FROM h""")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("text is not null").select("chunk_id", X.excerpt(F.col("text")).alias("excerpt"))


@query(f"WITH {CHUNKS} SELECT chunk_id, md5(CASE WHEN length(text) <= 2200 THEN text ELSE left(text, 1100) || chr(10) || '[...middle omitted...]' || chr(10) || right(text, 1100) END) AS digest FROM c WHERE text IS NOT NULL")
def evidence_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("text is not null").select("chunk_id", F.md5(X.evidence_excerpt(F.col("text"), DEFAULT.explain_chars)).alias("digest"))


# Deduplication -----------------------------------------------------------------
DHITS = "h AS (SELECT DISTINCT ON (hit_id) * FROM chunk_hits WHERE text IS NOT NULL)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_hits").filter("text is not null").dropDuplicates(["hit_id"])


@query(f"WITH {DHITS} SELECT hit_id FROM h QUALIFY row_number() OVER (PARTITION BY citation_key, page_start, left(text, 80) ORDER BY query_id, hit_id) = 1")
def query_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of equal passages the first in retrieval order."""
    return rank.keep_one(_hits(spark, d), rank.passage_key(80), ["query_id", "hit_id"]).select("hit_id")


@query(f"""WITH {DHITS}, b AS (SELECT * FROM h WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, citation_key, page_start, left(text, 80) ORDER BY score DESC, hit_id) = 1)
SELECT query_id, hit_id FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) <= 10""")
def keep_best_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of equal passages of a query the best, and the ten best of each query."""
    one = rank.keep_one(_hits(spark, d).filter("score is not null"), [F.col("query_id"), *rank.passage_key(80)], [F.desc("score"), "hit_id"])
    return rank.top(one, ["query_id"], [F.desc("score"), "hit_id"], 10).select("query_id", "hit_id")


@query(rf"""WITH {CHUNKS}, p AS (SELECT citation_key, text, chunk_id, trim(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS k FROM c WHERE {trim_sql('text')} <> ''),
m AS (SELECT citation_key, min(chunk_id) AS pos, list(chunk_id ORDER BY chunk_id) AS evidence_ids, arg_min(text, chunk_id) AS statement, first(text ORDER BY length(text) DESC, chunk_id) AS source_excerpt FROM p GROUP BY citation_key, k)
SELECT citation_key, statement, evidence_ids, source_excerpt, printf('P%02d', row_number() OVER (ORDER BY pos)) AS point_id FROM m""")
def merge_points(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's whole text as a point (blank ones are none), merged within its paper and numbered over the table."""
    # Of re-delivered rows always the same one, as the points are read more than once.
    one = table(spark, d, "chunks").filter("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("text", "citation_key")).alias("r"))
    rows = one.select("chunk_id", "r.*").filter(X.trim(F.col("text")) != "")
    points = rows.select("citation_key", F.col("text").alias("statement"), F.array("chunk_id").alias("evidence_ids"), F.col("text").alias("source_excerpt"), F.col("chunk_id").alias("pos"))
    return rank.merge_points(points, ["citation_key"], wide=True)


@query(f"""WITH {DHITS}, g AS (SELECT *, coalesce(nullif(citation_key, ''), nullif(parent_key, ''), attachment_key) AS document FROM h WHERE score IS NOT NULL)
SELECT document, round(max(score), 6) AS score, count(*) AS chunk_count, first(title ORDER BY hit_id) AS title FROM g GROUP BY document ORDER BY max(score) DESC, count(*) DESC, document LIMIT 15""")
def group_hits(spark: SparkSession, d: str) -> DataFrame:
    """All hits by paper. Aggregates only, so a paper with very many hits is no one task's list."""
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = _hits(spark, d).filter("score is not null").withColumn("document", F.coalesce(none("citation_key"), none("parent_key"), F.col("attachment_key")))
    return rows.groupBy("document").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("chunk_count"), F.min_by("title", "hit_id").alias("title")).orderBy(F.desc("score"), F.desc("chunk_count"), "document").limit(15)


# Context -----------------------------------------------------------------------
SIB = f"{CHUNKS}, s AS (SELECT attachment_key, chunk_id, text, coalesce(try_cast(string_split(chunk_id, ':')[2] AS INT), 0) AS idx FROM c WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY attachment_key, idx ORDER BY chunk_id DESC) = 1)"


@query(f"WITH {SIB} SELECT a.chunk_id AS anchor_id, b.chunk_id AS chunk_id, b.idx AS idx FROM s a JOIN s b ON a.attachment_key = b.attachment_key AND b.idx BETWEEN a.idx - 1 AND a.idx + 1")
def context_neighbours(spark: SparkSession, d: str) -> DataFrame:
    sib = context.ordered_siblings(chunks(spark, d).filter("text is not null").select("chunk_id", "attachment_key", "text"))
    return context.neighbours(sib, sib, 1, 1).select("anchor_id", "chunk_id", "idx")


@query()
def context_expand(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk widened by its neighbours and the runs it stands in."""
    rows = chunks(spark, d).filter("text is not null").select("chunk_id", "attachment_key", "text")
    return context.expand(rows, context.ordered_siblings(rows), 1, 1, DEFAULT.define_context_words).select("anchor_id", F.sha2("text", 256).alias("digest"), F.size("context_chunk_ids").alias("n"), "context_start", "context_end", "n_continued")


@query(f"""WITH {SIB}, p AS (SELECT a.chunk_id AS chunk_id, {words_sql('a.text')} AS l, {words_sql('b.text')} AS r FROM s a JOIN s b ON a.attachment_key = b.attachment_key AND b.idx = a.idx + 1)
SELECT chunk_id, coalesce(list_filter(range(least(75, len(l), len(r)), 3, -1), lambda n: list_slice(l, len(l) - n + 1, len(l)) = list_slice(r, 1, n))[1], 0)::INT AS shared FROM p""")
def stitch(spark: SparkSession, d: str) -> DataFrame:
    """Words that each chunk shares with the next."""
    sib = context.ordered_siblings(chunks(spark, d).filter("text is not null").select("chunk_id", "attachment_key", "text"))
    nxt = sib.select("attachment_key", (F.col("idx") - 1).alias("idx"), F.col("text").alias("right"))
    both = sib.join(nxt, ["attachment_key", "idx"]).select("chunk_id", X.words(F.col("text")).alias("l"), X.words(F.col("right")).alias("r"))
    return both.select("chunk_id", context.overlap(F.col("l"), F.col("r")).alias("shared"))


# Manifest and sync ---------------------------------------------------------------
DISCOVERED = """found AS (SELECT DISTINCT ON (attachment_key) attachment_key, citation_key, pdf_path, abstract FROM items WHERE attachment_key IS NOT NULL ORDER BY attachment_key, synced_at DESC NULLS LAST, item_key)"""


def _discovered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "items").filter("attachment_key is not null")
    return rank.keep_one(rows, ["attachment_key"], [F.desc_nulls_last("synced_at"), "item_key"]).select("attachment_key", "citation_key", "pdf_path", "abstract")


DECISION = f"""d AS (SELECT f.attachment_key, f.citation_key, f.pdf_path, CASE WHEN s.attachment_key IS NULL THEN 'new' WHEN s.pipeline_version IS DISTINCT FROM '2' THEN 'changed'
 WHEN f.pdf_path LIKE 'abstract:%' THEN CASE WHEN s.pdf_size IS NOT DISTINCT FROM length(f.abstract) THEN 'unchanged' ELSE 'changed' END WHEN f.pdf_path IS NULL THEN 'deleted'
 WHEN s.pdf_mtime IS NULL OR s.number_of_pages IS NULL THEN 'changed' ELSE 'unchanged' END AS decision FROM found f LEFT JOIN states s USING (attachment_key))"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Decisions for the library's items. An abstract's size is its text's; of files, which the tables do not hold, the size is taken as known and one whose state lacks its pages counts as touched since."""
    s = states(spark, d)
    seen = s.select("attachment_key", "pdf_size", F.when(F.col("number_of_pages").isNull() | F.col("pdf_mtime").isNull(), F.lit(-1.0)).otherwise(F.col("pdf_mtime")).alias("pdf_mtime"))
    items = _discovered(spark, d).join(seen, "attachment_key", "left").withColumn("path_exists", F.col("pdf_path").isNotNull())
    items = items.withColumn("pdf_size", F.when(F.col("pdf_path").startswith("abstract:"), F.length("abstract").cast("long")).otherwise(F.col("pdf_size")))
    return manifest.decisions(items, s)


@query(f"WITH {STATES}, {DISCOVERED}, {DECISION} SELECT attachment_key, decision FROM d")
def sync_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("attachment_key", "decision")


@query(f"""WITH {STATES}, {DISCOVERED}, {DECISION} SELECT count(*) AS discovered, count(*) FILTER (WHERE decision = 'new') AS new, count(*) FILTER (WHERE decision = 'changed') AS changed,
count(*) FILTER (WHERE decision = 'unchanged') AS unchanged, count(*) FILTER (WHERE decision = 'deleted') AS deleted, count(*) FILTER (WHERE coalesce(citation_key, '') = '') AS no_citation,
count(*) FILTER (WHERE pdf_path LIKE 'abstract:%') AS abstracts, 0::BIGINT AS failed, 0::BIGINT AS chunks FROM d""")
def sync_counters(spark: SparkSession, d: str) -> DataFrame:
    from lumensift.plans.sync import counters

    return counters(_decided(spark, d))


@query(f"WITH {STATES} SELECT attachment_key, indexed_at, index_status, content_hash, number_of_chunks FROM states")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Failed states into an empty manifest, then all the others over them, then the failed ones that are later still: the last of each key stays."""
    rows = table(spark, d, "manifest").filter("attachment_key is not null")
    bad, good = rows.filter("not coalesce(index_status = 'indexed', false)"), rows.filter("index_status = 'indexed'")
    order = ["indexed_at", "pipeline_version", "content_hash", "number_of_chunks", "pdf_hash"]
    stamped = lambda part: part.withColumn("_at", F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in order])))
    first = manifest.upsert(manifest.empty(spark), stamped(bad), "_at")
    both = manifest.upsert(first, stamped(good), "_at")
    late = first.alias("f").join(both.alias("b"), "attachment_key").filter("f.indexed_at > b.indexed_at").select("f.*")
    return manifest.upsert(both, late).select("attachment_key", "indexed_at", "index_status", "content_hash", "number_of_chunks")


@query(f"WITH {STATES}, {DISCOVERED} SELECT attachment_key FROM states WHERE index_status = 'indexed' AND attachment_key NOT IN (SELECT attachment_key FROM found WHERE coalesce(citation_key, '') <> '')")
def prune(spark: SparkSession, d: str) -> DataFrame:
    """Indexed attachments whose item is no longer one to index, as it has lost its citation key."""
    return manifest.to_prune(states(spark, d), _discovered(spark, d).filter("coalesce(citation_key, '') <> ''"), True)


@query(f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE content_hash IS NULL OR split_part(chunk_id, ':', 3) <> content_hash")
def stale_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stored ids that are not among the ids their hashes give today."""
    rows = chunks(spark, d)
    new = rows.filter("content_hash is not null").select(F.concat_ws(":", F.get(F.split("chunk_id", ":"), 0), F.get(F.split("chunk_id", ":"), 1), "content_hash").alias("chunk_id"))
    return store.stale_ids(rows, new)


@query(f"WITH {STATES}, {DISCOVERED} SELECT s.attachment_key, coalesce(nullif(f.citation_key, ''), s.citation_key) AS citation_key FROM states s LEFT JOIN found f USING (attachment_key)")
def citation_refresh(spark: SparkSession, d: str) -> DataFrame:
    return manifest.refresh_keys(states(spark, d), _discovered(spark, d)).select("attachment_key", "citation_key")


@query(f"""WITH {STATES}, {CHUNKS}, e AS (SELECT * FROM states WHERE index_status = 'indexed'),
l AS (SELECT c.attachment_key, coalesce(page_start, 0) AS s, coalesce(page_end, 0) AS t, len({words_sql('text')}) AS w, sha256(text) AS h, e.number_of_pages FROM c LEFT JOIN e USING (attachment_key)),
a AS (SELECT count(*) AS chunks, count(*) FILTER (WHERE w > 800) AS oversized_chunks, count(*) FILTER (WHERE s < 1 OR t < s OR (coalesce(number_of_pages, 0) > 0 AND t > number_of_pages)) AS invalid_page_ranges FROM l),
b AS (SELECT count(*) FILTER (WHERE n > 1) AS potential_duplicate_chunks FROM (SELECT count(*) AS n FROM l GROUP BY attachment_key, h)),
p AS (SELECT attachment_key, count(*) AS n, bool_and(s = 1 AND t = 1) AS one FROM l GROUP BY attachment_key),
g AS (SELECT count(*) AS documents, count(*) FILTER (WHERE coalesce(n, 0) <> coalesce(number_of_chunks, 0)) AS manifest_page_mismatches, count(*) FILTER (WHERE pipeline_version IS DISTINCT FROM '2') AS stale_pipeline_documents,
 count(*) FILTER (WHERE coalesce(number_of_pages, 0) > 3 AND n > 5 AND one) AS all_page_one_anomalies FROM e LEFT JOIN p USING (attachment_key))
SELECT *, oversized_chunks + invalid_page_ranges + potential_duplicate_chunks + manifest_page_mismatches + stale_pipeline_documents + all_page_one_anomalies = 0 AS passed FROM a, b, g""")
def index_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.index_audit(states(spark, d), chunks(spark, d))


@query(f"""WITH {STATES}, k AS (SELECT DISTINCT citation_key FROM items WHERE coalesce(citation_key, '') <> ''), l AS (SELECT citation_key, max((index_status = 'indexed')::INT) AS i FROM states GROUP BY ALL)
SELECT k.citation_key, CASE WHEN i = 1 THEN 'indexed' WHEN i = 0 THEN 'known' ELSE 'unknown' END AS status FROM k LEFT JOIN l USING (citation_key)""")
def key_status(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "items").filter("coalesce(citation_key, '') <> ''").select("citation_key").distinct()
    return manifest.key_status(keys, states(spark, d))


@query(f"WITH {STATES} SELECT count(*) FILTER (WHERE index_status = 'indexed') AS documents, coalesce(sum(number_of_chunks) FILTER (WHERE index_status = 'indexed'), 0)::BIGINT AS chunks FROM states")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest.status_counts(states(spark, d))


# Collections --------------------------------------------------------------------
TREE = "tree AS (SELECT 'r' || r_regionkey AS key, r_name AS name, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    return r.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))


CLOSURE = "closed AS (SELECT key FROM tree WHERE lower(name) IN ('europe', 'asia') UNION SELECT t.key FROM tree t JOIN closed c ON t.parent = c.key)"


@query(f"WITH RECURSIVE {TREE}, {CLOSURE} SELECT key FROM closed")
def collection_closure(spark: SparkSession, d: str) -> DataFrame:
    return closure.descendants(_tree(spark, d), ["Europe", "Asia"])


@query(f"WITH RECURSIVE {TREE}, {CLOSURE} SELECT 's' || s_suppkey AS item_key FROM supplier WHERE 'n' || s_nationkey IN (SELECT key FROM closed)")
def items_in_collections(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("item_key"), F.array(F.concat(F.lit("n"), "s_nationkey")).alias("collections"))
    return closure.in_collections(items, closure.descendants(_tree(spark, d), ["Europe", "Asia"])).select("item_key")


# Citations ----------------------------------------------------------------------
@query(f"""WITH {CHUNKS}, p AS (SELECT DISTINCT citation_key AS k, page_start AS p FROM c WHERE page_start > 0 AND coalesce(citation_key, '') <> ''), i AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM p),
r AS (SELECT k, min(p) AS a, max(p) AS b FROM i GROUP BY k, g), s AS (SELECT k, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS t, sum(b - a + 1) AS n FROM r GROUP BY k)
SELECT k AS citation_key, k || ' (' || CASE WHEN n = 1 THEN 'p. ' ELSE 'pp. ' END || t || ')' AS label FROM s""")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).filter("page_start > 0 and coalesce(citation_key, '') <> ''").groupBy("citation_key").agg(F.collect_set("page_start").alias("pages"))
    return rows.select("citation_key", cite.cited(F.col("citation_key"), F.col("pages")).alias("label"))


@query(f"""WITH {CHUNKS}, e AS (SELECT parent_key AS ref_no, citation_key, chunk_index AS j, chunk_id, page_start AS page FROM c WHERE page_start > 0 AND citation_key IS NOT NULL),
f AS (SELECT ref_no, citation_key, page, min(struct_pack(j := j, i := chunk_id)) AS m FROM e GROUP BY ALL) SELECT ref_no, citation_key, list(page ORDER BY m) AS pages FROM f GROUP BY ALL""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Pages behind each paper's references, in order of first sight."""
    rows = chunks(spark, d).filter("page_start > 0 and citation_key is not null")
    points = rows.groupBy(F.col("parent_key").alias("point_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence_ids"))
    evidence = rows.select(F.col("chunk_id").alias("evidence_id"), "citation_key", F.col("page_start").alias("page"))
    return rank.citation_pages(points, evidence, points.select(F.col("point_id").alias("ref_no"), F.array("point_id").alias("point_ids"))).select("ref_no", "citation_key", "pages")


@query(f"WITH {CHUNKS} SELECT chunk_id, 'zotero://open-pdf/library/items/' || attachment_key || CASE WHEN page_start > 0 THEN '?page=' || page_start ELSE '' END AS link, CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_end = page_start THEN 'PDF p. ' || page_start ELSE 'PDF pp. ' || page_start || '–' || page_end END AS label FROM c WHERE coalesce(attachment_key, '') <> ''")
def deep_link(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).filter("coalesce(attachment_key, '') <> ''")
    return rows.select("chunk_id", cite.deep_link(F.col("attachment_key"), F.col("page_start")).alias("link"), cite.page_label(F.col("page_start"), F.col("page_end")).alias("label"))


@query(f"""WITH {VECTORS}, t AS (SELECT chunk_id, {cos_sql('embedding', VEC)} AS s FROM v ORDER BY s DESC, chunk_id LIMIT 30), n AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS n FROM t)
SELECT chunk_id, 'D' || lpad(n::VARCHAR, 2, '0') AS evidence_id, ((n - 1) // 5)::INT AS batch FROM n""")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    best = knn.knn(vectors(spark, d), QUERY_VECTOR, 30)
    return rank.batches(best, [F.desc("score"), "chunk_id"], DEFAULT.define_batch, "D").select("chunk_id", "evidence_id", "batch")


@query()
def assessment_join(spark: SparkSession, d: str) -> DataFrame:
    """Assessed passages joined to their evidence: of equal whole texts the best by confidence and score."""
    evidence = _hits(spark, d).filter("score is not null")
    confidence = F.when(F.col("section_type") == "results", "high").otherwise("medium").alias("confidence")
    answers = evidence.filter(F.col("section_type").isin("results", "discussion")).select("hit_id", confidence, F.col("text").alias("extracted_text"))
    joined = evidence.select("hit_id", F.col("score").alias("candidate_score")).join(answers, "hit_id").withColumn("lexical_match", F.lit("no_match")).withColumn("pos", F.col("hit_id"))
    # Written, so that the compatibility form (Python) is taken of rows as they lie and never within the join.
    return rank.best_definitions(written(joined, "assessed"), 50).select("hit_id")
