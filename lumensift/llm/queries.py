"""Queries of the training-data operators over whole tables, with the SQL of those that SQL can express.

Re-delivered rows are made one before an operator runs; where a table's key is unique no such step is paid for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.io import table
from lumensift.llm import garbled, languages, leaks, neardup, neighbours, pages, pieces, sentences, tokenizer


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.neighbours(table(spark, d, "similarity_chunks"), least=0.85)
    return near.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b")).distinct()


P1_FOUND = """
WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, embedding::DOUBLE[] AS e FROM similarity_chunks
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM t WHERE c >= 0.85
"""


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector, whatever their cosine."""
    return neighbours.neighbours(table(spark, d, "similarity_chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.Scanned(table(spark, d, "document_pages"), table(spark, d, "paragraphs")).noise()


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired paragraphs of every page."""
    return pages.Scanned(table(spark, d, "document_pages"), table(spark, d, "paragraphs")).paragraphs()


def p2_paragraph_rows(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every row of the paragraphs, by its id."""
    paragraphs = table(spark, d, "paragraphs")
    return pages.Scanned(table(spark, d, "document_pages"), paragraphs).repaired(paragraphs)


def _language_records(spark: SparkSession, d: str) -> DataFrame:
    # An item and its chunks are one host; its first collection is the host's group. No table here has an address.
    items = languages.records(table(spark, d, "items"), "items", "item_key", "abstract", "language", "item_key", group=F.get("collections", F.lit(0)))
    chunks = languages.records(table(spark, d, "chunks"), "chunks", "chunk_id", "text", "language", "parent_key")
    return items.unionByName(chunks)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(languages.identify(_language_records(spark, d)))


def p4_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every record's one-language stretches with their languages and confidences."""
    return languages.identify(_language_records(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "paragraphs"), ["attachment_key", "paragraph_id"]).select("attachment_key", "paragraph_id", "sent_end")


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "paragraphs"), ["attachment_key", "paragraph_id"])


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered sentence, and whether it is a true sentence unit of its paragraph."""
    true = sentences.sentences(table(spark, d, "paragraphs"), ["attachment_key", "paragraph_id"])
    flat = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    units = true.select("attachment_key", "paragraph_id", F.xxhash64(flat("text")).alias("h")).distinct().withColumn("is_unit", F.lit(True))
    given = table(spark, d, "sentences").filter("text is not null").dropDuplicates(["attachment_key", "sentence_id"])
    given = given.select("attachment_key", "sentence_id", "paragraph_id", F.xxhash64(flat("text")).alias("h"))
    return given.join(units, ["attachment_key", "paragraph_id", "h"], "left").select("attachment_key", "sentence_id", F.coalesce("is_unit", F.lit(False)).alias("is_unit"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose runs of three words are at least 0.7 the same (the figures the test data state)."""
    return neardup.NearDuplicates(table(spark, d, "chunks"), shingle=3, least=0.7).pairs()


P6_FOUND = r"""
WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM c WHERE len(w) >= 3),
e AS (SELECT chunk_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT chunk_a, chunk_b FROM p WHERE k >= 0.7 * (n + m - k)
"""


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's class of equal texts and its number of links, at five words and 0.8."""
    return neardup.NearDuplicates(table(spark, d, "chunks")).groups()


def p6_unchanged(spark: SparkSession, d: str) -> DataFrame:
    """Attachments whose latest indexed content hash recurs in others: the exact copies that hashes alone show."""
    rows = table(spark, d, "manifest").filter("content_hash is not null and trim(content_hash) <> '' and index_status = 'indexed'")
    latest = rows.groupBy("attachment_key").agg(F.max(F.struct("indexed_at", "content_hash")).alias("m"))
    return latest.groupBy(F.col("m.content_hash").alias("content_hash")).agg(F.count("*").alias("n_attachments"), F.min("attachment_key").alias("first_key")).filter("n_attachments > 1")


P6_UNCHANGED = """
WITH latest AS (
  SELECT attachment_key, max({'t': indexed_at, 'h': content_hash}).h AS content_hash FROM manifest
  WHERE content_hash IS NOT NULL AND trim(content_hash) <> '' AND index_status = 'indexed' GROUP BY attachment_key)
SELECT content_hash, count(*) AS n_attachments, min(attachment_key) AS first_key FROM latest GROUP BY content_hash HAVING count(*) > 1
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that were cut: each has its first piece here."""
    return pieces.pieces(table(spark, d, "chunks")).filter("piece = 0").select("chunk_id")


P7_FOUND = r"""
SELECT DISTINCT chunk_id FROM chunks
WHERE chunk_id IS NOT NULL AND (length(text) > 6000 OR len(regexp_extract_all(text, '[^ \t\r\n]+')) > 800)
"""


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's ids decoded again: the hash of what comes out, the same as the text's own."""
    return tokenizer.decoded(tokenizer.encode(table(spark, d, "documents"))).select("doc_id", F.sha2("text", 256).alias("text_hash"))


P8_ROUND_TRIP = "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


P9_FOUND = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 11), ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, array_to_string(list_slice(w, k, k + 11), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (x)
"""


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {k.lower(): v for k, v in globals().items() if k.startswith("P") and k[1:2].isdigit() and isinstance(v, str)}
