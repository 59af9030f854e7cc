"""Keep-first, keep-best, top-k of groups, batches and merging of duplicates, all with explicit tie-breaks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import text as X
from lumensift.io import written


def keep_one(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """Of the rows of each key the first in the order (keys may be expressions)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top(df: DataFrame, groups: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; each task first cuts its own."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).filter(F.col(name) <= k)


def passage_key(prefix: int) -> list[Column]:
    """What makes two passages the same: paper, page and the beginning of the text."""
    return [F.col("citation_key"), F.col("page_start"), F.substring("text", 1, prefix)]


def rank_candidates(hits: DataFrame, concept: str, cfg: EngineConfig = DEFAULT, ident: str = "chunk_id", pos: str = "pos") -> DataFrame:
    """Hits outside reference sections by adjusted score, the best define_top_k, with lexical_match and candidate_score.

    `pos` is the place in retrieval order, which parts ties.
    """
    level = X.lexical_level(F.lit(unicodedata.normalize("NFKC", concept)), F.col("_nfkc"))
    rows = hits.filter(F.coalesce(F.col("section_type"), F.lit("")) != "references")
    # ASCII is its own compatibility form: only other texts go through Python.
    foreign = F.coalesce(F.col("text").rlike(r"[^\x00-\x7f]"), F.lit(False))
    plain = rows.filter(~foreign).withColumn("_nfkc", F.col("text"))
    rows = plain.unionByName(rows.filter(foreign).withColumn("_nfkc", X.nfkc(F.col("text")))).withColumn("lexical_match", level).drop("_nfkc")
    rows = rows.withColumn("candidate_score", X.candidate_score(F.col("score"), F.col("lexical_match"), F.col("section_type"), F.col("text"), cfg))
    return rows.orderBy(F.desc("candidate_score"), pos, ident).limit(cfg.define_top_k)


def group_documents(hits: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    """Hits by paper: best score, count, title of the first hit, link of the best, chunks best first; the best k papers."""
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = hits.withColumn("document", F.coalesce(none("citation_key"), none("parent_key"), F.col("attachment_key")))
    grouped = rows.groupBy("document").agg(
        F.max("score").alias("score"), F.count("*").alias("chunk_count"), F.min_by("title", pos).alias("title"), F.min_by("year", pos).alias("year"),
        F.max_by("zotero_link", F.struct("score", -F.col(pos))).alias("zotero_link"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(pos).alias("p"), "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"),
    )
    return grouped.orderBy(F.desc("score"), F.desc("chunk_count"), "document").limit(k)


def batches(df: DataFrame, order: list[Column | str], size: int, prefix: str, width: int = 2) -> DataFrame:
    """Bounded evidence (the top of a ranking) with ordinal ids and batch numbers, from one ordered window."""
    n = F.row_number().over(W.orderBy(*order))
    return df.withColumn("_n", n).withColumn("evidence_id", F.format_string(f"{prefix}%0{width}d", "_n")).withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """`df` with the place of each row in the order (unique values), from 1; ranges are numbered apart, so no task sees all rows."""
    ranges = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    # The id's upper bits are the partition, its lower 33 the place within.
    placed = written(ranges.withColumn("_part", F.shiftright("_m", 33)).withColumn("_own", F.col("_m").bitwiseAND(2**33 - 1)).drop("_m"), "numbered")
    before, total = [], 0
    for part, count in sorted(map(tuple, placed.groupBy("_part").count().collect())):
        before.append((part, total))
        total += count
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    return placed.join(starts, "_part").withColumn(name, F.col("_own") + F.col("_before") + 1).drop("_part", "_own", "_before")


def merge_points(points: DataFrame, keys: list[str], pos: str = "pos", wide: bool = False) -> DataFrame:
    """Points with the same statement made one: evidence ids in order of first sight, the longest excerpt (first on ties), renumbered.

    points: keys, statement, evidence_ids, source_excerpt, pos (unique). wide: for a whole table's points, which are read
    more than once and must be the same each time; texts join what was merged and numbered by their places alone.
    """
    rows = points.withColumn("_k", F.sha2(X.statement_key(F.col("statement")), 256)).withColumn("_size", -F.coalesce(F.length("source_excerpt"), F.lit(-1)))
    ids = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), "evidence_ids"))), lambda x: x["evidence_ids"])))
    one = rows.groupBy(*keys, "_k").agg(F.min(pos).alias("_pos"), F.min(F.struct("_size", F.col(pos).alias("p")))["p"].alias("_long"), ids.alias("evidence_ids")).drop("_k")
    placed = numbered(one, "_pos", "_n") if wide else one.withColumn("_n", F.row_number().over(W.orderBy("_pos")))
    far = placed.filter("_long <> _pos").select("_pos", F.col("_long").alias(pos)).join(points.select(pos, F.col("source_excerpt").alias("_far")), pos).select("_pos", "_far")
    texts = placed.join(points.select(F.col(pos).alias("_pos"), "statement", "source_excerpt"), "_pos").join(far, "_pos", "left")
    excerpt = F.when(F.col("_long") != F.col("_pos"), F.col("_far")).otherwise(F.col("source_excerpt"))
    return texts.select(*keys, "statement", "evidence_ids", excerpt.alias("source_excerpt"), F.format_string("P%02d", "_n").alias("point_id"))


def best_definitions(assessed: DataFrame, k: int, pos: str = "pos", key: Callable[[Column], Column] = X.definition_key) -> DataFrame:
    """Of equal definition texts the best by (confidence, candidate score); these by (confidence, score, any lexical match).

    Texts without a key are none.
    """
    confidence = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    rows = assessed.withColumn("_c", confidence).withColumn("_k", F.sha2(key(F.col("extracted_text")), 256)).filter("_k is not null")
    one = keep_one(rows, ["_k"], [F.desc("_c"), F.desc("candidate_score"), pos])
    return one.orderBy(F.desc("_c"), F.desc("candidate_score"), F.desc((F.col("lexical_match") != "no_match").cast("int")), pos).limit(k).drop("_c", "_k")


def known_ids(ids: Column, valid: Column) -> Column:
    """Whether the ids are some and all among the valid ones."""
    return (F.size(ids) > 0) & (F.size(F.array_except(ids, valid)) == 0)


def citation_pages(points: DataFrame, evidence: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_no, citation_key, pages, first): pages of the evidence behind each reference's points, in order of first sight, page 0 and null left out.

    `first` orders a reference's citations; one without pages has an empty list.
    refs: ref_no, point_ids; points: point_id, evidence_ids; evidence: evidence_id, citation_key, page.
    """
    return _pages(_sighted(points, evidence, refs), ["ref_no", "citation_key"])


def sources(points: DataFrame, evidence: DataFrame, refs: DataFrame) -> DataFrame:
    """(citation_key, pages, first) over all references."""
    return _pages(_sighted(points, evidence, refs), ["citation_key"])


def _sighted(points: DataFrame, evidence: DataFrame, refs: DataFrame) -> DataFrame:
    hop = refs.select("ref_no", F.posexplode("point_ids").alias("i", "point_id")).join(points.select("point_id", "evidence_ids"), "point_id")
    return hop.select("ref_no", "i", F.posexplode("evidence_ids").alias("j", "evidence_id")).join(evidence.select("evidence_id", "citation_key", "page"), "evidence_id")


def _pages(rows: DataFrame, keys: list[str]) -> DataFrame:
    seen = F.sort_array(F.collect_list(F.struct("ref_no", "i", "j", "page")))
    pages = F.array_distinct(F.filter(F.transform(seen, lambda x: x["page"]), lambda p: p > 0))
    return rows.groupBy(*keys).agg(pages.alias("pages"), F.min(F.struct("ref_no", "i", "j")).alias("first"))
