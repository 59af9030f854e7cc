"""Exact nearest-neighbour scans and joins with predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.functions import cite, vector
from lumensift.functions import text as X
from lumensift.io import written
from lumensift.operators import rank


@dataclass(frozen=True)
class Filters:
    """Parts that are set are all required; keys and authors are comma lists of alternatives. year and tag are carried but never applied."""

    citation_key: str | None = None
    author: str | None = None
    parent_key: str | None = None
    collection: str | None = None
    item_type: str | None = None
    year: int | None = None
    tag: str | None = None


def split_list(value: str | None) -> list[str]:
    return [part.strip() for part in (value or "").split(",") if part.strip()]


def predicate(f: Filters | None) -> Column | None:
    """The filters as one Column that reaches the scan, or None."""
    if f is None:
        return None
    parts = [F.col(c) == v for c, v in (("parent_key", f.parent_key), ("collection", f.collection), ("item_type", f.item_type)) if v]
    if keys := split_list(f.citation_key):
        parts.append(F.col("citation_key").isin(keys))
    if names := split_list(f.author):
        parts.append(reduce(lambda a, b: a | b, [F.col("authors").contains(n) for n in names]))
    return reduce(lambda a, b: a & b, parts) if parts else None


def knn(store: DataFrame, query: list[float], k: int, where: Column | None = None, ident: str = "chunk_id", vec: str = "embedding") -> DataFrame:
    """The k rows most similar to the query vector, with `score` (ties: lesser id). Plans as a bounded heap in each task."""
    rows = store if where is None else store.filter(where)
    rows = rows.filter(F.col(vec).isNotNull())
    return rows.withColumn("score", vector.cosine(F.col(vec), vector.literal(query))).orderBy(F.desc("score"), ident).limit(k)


def knn_join(left: DataFrame, store: DataFrame, k: int, ident: str = "chunk_id", vec: str = "embedding", where: Column | None = None, most_left: int = 2000) -> DataFrame:
    """(src, ident, score, rank): the k nearest store rows of each left row (src, src_vec).

    A stated set of queries against all rows, exactly, in blocks of `most_left`. A block's size is known before it is
    broadcast, so the store is read in place and each task keeps k rows of each query before anything moves. More
    queries are more blocks, each a pass over the store (all against all is the business of an index).
    """
    blocks = -(-left.count() // most_left)
    if blocks <= 1:
        return _nearest(left, store, k, ident, vec, where)
    numbered = written(rank.numbered(left.withColumn("_place", F.monotonically_increasing_id()), "_place", "_at"), "knn-queries")
    out = None
    for b in range(blocks):
        own = numbered.filter((F.col("_at") > b * most_left) & (F.col("_at") <= (b + 1) * most_left)).drop("_place", "_at")
        near = written(_nearest(own, store, k, ident, vec, where), "knn-block")
        out = near if out is None else out.unionByName(near)
    return out


def _nearest(left: DataFrame, store: DataFrame, k: int, ident: str, vec: str, where: Column | None) -> DataFrame:
    pairs = store.filter(F.col(vec).isNotNull()).join(F.broadcast(left), F.lit(True) if where is None else where, "inner")
    scored = pairs.withColumn("score", vector.cosine(F.col(vec), F.col("src_vec"))).drop("src_vec", vec)
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), ident))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def hits(rows: DataFrame) -> DataFrame:
    """Store rows as retrieval hits: texts without NUL, authors as a list, a link to the page."""
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "chunk_id", "attachment_key", "parent_key", "citation_key", X.without_nul(named("title")).alias("title"), F.array(named("authors")).alias("authors"), "year",
        F.nullif(F.col("page_start"), F.lit(0)).alias("page_start"), F.nullif(F.col("page_end"), F.lit(0)).alias("page_end"), "section_type", X.without_nul(named("text")).alias("text"),
        F.coalesce("score", F.lit(0.0)).alias("score"), cite.hit_link(F.col("attachment_key"), F.col("page_start")).alias("zotero_link"),
    )
