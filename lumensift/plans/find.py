"""search and find: one query vector against the store, as hits or by paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.operators import knn, rank


def search(store: DataFrame, query: list[float], filters: knn.Filters | None = None, k: int | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The k best hits, with `pos` their place."""
    best = knn.knn(store, query, k or cfg.search_top_k, knn.predicate(filters))
    return knn.hits(best).withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))


def find(store: DataFrame, query: list[float], filters: knn.Filters | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The retrieval_top_k best hits grouped by paper."""
    return rank.group_documents(search(store, query, filters, cfg.retrieval_top_k, cfg), cfg.display_top_papers)


def union_first(results: list[DataFrame], prefix: int = 80) -> DataFrame:
    """Results of several queries, in their order; of equal passages the first."""
    out = None
    for n, r in enumerate(results):
        rows = r.withColumn("query_no", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    one = rank.keep_one(out, rank.passage_key(prefix), ["query_no", "pos", "chunk_id"])
    return one.withColumn("pos", F.row_number().over(W.orderBy("query_no", "pos", "chunk_id")))


def best_of_facets(rows: DataFrame, k: int) -> DataFrame:
    """rows (facet, query_no, pos, hit columns): of equal passages of a facet the best score, then the k best of each facet."""
    first = F.min(F.struct("query_no", "pos")).over(W.partitionBy("facet", *rank.passage_key(80)))
    one = rank.keep_one(rows.withColumn("seen", first), [F.col("facet"), *rank.passage_key(80)], [F.desc("score"), "query_no", "pos", "chunk_id"])
    return rank.top(one, ["facet"], [F.desc("score"), "seen", "chunk_id"], k).drop("seen")
