"""Bounded greedy selections over one paper's chunks: representatives and overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import vector
from lumensift.io import settle, written


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def pick_representatives(vectors: np.ndarray, limit: int, weight: float) -> list[int]:
    """Numbers of the chosen rows: first the most central, then each time the best of novelty and centrality (ties: earliest)."""
    n = len(vectors)
    if n <= limit:
        return list(range(n))
    unit = _unit(vectors)
    centre = vectors.sum(axis=0) / n
    centrality = np.clip(unit @ _unit(centre[None])[0], -1, 1)
    chosen = [int(centrality.argmax())]
    nearest = np.clip(unit @ unit[chosen[0]], -1, 1)
    open_ = np.ones(n, bool)
    open_[chosen[0]] = False
    while len(chosen) < limit and open_.any():
        score = np.where(open_, (1 - weight) * (1 - nearest) + weight * (centrality + 1) / 2, -np.inf)
        at = int(score.argmax())
        chosen.append(at)
        open_[at] = False
        nearest = np.maximum(nearest, np.clip(unit @ unit[at], -1, 1))
    return chosen


def representatives(chunks: DataFrame, limit: int | None = None, cfg: EngineConfig = DEFAULT, group: str = "citation_key", whole: int = 20_000) -> DataFrame:
    """(group, chunk_id, pick): up to `limit` representative chunks of each paper.

    A paper of up to `whole` chunks is a matrix of one task. A larger one (a key may hold any part of the rows) is picked
    from in rounds, each the best of its chunks by an aggregate that every task begins on its own rows.
    """
    limit = limit or cfg.similar_source_chunks
    kind = chunks.schema[group].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["chunk_index", "chunk_id"], kind="stable")
        picks = pick_representatives(np.stack(frame["embedding"].to_list()).astype(np.float64), limit, cfg.centrality_weight)
        return pd.DataFrame({group: frame[group].iloc[picks].to_numpy(), "chunk_id": frame["chunk_id"].iloc[picks].to_numpy(), "pick": np.arange(len(picks), dtype=np.int32)})

    rows = chunks.filter(F.col("embedding").isNotNull()).select(group, "chunk_id", "chunk_index", "embedding")
    schema = f"{group} {kind}, chunk_id string, pick int"
    # Of n rows there are at most n / whole larger papers.
    large = settle(rows.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") > whole).select(group))
    if large.isEmpty():
        return rows.groupBy(group).applyInPandas(run, schema)
    small = rows.join(large, group, "left_anti").groupBy(group).applyInPandas(run, schema)
    return small.unionByName(_in_rounds(rows.join(large, group, "left_semi"), group, limit, cfg))


def _in_rounds(rows: DataFrame, group: str, limit: int, cfg: EngineConfig) -> DataFrame:
    """pick_representatives() of each group by one aggregate a round; only the picks so far are kept between rounds."""
    dim = rows.select(F.max(F.size("embedding"))).first()[0]
    centres = vector.centroid(rows, [group], "embedding", dim)
    big = written(rows.join(centres, group).withColumn("_central", vector.cosine(F.col("embedding"), F.col("centroid"))).drop("centroid"), "representatives")
    order = F.struct("chunk_index", "chunk_id", F.col("embedding").alias("v"))
    picked = settle(big.groupBy(group).agg(F.min(F.struct((-F.col("_central")).alias("s"), order.alias("c")))["c"].alias("c")).select(group, F.array("c").alias("picked")))
    while picked.select(F.max(F.size("picked"))).first()[0] < limit:
        nearest = F.aggregate("picked", F.lit(-1.0), lambda t, p: F.greatest(t, vector.cosine(F.col("embedding"), p["v"])))
        score = (1 - cfg.centrality_weight) * (1 - nearest) + cfg.centrality_weight * (F.col("_central") + 1) / 2
        open_ = ~F.exists("picked", lambda p: p["chunk_id"] == F.col("chunk_id"))
        met = big.join(picked, group).filter(open_)
        best = met.groupBy(group).agg(F.min(F.struct((-score).alias("s"), order.alias("c")))["c"].alias("c"))
        picked = settle(picked.join(best, group, "left").select(group, F.when(F.col("c").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array("c"))).alias("picked")))
    return picked.select(group, F.posexplode("picked").alias("pick", "c")).select(group, F.col("c.chunk_id").alias("chunk_id"), "pick")


def pick_overlaps(similarity: np.ndarray, sources: np.ndarray, least: float, limit: int) -> list[int]:
    """The strongest pair, then each time the best of similarity and a source unlike those chosen."""
    unit, left, chosen = _unit(sources), [i for i in range(len(similarity)) if similarity[i] >= least], []
    while left and len(chosen) < limit:
        worth = [similarity[i] * (1 - max([0.0, *(float(np.clip(unit[i] @ unit[j], -1, 1)) for j in chosen)])) if chosen else similarity[i] for i in left]
        chosen.append(left.pop(int(np.argmax(worth))))
    return chosen


def overlaps(pairs: DataFrame, least: float, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(candidate, source_chunk, candidate_chunk, similarity, pick) of pairs (candidate, source_chunk, source_vec, candidate_chunk, similarity)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["similarity", "source_chunk"], ascending=[False, True], kind="stable")
        picks = pick_overlaps(frame["similarity"].to_numpy(), np.stack(frame["source_vec"].to_list()).astype(np.float64), least, cfg.similar_overlaps)
        out = frame.iloc[picks][["candidate", "source_chunk", "candidate_chunk", "similarity"]].copy()
        out["pick"] = np.arange(len(picks), dtype=np.int32)
        return out

    return pairs.groupBy("candidate").applyInPandas(run, "candidate string, source_chunk string, candidate_chunk string, similarity double, pick int")
