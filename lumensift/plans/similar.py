"""find similar: papers near a paper by its representative chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import text as X
from lumensift.functions.boilerplate import boilerplate
from lumensift.io import settle
from lumensift.operators import diverse, knn, rank


class UnknownKey(LookupError):
    """The store has no chunk of this citation key."""


def usable(text: Column, section: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Long enough, no boilerplate, no reference, bibliography or index section."""
    flat = X.trim(text)
    return (F.length(flat) >= cfg.usable_chars) & (X.word_count(flat) >= cfg.usable_words) & boilerplate(flat).isNull() & ~F.coalesce(F.lower(section), F.lit("")).isin("references", "bibliography", "index")


def coverage_scores(pairs: DataFrame, n_sources: Column | int, least: float, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Papers by the best hit of each (candidate, src): covered sources, strength (mean of the best five) and score.

    pairs: candidate, src, score.
    """
    best = pairs.groupBy("candidate", "src").agg(F.max("score").alias("score"))
    placed = rank.top(best, ["candidate"], [F.desc("score"), "src"], 1 << 30, "n")
    out = placed.groupBy("candidate").agg(F.count_if(F.col("score") >= least).alias("covered"), F.avg(F.when(F.col("n") <= cfg.similar_strength_pairs, F.col("score"))).alias("strength"))
    n = n_sources if isinstance(n_sources, Column) else F.lit(n_sources)
    out = out.filter("covered > 0").withColumn("coverage", F.col("covered") / n)
    return out.withColumn("similarity", cfg.similar_strength_weight * F.col("strength") + cfg.similar_coverage_weight * F.col("coverage"))


@dataclass
class Similar:
    papers: DataFrame
    overlaps: DataFrame
    diagnostics: dict[str, int]


def similar_papers(store: DataFrame, citation_key: str, cfg: EngineConfig = DEFAULT) -> Similar:
    """The papers most like one, the passages they share, and what the run met."""
    source = store.filter((F.col("citation_key") == citation_key) & F.col("embedding").isNotNull())
    if source.isEmpty():
        raise UnknownKey(citation_key)
    good = source.filter(usable(F.col("text"), F.col("section_type"), cfg))
    n_usable = good.count()
    picks = diverse.representatives(good, cfg=cfg).select("chunk_id")
    reps = good.join(picks, "chunk_id").select(F.col("chunk_id").alias("src"), F.col("embedding").alias("src_vec"))
    n_reps = reps.count()
    # Neighbours are taken before their texts are judged, as in a search. They are few, and read by several steps.
    near = settle(knn.knn_join(reps, store.filter(F.col("citation_key") != citation_key), cfg.similar_neighbours))
    met = near.filter((F.col("citation_key") != "") & usable(F.col("text"), F.col("section_type"), cfg)).withColumn("candidate", F.col("citation_key"))
    best = rank.keep_one(met, [F.col("candidate"), F.col("src")], [F.desc("score"), "rank"])
    scores = coverage_scores(best.select("candidate", "src", "score"), max(1, n_reps), cfg.similar_min, cfg)
    titles = met.groupBy("candidate").agg(F.coalesce(F.nullif(F.min_by("title", F.struct("src", "rank")), F.lit("")), F.first("candidate")).alias("title"))
    papers = scores.join(titles, "candidate").orderBy(F.desc("similarity"), F.desc("strength"), "candidate").limit(cfg.similar_results)
    pairs = best.join(reps, "src").join(papers.select("candidate"), "candidate", "left_semi").select("candidate", F.col("src").alias("source_chunk"), F.col("src_vec").alias("source_vec"), F.col("chunk_id").alias("candidate_chunk"), F.col("score").alias("similarity"))
    shared = diverse.overlaps(pairs, cfg.similar_min, cfg)
    texts = store.select("chunk_id", "attachment_key", "chunk_index", F.nullif("page_start", F.lit(0)).alias("page_start"), F.nullif("page_end", F.lit(0)).alias("page_end"), "text", X.excerpt(F.col("text")).alias("excerpt"))
    of = lambda side: texts.select(*[F.col(c).alias(f"{side}_{c}" if c != "chunk_id" else f"{side}_chunk") for c in texts.columns])
    shared = shared.join(of("source"), "source_chunk").join(of("candidate"), "candidate_chunk")
    counts = near.agg(F.count("*").alias("hits")).crossJoin(met.agg(F.count("*").alias("usable"), F.count_distinct("candidate").alias("papers"))).crossJoin(scores.agg(F.count("*").alias("passing"))).first()
    found = {
        "usable_source_chunks": n_usable, "representative_source_chunks": n_reps, "queries_executed": n_reps,
        "candidate_chunk_hits": counts.hits, "candidate_papers": counts.papers, "passing_papers": counts.passing,
    }
    return Similar(papers, shared, found)
