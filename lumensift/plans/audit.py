"""Consistency of the chunk table with the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import text as X


def index_audit(manifest: DataFrame, chunks: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row of counters, and whether all error counters are 0.

    manifest: one row per attachment_key. Texts are compared by hash, and counted per attachment in one aggregation each.
    """
    entries = manifest.filter("index_status = 'indexed'").select("attachment_key", "number_of_pages", "number_of_chunks", "pipeline_version")
    start, end = F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", F.lit(0))
    slim = chunks.select("attachment_key", start.alias("s"), end.alias("e"), (X.word_count(F.col("text")) > cfg.chunk_max).alias("big"), F.sha2("text", 256).alias("h"))
    joined = slim.join(entries.select("attachment_key", "number_of_pages"), "attachment_key", "left")
    bad = (F.col("s") < 1) | (F.col("e") < F.col("s")) | ((F.coalesce("number_of_pages", F.lit(0)) > 0) & (F.col("e") > F.col("number_of_pages")))
    totals = joined.agg(F.count("*").alias("chunks"), F.count_if("big").alias("oversized_chunks"), F.count_if(bad).alias("invalid_page_ranges"))
    twice = slim.groupBy("attachment_key", "h").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("potential_duplicate_chunks"))
    per = slim.groupBy("attachment_key").agg(F.count("*").alias("n"), F.bool_and((F.col("s") == 1) & (F.col("e") == 1)).alias("page_one"))
    n = F.coalesce("n", F.lit(0))
    odd = (F.coalesce("number_of_pages", F.lit(0)) > 3) & (n > 5) & F.coalesce("page_one", F.lit(False))
    docs = entries.join(per, "attachment_key", "left").agg(
        F.count("*").alias("documents"), F.count_if(n != F.coalesce("number_of_chunks", F.lit(0))).alias("manifest_page_mismatches"),
        F.count_if(~F.col("pipeline_version").eqNullSafe(F.lit(cfg.pipeline_version))).alias("stale_pipeline_documents"), F.count_if(odd).alias("all_page_one_anomalies"),
    )
    out = totals.crossJoin(twice).crossJoin(docs)  # three rows of one
    errors = ["oversized_chunks", "invalid_page_ranges", "potential_duplicate_chunks", "manifest_page_mismatches", "stale_pipeline_documents", "all_page_one_anomalies"]
    return out.withColumn("passed", sum((F.col(c) for c in errors), F.lit(0)) == 0)
