"""Fixed-size word windows with overlap, in closed form: no loop and no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import text as X


def window_bounds(n: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Array of (chunk_index, begin, end) word windows of a text of n words.

    With window w, step s and least remainder m, the last window is k = max(0, ceil((n - w - m + 1) / s));
    it takes all that is left, every other one w words.
    """
    w = min(cfg.chunk_target, cfg.chunk_max)
    step = max(1, w - min(cfg.chunk_overlap, w - 1))
    last = F.when(n <= cfg.chunk_max, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((n - w - max(cfg.chunk_min, 1) + 1) / F.lit(step)).cast("int")))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("begin"), F.when(i == last, n).otherwise(i * step + w).cast("int").alias("end"))
    )


def _with_ids(df: DataFrame, text: Column) -> DataFrame:
    """The chunk's id and hash are of the text before it is stripped."""
    return df.withColumn("content_hash", X.content_hash(text)).withColumn("chunk_id", F.concat_ws(":", "attachment_key", F.col("chunk_index").cast("string"), "content_hash"))


def chunk_documents(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(attachment_key, parent_key, citation_key, text) to chunks. A text of at most chunk_max words is one chunk as it is; blank ones have none."""
    rows = df.withColumn("_t", X.trim(F.col("text"))).filter("_t <> ''").withColumn("_w", X.words(F.col("_t"))).withColumn("_n", F.size("_w"))
    cut = rows.withColumn("_c", F.explode(window_bounds(F.col("_n"), cfg)))
    piece = F.when(F.col("_n") <= cfg.chunk_max, F.col("_t")).otherwise(F.array_join(F.slice("_w", F.col("_c.begin") + 1, F.col("_c.end") - F.col("_c.begin")), " "))
    out = cut.select("attachment_key", "parent_key", "citation_key", piece.alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("_c.chunk_index").alias("chunk_index"))
    return _with_ids(out, F.col("text")).select("chunk_id", "attachment_key", "parent_key", "citation_key", "text", "page_start", "page_end", "chunk_index", "content_hash")


def chunk_pages(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(attachment_key, page_number, text) to chunks over the run of all pages' words, each with its first and last word's page."""
    full = pages.withColumn("_w", X.words(F.col("text"))).filter(F.size("_w") > 0)
    # Per page only its words go into the shuffle, once.
    one = full.groupBy("attachment_key").agg(F.sort_array(F.collect_list(F.struct("page_number", F.col("_w").alias("w")))).alias("_p"))
    flat = one.select("attachment_key", F.flatten(F.transform("_p", lambda p: p["w"])).alias("_w"), F.flatten(F.transform("_p", lambda p: F.array_repeat(p["page_number"], F.size(p["w"])))).alias("_g"))
    cut = flat.withColumn("_c", F.explode(window_bounds(F.size("_w"), cfg)))
    out = cut.select(
        "attachment_key",
        F.array_join(F.slice("_w", F.col("_c.begin") + 1, F.col("_c.end") - F.col("_c.begin")), " ").alias("text"),
        F.get("_g", F.col("_c.begin")).alias("page_start"),
        F.get("_g", F.col("_c.end") - 1).alias("page_end"),
        F.col("_c.chunk_index").alias("chunk_index"),
    )
    return _with_ids(out, F.col("text")).select("chunk_id", "attachment_key", "text", "page_start", "page_end", "chunk_index", "content_hash")
