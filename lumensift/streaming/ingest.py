"""Continuous ingest of new page files: a stream that ends when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumensift.config import DEFAULT, EngineConfig
from lumensift.io import settle
from lumensift.operators import chunking
from lumensift.sources.store import ChunkStore

#: Buckets of the kept pages.
BUCKETS = 64


def ingest_pages(spark: SparkSession, folder: str, store: ChunkStore, checkpoint: str, make, cfg: EngineConfig = DEFAULT, once: bool = True) -> StreamingQuery:
    """Chunks of page files (attachment_key, parent_key, citation_key, page_number, text) that arrive in a folder.

    Pages are kept in buckets of attachments beside the store, so an attachment whose pages arrive in several batches is
    chunked again from all of them (of a page that comes again the last stays). A batch that is repeated after a failure
    overwrites its own pages and replaces the same attachments, which leaves the same store.
    """
    from lumensift.sources import embed

    pages = spark.readStream.schema("attachment_key string, parent_key string, citation_key string, page_number int, text string").parquet(folder)

    kept = f"{store.path}/pages"

    def put(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("attachment_key"), F.lit(BUCKETS)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{kept}/batch={number}")
        own = spark.read.option("basePath", kept).parquet(f"{kept}/batch={number}")
        keys = settle(own.select("attachment_key", "bucket").distinct())
        touched = [r.bucket for r in keys.select("bucket").distinct().collect()]
        if not touched:
            return
        # Only the touched buckets are read.
        rows = spark.read.option("basePath", kept).parquet(kept).filter(F.col("bucket").isin(touched) & (F.col("batch") <= number)).join(keys.select("attachment_key"), "attachment_key", "left_semi")
        last = rows.groupBy("attachment_key", "page_number").agg(F.max(F.struct("batch", "text", "parent_key", "citation_key")).alias("p")).select("attachment_key", "page_number", "p.*")
        named = last.groupBy("attachment_key").agg(F.max(F.struct("batch", "parent_key", "citation_key")).alias("n")).select("attachment_key", "n.parent_key", "n.citation_key")
        chunks = chunking.chunk_pages(last.select("attachment_key", "page_number", "text"), cfg).join(named, "attachment_key")
        store.replace_attachments(embed.embedded(chunks, make), keys)

    writer = pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
