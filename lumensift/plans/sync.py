"""Ingest: decide, extract, chunk, embed, store, record; one job graph, each item with its own outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.io import settle
from lumensift.operators import chunking
from lumensift.sources import embed, manifest
from lumensift.sources.store import ChunkStore


def counters(decided: DataFrame, failed: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """One row: discovered, new, changed, unchanged, deleted, no_citation, abstracts, failed, chunks.

    failed: attachment_key of items that could not be indexed, which are neither new nor changed; chunks: the rows that were stored.
    """
    rows = decided
    if failed is not None:
        bad = failed.select("attachment_key").distinct().withColumn("_failed", F.lit(True))
        rows = decided.join(bad, "attachment_key", "left")
    broken = F.coalesce("_failed", F.lit(False)) if failed is not None else F.lit(False)
    kind = lambda k: F.count_if((F.col("decision") == k) & ~broken).alias(k)
    out = rows.agg(F.count("*").alias("discovered"), kind("new"), kind("changed"), kind("unchanged"), kind("deleted"),
        F.count_if(F.coalesce("citation_key", F.lit("")) == "").alias("no_citation"), F.count_if(F.col("pdf_path").startswith("abstract:")).alias("abstracts"), F.count_if(broken).alias("failed"))
    return out.crossJoin(chunks.agg(F.count("*").alias("chunks"))) if chunks is not None else out.withColumn("chunks", F.lit(0).cast("long"))


@dataclass
class Synced:
    manifest: DataFrame
    decided: DataFrame
    chunks: DataFrame
    counters: DataFrame


def sync(items: DataFrame, pages: DataFrame, old: DataFrame, store: ChunkStore, make: Callable[[], embed.Embedder], full_scan: bool = False, cfg: EngineConfig = DEFAULT, hashes: DataFrame | None = None) -> Synced:
    """Bring the store and the manifest up to the items.

    items: attachment_key, parent_key, citation_key, title, authors, abstract, pdf_path, pdf_mtime, pdf_size, path_exists.
    pages: attachment_key, page_number, text, error of the files (as extract() gives them). Items whose pages failed are
    recorded as failed; the others go on. Only a full scan removes what it did not find.
    hashes: attachment_key, pdf_hash (as manifest.file_hashes() gives them), which the manifest then holds.
    """
    decided = settle(manifest.decisions(items, old, cfg))
    todo = decided.filter(F.col("decision").isin("new", "changed") & (F.coalesce("citation_key", F.lit("")) != ""))
    abstracts = todo.filter(F.col("pdf_path").startswith("abstract:"))
    files = todo.filter(~F.col("pdf_path").startswith("abstract:"))
    errors = pages.filter("error is not null").select("attachment_key", F.col("error").alias("error_message")).join(files.select("attachment_key"), "attachment_key", "left_semi")
    good = pages.filter("error is null").join(files.select("attachment_key"), "attachment_key", "left_semi")
    from_pages = chunking.chunk_pages(good, cfg).join(files.select("attachment_key", "parent_key", "citation_key"), "attachment_key")
    from_abstracts = chunking.chunk_documents(abstracts.select("attachment_key", "parent_key", "citation_key", F.col("abstract").alias("text")), cfg)
    chunks = from_pages.unionByName(from_abstracts).join(todo.select("attachment_key", "title", F.array_join("authors", "; ").alias("authors")), "attachment_key")
    chunks = chunks.withColumn("document_id", F.col("parent_key")).withColumn("section_type", F.lit("other"))
    rows = settle(embed.embedded(chunks, make))
    store.replace_attachments(rows)
    counts = rows.groupBy("attachment_key").agg(F.count("*").cast("int").alias("number_of_chunks")).join(good.groupBy("attachment_key").agg(F.count("*").cast("int").alias("number_of_pages")), "attachment_key", "left")
    done = todo.join(rows.select("attachment_key").distinct(), "attachment_key", "left_semi").withColumnRenamed("zotero_version", "zotero_item_version") if "zotero_version" in todo.columns else todo.join(rows.select("attachment_key").distinct(), "attachment_key", "left_semi")
    merged = manifest.upsert(manifest.migrated(old), manifest.indexed(done, counts, hashes, cfg))
    merged = manifest.failed(merged, errors)
    merged = manifest.refresh_keys(merged, decided.filter("decision = 'unchanged'"))
    gone = settle(manifest.to_prune(merged, items, full_scan))
    store.delete_attachments(gone)
    return Synced(settle(manifest.deleted(merged, gone)), decided, rows, counters(decided, errors, rows))
