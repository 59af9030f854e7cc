"""The index manifest: one state per attachment, merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.schemas import MANIFEST, names, struct

COLUMNS = names(MANIFEST)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], struct(MANIFEST))


def migrated(rows: DataFrame) -> DataFrame:
    """Rows of an older manifest in today's columns; what it lacks is null."""
    return empty(rows.sparkSession).unionByName(rows, allowMissingColumns=True).select(*COLUMNS)


def upsert(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """New states in place of old ones of the same key; of several new ones the last (by `order`, else any one state)."""
    rows = old.select(*COLUMNS, F.lit(0).alias("_s"), F.lit(None).cast("string").alias("_o")).unionByName(new.select(*COLUMNS, F.lit(1).alias("_s"), (F.col(order).cast("string") if order else F.lit(None).cast("string")).alias("_o")))
    last = F.row_number().over(W.partitionBy("attachment_key").orderBy(F.desc("_s"), F.desc_nulls_last("_o"), F.desc_nulls_last("indexed_at")))
    return rows.withColumn("_n", last).filter("_n = 1").select(*COLUMNS)


def deleted(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.select("attachment_key").distinct(), "attachment_key", "left_anti")


def entry(manifest: DataFrame, key: str) -> DataFrame:
    return manifest.filter(F.col("attachment_key") == key)


def listing(manifest: DataFrame, status: str | None = None, path: bool = False) -> DataFrame:
    rows = manifest if status is None else manifest.filter(F.col("index_status") == status)
    name = F.col("pdf_path") if path else F.regexp_extract("pdf_path", r"([^/]*)\z", 1)
    return rows.select("attachment_key", "citation_key", name.alias("name"), "index_status").orderBy("attachment_key")


def decisions(items: DataFrame, manifest: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Items with `decision`: new, changed, unchanged or deleted.

    items: attachment_key, pdf_path, pdf_mtime, pdf_size, path_exists. An abstract's size is its text's length.
    """
    old = manifest.select("attachment_key", F.col("pdf_mtime").alias("m_mtime"), F.col("pdf_size").alias("m_size"), F.col("pipeline_version").alias("m_version"), F.lit(True).alias("m_known"))
    same_size, same_time = F.col("pdf_size").eqNullSafe(F.col("m_size")), F.col("pdf_mtime").eqNullSafe(F.col("m_mtime"))
    abstract = F.col("pdf_path").startswith("abstract:")
    decision = (
        F.when(F.col("m_known").isNull(), "new").when(~F.col("m_version").eqNullSafe(F.lit(cfg.pipeline_version)), "changed")
        .when(abstract, F.when(same_size, "unchanged").otherwise("changed")).when(~F.coalesce("path_exists", F.lit(False)), "deleted")
        .when(~same_size | ~same_time, "changed").otherwise("unchanged")
    )
    return items.join(old, "attachment_key", "left").withColumn("decision", decision).drop("m_mtime", "m_size", "m_version", "m_known")


def indexed(items: DataFrame, counts: DataFrame, hashes: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """States of indexed items: items ⋈ counts (attachment_key, number_of_pages, number_of_chunks), file hashes where given, no error."""
    rows = items.join(counts, "attachment_key", "left")
    rows = rows.join(hashes.select("attachment_key", "pdf_hash"), "attachment_key", "left") if hashes is not None else rows
    rows = rows.withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).withColumn("index_status", F.lit("indexed")).withColumn("pipeline_version", F.lit(cfg.pipeline_version))
    return migrated(rows.select(*[c for c in COLUMNS if c in rows.columns]))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(attachment_key, pdf_hash) of the files below a folder, by the folder each lies in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]*\z", 1).alias("attachment_key"), F.sha2("content", 256).alias("pdf_hash"))


def failed(manifest: DataFrame, errors: DataFrame) -> DataFrame:
    """The manifest with failures (attachment_key, error_message): known rows keep all but status, error and time; others are new."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    e = errors.select("attachment_key", F.col("error_message").alias("e_message"), F.lit(True).alias("e_failed"))
    both = manifest.join(e, "attachment_key", "full")
    hit = F.col("e_failed").isNotNull()
    return both.withColumn("error_message", F.when(hit, F.col("e_message")).otherwise(F.col("error_message"))).withColumn("index_status", F.when(hit, "failed").otherwise(F.col("index_status"))).withColumn("indexed_at", F.when(hit, now).otherwise(F.col("indexed_at"))).select(*COLUMNS)


def refresh_keys(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """New citation keys of unchanged items, without indexing again."""
    new = items.select("attachment_key", F.nullif("citation_key", F.lit("")).alias("n_key"))
    return manifest.join(new, "attachment_key", "left").withColumn("citation_key", F.coalesce("n_key", "citation_key")).select(*COLUMNS)


def to_prune(manifest: DataFrame, discovered: DataFrame, full_scan: bool) -> DataFrame:
    """(attachment_key): indexed entries that a full scan no longer finds; a partial scan prunes nothing."""
    rows = manifest.filter("index_status = 'indexed'").select("attachment_key")
    return rows.join(discovered.select("attachment_key"), "attachment_key", "left_anti") if full_scan else rows.limit(0)


def key_status(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """(citation_key, status): whether requested keys are indexed, known without text, or unknown."""
    last = manifest.groupBy("citation_key").agg(F.max_by("index_status", F.struct("indexed_at", "attachment_key")).alias("s"), F.max((F.col("index_status") == "indexed").cast("int")).alias("i"))
    return keys.join(last, "citation_key", "left").select("citation_key", F.when(F.col("i") == 1, "indexed").when(F.col("s").isNotNull(), "known").otherwise("unknown").alias("status"))


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("index_status") == "indexed").alias("documents"), F.coalesce(F.sum(F.when(F.col("index_status") == "indexed", F.col("number_of_chunks"))), F.lit(0)).alias("chunks"))
