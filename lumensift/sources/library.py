"""A reference library's export: items, attachments, collections and citation keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.functions import text as X

CREATOR = "struct<creatorType:string,firstName:string,lastName:string>"
DATA = f"struct<key:string,parentItem:string,title:string,date:string,publicationTitle:string,DOI:string,url:string,itemType:string,citationKey:string,abstractNote:string,creators:array<{CREATOR}>,tags:array<struct<tag:string>>,collections:array<string>,attachmentKey:string,path:string,contentType:string,filename:string,version:int,name:string,parentCollection:string>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Raw records (key, data, json) of a dump: one JSON object to a line, or whole lists, or {"results": [...]} pages."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.coalesce(F.from_json("value", "struct<results:array<string>>")["results"], F.split(F.trim("value"), r"\n(?=\s*\{)")))).alias("json"))
    return records(rows)


def records(rows: DataFrame) -> DataFrame:
    """(json) to (key, data, json); what is no object is dropped."""
    parsed = rows.withColumn("r", F.from_json("json", f"struct<key:string,data:{DATA}>")).filter("r is not null and (r.key is not null or r.data is not null)")
    return parsed.select(F.coalesce("r.data.key", "r.key").alias("key"), F.col("r.data").alias("data"), F.get_json_object("json", "$.data").alias("json"))


def year_of(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"\A(\d{4})", 1), F.lit("")).try_cast("int")


def authors_of(creators: Column) -> Column:
    return F.transform(creators, lambda c: X.full_name(c["firstName"], c["lastName"]))


def parse_items(raw: DataFrame) -> DataFrame:
    """Raw records as typed items."""
    d = lambda name: F.col(f"data.{name}")
    return raw.select(
        F.coalesce("key", F.lit("")).alias("item_key"), d("parentItem").alias("parent_key"), d("title").alias("title"), year_of(d("date")).alias("year"), d("publicationTitle").alias("publication_title"),
        d("DOI").alias("doi"), d("url").alias("url"), d("itemType").alias("item_type"), authors_of(d("creators")).alias("authors"),
        F.filter(F.transform(d("tags"), lambda t: t["tag"]), lambda t: t.isNotNull() & (t != "")).alias("tags"), d("collections").alias("collections"), d("attachmentKey").alias("attachment_key"),
        d("path").alias("pdf_path"), d("citationKey").alias("citation_key"), d("abstractNote").alias("abstract"), d("version").alias("zotero_version"), "json",
    )


def collections(raw: DataFrame) -> DataFrame:
    """(key, name, parent); records without key or name are dropped, "false" is no parent."""
    parent = F.nullif(F.col("data.parentCollection"), F.lit("false"))
    return raw.select("key", F.col("data.name").alias("name"), parent.alias("parent")).filter("key is not null and name is not null")


def attachment_path(path: Column, filename: Column, attachment: Column, storage_dir: str) -> Column:
    """Stored files ("storage:" or a bare name) below the storage folder; other paths as they are."""
    name = F.when(path.startswith("storage:"), F.substring(path, 9, 1_000_000)).when(path.isNull() | (path == ""), filename).when(~path.contains("/"), path)
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat_ws("/", F.lit(storage_dir), attachment, name)).otherwise(F.nullif(path, F.lit("")))


def pdf_attachments(raw: DataFrame, storage_dir: str) -> DataFrame:
    """(parent_key, attachment_key, pdf_path): the first PDF child of each item, by content type or file name."""
    d = lambda name: F.col(f"data.{name}")
    named = F.coalesce(d("filename"), d("path"), F.lit(""))
    pdfs = raw.filter((d("itemType") == "attachment") & ((d("contentType") == "application/pdf") | F.lower(named).endswith(".pdf")))
    rows = pdfs.select(d("parentItem").alias("parent_key"), F.col("key").alias("attachment_key"), attachment_path(d("path"), d("filename"), F.col("key"), storage_dir).alias("pdf_path"))
    first = F.row_number().over(W.partitionBy("parent_key").orderBy("attachment_key"))
    return rows.filter("parent_key is not null").withColumn("_n", first).filter("_n = 1").drop("_n")


def eligible(items: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Items to index: no attachments, with a citation key; their PDF, else their abstract as a source of its own, else dropped."""
    own = items.filter((F.coalesce("item_type", F.lit("")) != "attachment") & (F.coalesce("citation_key", F.lit("")) != "")).drop("attachment_key", "pdf_path")
    joined = own.join(pdfs.select(F.col("parent_key").alias("item_key"), "attachment_key", "pdf_path"), "item_key", "left")
    has_abstract = X.trim(F.coalesce("abstract", F.lit(""))) != ""
    joined = joined.filter(F.col("attachment_key").isNotNull() | has_abstract)
    return joined.withColumn("pdf_path", F.coalesce("pdf_path", F.concat(F.lit("abstract:"), "item_key"))).withColumn("attachment_key", F.coalesce("attachment_key", "item_key"))


def with_citation_keys(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Citation keys of a key table (item_key, found_key), where it has one."""
    return items.join(keys.select("item_key", "found_key"), "item_key", "left").withColumn("citation_key", F.coalesce(F.nullif("found_key", F.lit("")), "citation_key")).drop("found_key")


def item_collections(items: DataFrame, names: DataFrame) -> DataFrame:
    """(item_key, names): each item's collection names in the order of its list."""
    rows = items.select("item_key", F.posexplode("collections").alias("i", "key")).join(names.select("key", "name"), "key")
    return rows.groupBy("item_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("names"))


def selected(items: DataFrame, ids: list[str], limit: int | None = None, arrival: str | None = None) -> DataFrame:
    """Items of any of the collections, one to an attachment: the last to arrive, at the place of the first.

    `arrival` names the column of the order of arrival (unique within an attachment); without one it is the item's version, then its key.
    """
    rows = items.filter(F.arrays_overlap("collections", F.array(*[F.lit(i) for i in ids])))
    order = F.struct(F.col(arrival)) if arrival else F.struct(F.coalesce("zotero_version", F.lit(-1)), "item_key")
    own = W.partitionBy("attachment_key")
    rows = rows.withColumn("_o", order).withColumn("_first", F.min("_o").over(own)).withColumn("_n", F.row_number().over(own.orderBy(F.desc("_o")))).filter("_n = 1")
    placed = rows.orderBy("_first", "attachment_key") if arrival else rows.orderBy("attachment_key")
    return (placed.limit(limit) if limit else placed).drop("_o", "_first", "_n")


def item(items: DataFrame, key: str) -> DataFrame:
    return items.filter(F.col("item_key") == key).limit(1)


def collection_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): lines of a file, trimmed; blank ones and comments are left out. A missing file has none."""
    try:
        rows = spark.read.text(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "name string")
    return rows.select(X.trim(F.col("value")).alias("name")).filter("name <> '' and name not like '#%'")
