"""Page text of PDF files through an injected extractor."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import text as X
from lumensift.io import ship
from lumensift.schemas import EXTRACTION

#: From a file's bytes to its pages' raw texts; raises where the file cannot be opened.
Extractor = Callable[[bytes], list[str]]


def extract(spark: SparkSession, path: str, extractor: Extractor) -> DataFrame:
    """(attachment_key, pdf_path, page_number, text, requires_ocr, error): one row a page; files that fail or hold no text have one row with the reason.

    Files are read as binary rows, so the scan spreads them; the attachment key is the file's folder.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"]):
                key = os.path.basename(os.path.dirname(p))
                try:
                    pages = extractor(bytes(content))
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failure
                    rows.append((key, p, None, None, True, str(e)))
                    continue
                if not any(t and t.strip() for t in pages):
                    rows.append((key, p, None, None, True, "No extractable text found"))
                    continue
                rows += [(key, p, i, t, False, None) for i, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["attachment_key", "pdf_path", "page_number", "text", "requires_ocr", "error"]).astype({"page_number": "Int32"})

    return files.mapInPandas(run, EXTRACTION).withColumn("text", X.normalise_text(F.col("text")))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(attachment_key, page_number, paragraph_id, ordering, text) of pages."""
    rows = pages.select("attachment_key", "page_number", F.explode(X.paragraph_array(F.col("text"))).alias("p"))
    ident = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit(":"), (F.col("p.ordering") + 1).cast("string"))
    return rows.select("attachment_key", "page_number", ident.alias("paragraph_id"), F.col("p.ordering").alias("ordering"), F.col("p.text").alias("text"))


def sentences(paras: DataFrame) -> DataFrame:
    """(..., sentence_id, ordering, text, normalized_text) of paragraphs, split simply."""
    rows = paras.select("attachment_key", "page_number", "paragraph_id", F.posexplode(X.simple_sentences(F.col("text"))).alias("ordering", "text"))
    return rows.withColumn("sentence_id", F.concat(F.col("paragraph_id"), F.lit(":s"), (F.col("ordering") + 1).cast("string"))).withColumn("normalized_text", X.collapse(F.lower("text")))


def stats(extracted: DataFrame) -> DataFrame:
    """(attachment_key, characters, pages)"""
    return extracted.groupBy("attachment_key").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.count("page_number").alias("pages"))
