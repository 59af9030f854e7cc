"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

SENTENCE = "struct<sentence_id:string,paragraph_id:string,page_number:int,section_type:string,section_title:string,text:string,normalized_text:string,ordering:int>"
PARAGRAPH = f"struct<paragraph_id:string,page_number:int,section_type:string,section_title:string,text:string,sentences:array<{SENTENCE}>,ordering:int>"
PAGE = f"attachment_key string, page_number int, text string, paragraphs array<{PARAGRAPH}>"
CHUNK = "chunk_id string, attachment_key string, parent_key string, citation_key string, text string, page_start int, page_end int, section_type string, section_title string, sentence_ids array<string>, paragraph_ids array<string>, chunk_index int, content_hash string"
#: The stored form of a chunk.
STORED = "chunk_id string, attachment_key string, parent_key string, citation_key string, title string, authors string, year int, doi string, document_id string, chunk_index int, page_start int, page_end int, section_type string, section_title string, text string, embedding array<float>"
EXTRACTION = "attachment_key string, pdf_path string, page_number int, text string, requires_ocr boolean, error string"
ITEM = "item_key string, parent_key string, title string, year int, publication_title string, doi string, url string, item_type string, authors array<string>, tags array<string>, collections array<string>, attachment_key string, pdf_path string, citation_key string, abstract string, zotero_version int, json string"
MANIFEST = "attachment_key string, parent_key string, citation_key string, zotero_item_version int, pdf_path string, pdf_mtime double, pdf_size long, pdf_hash string, content_hash string, embedding_model string, embedding_config_hash string, chunker_version string, chunker_config_hash string, indexed_at string, number_of_pages int, number_of_chunks int, index_status string, error_message string, pipeline_version string"


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [column.split()[0] for column in ddl.split(", ")]


def struct(ddl: str) -> T.StructType:
    """The schema as a type (asks a running session)."""
    return T.StructType.fromDDL(ddl)
