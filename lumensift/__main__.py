"""Command line over a store and a manifest: status, audit-index, documents, find, find-similar, sync, rebuild, purge, define, explain, examples, summarize-paper and shell.

Questions to a model go to a service with the chat-completions interface (--service, --model, and a key in the variable that
--key-from names). Embeddings come from the function that --embedder names (module:function, made once in each worker), else
from the hashing stand-in.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.io import settle
from lumensift.operators import closure
from lumensift.plans import answers, audit, find, provider, similar, sync, tasks
from lumensift.session import Session
from lumensift.sources import embed, library, manifest, pages
from lumensift.sources.store import ChunkStore


def named(spark: SparkSession, spec: str):
    """module:function as the function; a module of one file is given to the executors."""
    name, _, function = spec.partition(":")
    module = importlib.import_module(name)
    if "." not in name and not hasattr(module, "__path__"):
        spark.sparkContext.addPyFile(module.__file__)
    return getattr(module, function)


def items_of(spark: SparkSession, export: str, files: str, collections: list[str]) -> DataFrame:
    """The export's items to index (of the collections named, with all below them), with what the file system knows of their files."""
    raw = library.read_export(spark, export)
    items = library.eligible(library.parse_items(raw), library.pdf_attachments(raw, files))
    if collections:
        ids = [r.key for r in closure.descendants(library.collections(raw), collections).collect()]
        items = library.selected(items, ids)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(files)
    known = found.select(F.regexp_extract("path", r"([^/]+)/[^/]*\z", 1).alias("attachment_key"), F.unix_micros("modificationTime").alias("t"), F.col("length").alias("size"))
    joined = items.join(known, "attachment_key", "left")
    abstract = F.col("pdf_path").startswith("abstract:")
    return joined.select(
        "attachment_key", F.coalesce("parent_key", "item_key").alias("parent_key"), "citation_key", "title", "authors", "abstract", "pdf_path", "zotero_version",
        (F.col("t") / 1e6).alias("pdf_mtime"), F.when(abstract, F.length("abstract")).otherwise(F.col("size")).cast("long").alias("pdf_size"), F.col("t").isNotNull().alias("path_exists"),
    )


def shown(result) -> None:
    """Every row of a listing, as it comes; the driver holds one partition at a time."""
    if isinstance(result, answers.Answer):
        result = result.rendered().orderBy("ref_no")
    elif isinstance(result, similar.Similar):
        result = result.papers
    if isinstance(result, DataFrame):
        print("\t".join(result.columns))
        for row in result.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
    elif result is not None:
        print(result)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumensift", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the chunk store")
    p.add_argument("--manifest", required=True, help="Parquet table of the manifest")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("status")
    sub.add_parser("audit-index")
    docs = sub.add_parser("documents")
    docs.add_argument("--status")
    docs.add_argument("--path", action="store_true")
    found = sub.add_parser("find")
    found.add_argument("query")
    near = sub.add_parser("find-similar")
    near.add_argument("key")
    purge = sub.add_parser("purge")
    purge.add_argument("--yes", action="store_true")
    for name in ("sync", "rebuild"):
        ingest = sub.add_parser(name)
        ingest.add_argument("--export", required=True, help="dump of the library")
        ingest.add_argument("--files", required=True, help="folder of the files, one folder an attachment")
        ingest.add_argument("--extractor", required=True, help="module:function from a file's bytes to its pages' texts")
        ingest.add_argument("--collection", action="append", default=[], help="only this collection and those below it")
        ingest.add_argument("--full-scan", action="store_true", help="remove what is not found any more")
    for name, word in (("define", "concept"), ("explain", "concept"), ("examples", "concept"), ("summarize-paper", "key"), ("shell", None)):
        ask = sub.add_parser(name)
        if word:
            ask.add_argument("words", metavar=word)
        ask.add_argument("--service")
        ask.add_argument("--model")
        ask.add_argument("--key-from", default="LUMENSIFT_KEY")
    for command in sub.choices.values():
        command.add_argument("--embedder", help="module:function that makes an embedder")
        command.add_argument("--width", type=int, default=64, help="values of the hashing stand-in's vectors")
    args = p.parse_args(argv)

    spark = SparkSession.builder.appName("lumensift").getOrCreate()
    store = ChunkStore(spark, args.store)
    make = named(spark, args.embedder) if args.embedder else lambda width=args.width: embed.hashing_embedder(width)
    if args.command in ("sync", "rebuild"):
        try:
            states = spark.read.parquet(args.manifest)
        except Exception as e:  # noqa: BLE001 - a first run has no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            states = manifest.empty(spark)
        if args.command == "rebuild":
            store.reset()
            states = manifest.empty(spark)
        items = settle(items_of(spark, args.export, args.files, args.collection))
        text = settle(pages.extract(spark, args.files, named(spark, args.extractor)))
        done = sync.sync(items, text, settle(states), store, make, args.full_scan and not args.collection, hashes=manifest.file_hashes(spark, args.files))
        done.manifest.write.mode("overwrite").parquet(args.manifest)
        shown(done.counters)
        return 1 if done.counters.first().failed else 0
    states = spark.read.parquet(args.manifest)
    if args.command in ("define", "explain", "examples", "summarize-paper", "shell"):
        model = provider.create("chat", base=args.service, model=args.model, key=os.environ.get(args.key_from)) if args.service else None
        session = Session(tasks.Engine(spark, store.read(), make(), model), states)
        if args.command == "shell":
            for line in sys.stdin:
                if line.strip() in ("quit", "exit"):
                    break
                try:
                    shown(session.run(line))
                except (ValueError, similar.UnknownKey, provider.ProviderError) as e:
                    print(f"error: {e}")
            return 0
        shown({"define": session.define, "explain": session.explain, "examples": session.examples, "summarize-paper": session.summarise}[args.command](args.words))
        return 0
    if args.command == "status":
        manifest.status_counts(states).show(truncate=False)
    elif args.command == "audit-index":
        result = audit.index_audit(states, store.texts())
        result.show(truncate=False, vertical=True)
        return 0 if result.first().passed else 1
    elif args.command == "documents":
        shown(manifest.listing(states, args.status, args.path))
    elif args.command == "find":
        find.find(store.read(), make()([args.query])[0]).show(truncate=False)
    elif args.command == "find-similar":
        try:
            similar.similar_papers(store.read(), args.key).papers.show(truncate=False)
        except similar.UnknownKey:
            known = manifest.key_status(spark.createDataFrame([(args.key,)], "citation_key string"), states).first().status
            print(f"{args.key}: {'no text in the store' if known != 'unknown' else 'unknown key'}")
            return 1
    elif args.command == "purge":
        if not args.yes:
            print("purge needs --yes")
            return 1
        store.reset()
        manifest.empty(spark).write.mode("overwrite").parquet(args.manifest)
    return 0


if __name__ == "__main__":
    sys.exit(main())
