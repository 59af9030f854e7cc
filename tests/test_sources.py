import json

import pytest
from pyspark.sql import functions as F

from lumensift.functions import text as X
from lumensift.operators import rank
from lumensift.plans import answers, audit, provider, sync, tasks
from lumensift.plans.similar import UnknownKey, similar_papers
from lumensift.schemas import MANIFEST, STORED
from lumensift.sources import embed, library, manifest, pages
from lumensift.sources.store import ConcurrentWrite, ChunkStore, stale_ids
from lumensift.streaming.ingest import ingest_pages


def raw(spark, records):
    return library.records(spark.createDataFrame([(json.dumps(r),) for r in records], "json string"))


def test_items_and_attachments(spark):
    rows = raw(spark, [
        {"key": "i1", "data": {"key": "i1", "itemType": "book", "title": "T", "date": "2019-03", "citationKey": "k1", "creators": [{"firstName": "A", "lastName": "B"}, {}], "collections": ["c1"]}},
        {"key": "i2", "data": {"key": "i2", "itemType": "report", "date": "n.d.", "citationKey": "k2", "abstractNote": " Words "}},
        {"key": "i3", "data": {"key": "i3", "itemType": "report", "citationKey": "k3"}},
        {"key": "a1", "data": {"key": "a1", "itemType": "attachment", "parentItem": "i1", "contentType": "application/pdf", "path": "storage:paper.pdf"}},
    ])
    items = library.parse_items(rows)
    first = items.filter("item_key = 'i1'").first()
    assert (first.year, first.authors) == (2019, ["A B", "Unknown"]) and items.filter("item_key = 'i2'").first().year is None
    got = {r.item_key: (r.attachment_key, r.pdf_path) for r in library.eligible(items, library.pdf_attachments(rows, "/lib")).collect()}
    assert got == {"i1": ("a1", "/lib/a1/paper.pdf"), "i2": ("i2", "abstract:i2")}
    names = library.collections(raw(spark, [{"key": "c1", "data": {"key": "c1", "name": "One", "parentCollection": False}}, {"data": {"name": "no key"}}]))
    assert [(r.key, r.parent) for r in names.collect()] == [("c1", None)]
    assert library.item_collections(items, names).first().names == ["One"]
    keys = spark.createDataFrame([("i3", "found")], "item_key string, found_key string")
    assert library.with_citation_keys(items, keys).filter("item_key = 'i3'").first().citation_key == "found"


def test_export_forms(spark, tmp_path):
    record = {"key": "i1", "data": {"key": "i1", "title": "T"}}
    (tmp_path / "list.json").write_text(json.dumps([record, record]))
    (tmp_path / "page.json").write_text(json.dumps({"results": [record]}))
    assert library.read_export(spark, str(tmp_path / "list.json")).count() == 2
    assert library.read_export(spark, str(tmp_path / "page.json")).count() == 1
    (tmp_path / "names.txt").write_text("# no\n\n Reading List \n")
    assert [r.name for r in library.collection_names(spark, str(tmp_path / "names.txt")).collect()] == ["Reading List"]
    assert library.collection_names(spark, str(tmp_path / "missing.txt")).count() == 0


def test_selected_by_arrival(spark):
    rows = [("i1", "a", ["x"], 9, 1), ("i2", "b", ["x", "x"], 1, 2), ("i3", "a", ["y", "x"], 2, 3), ("i4", "c", ["z"], 3, 4), ("i5", "d", None, 3, 5)]
    items = spark.createDataFrame(rows, "item_key string, attachment_key string, collections array<string>, zotero_version int, seen int")
    assert [r.item_key for r in library.selected(items, ["x"], arrival="seen").collect()] == ["i3", "i2"]
    assert [r.item_key for r in library.selected(items, ["x"]).collect()] == ["i1", "i2"] and library.selected(items, ["x"], 1).count() == 1
    assert library.item(items, "i4").first().attachment_key == "c" and library.item(items, "none").count() == 0


def test_page_stats(spark):
    rows = spark.createDataFrame([("a", 1, "four"), ("a", 2, None), ("b", None, None)], "attachment_key string, page_number int, text string")
    assert {r.attachment_key: (r.characters, r.pages) for r in pages.stats(rows).collect()} == {"a": (4, 2), "b": (0, 0)}


def test_extract(spark, tmp_path):
    for key, body in (("a", b"one\x0ctwo"), ("b", b"broken"), ("c", b" ")):
        (tmp_path / key).mkdir()
        (tmp_path / key / "x.pdf").write_bytes(body)

    def extractor(content):
        if content == b"broken":
            raise ValueError("not a file")
        return content.decode().split("\x0c")

    rows = pages.extract(spark, str(tmp_path), extractor).orderBy("attachment_key", "page_number").collect()
    assert [(r.attachment_key, r.page_number, r.text, r.error) for r in rows] == [("a", 1, "one", None), ("a", 2, "two", None), ("b", None, None, "not a file"), ("c", None, None, "No extractable text found")]
    assert manifest.file_hashes(spark, str(tmp_path)).count() == 3


def stored(spark, rows):
    return spark.createDataFrame([(f"{a}:{i}:h", a, f"par-{a}", k, i, t, v) for a, k, i, t, v in rows], "chunk_id string, attachment_key string, parent_key string, citation_key string, chunk_index int, text string, embedding array<float>")


def test_store(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/store", buckets=4)
    assert s.count() == 0
    s.add(stored(spark, [("a", "k", 0, "t0", [1.0]), ("a", "k", 1, "t1", [1.0]), ("b", None, 0, "u", None)]))
    assert s.count() == 3 and s.by_citation_key("k").count() == 2 and s.by_attachment("b").first().citation_key == ""
    new = stored(spark, [("a", "k", 5, "new", [2.0])])
    assert sorted(r.chunk_id for r in stale_ids(s.by_attachment("a"), new).collect()) == ["a:0:h", "a:1:h"]
    s.replace_attachments(new)
    assert [r.chunk_id for r in s.ids_of("a").collect()] == ["a:5:h"] and s.count() == 2
    s.replace_attachments(new.limit(0))
    assert s.count() == 2
    s.delete_ids([])
    s.delete_ids(["a:5:h"])
    assert s.count() == 1 and "embedding" not in s.texts().columns
    s.reset()
    assert s.count() == 0


def test_store_keeps_its_buckets(spark, tmp_path):
    """Opened with another number of buckets, a store goes by its own."""
    made = ChunkStore(spark, f"file://{tmp_path}/store", buckets=4)
    made.add(stored(spark, [(f"k{i}", "k", 0, f"t{i}", [1.0]) for i in range(20)]))
    other = ChunkStore(spark, f"file://{tmp_path}/store")
    assert all(other.by_attachment(f"k{i}").count() == 1 for i in range(20)) and other.buckets == 4
    other.replace_attachments(stored(spark, [("k0", "k", 7, "new", [1.0])]))
    assert made.count() == 20 and made.by_attachment("k0").first().text == "new"


def test_store_survives_a_crash(spark, tmp_path):
    """A writer that dies at the pointer leaves the old version; half a pointer is passed over, by readers and the next writer."""
    s = ChunkStore(spark, f"file://{tmp_path}/store", buckets=2)
    s.add(stored(spark, [("a", "k", 0, "t", [1.0])]))
    pointer = max((tmp_path / "store").glob("CURRENT-*"))
    broken = pointer.with_name("CURRENT-000000000002")
    broken.write_text(pointer.read_text()[:-9])
    assert s.count() == 1
    s.add(stored(spark, [("b", "k", 0, "u", [1.0])]))
    assert s.count() == 2 and max((tmp_path / "store").glob("CURRENT-*")).name == "CURRENT-000000000003"


def test_store_two_writers(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/store", buckets=2)
    before = s._state()
    s.add(stored(spark, [("a", "k", 0, "t", [1.0])]))
    with pytest.raises(ConcurrentWrite):
        s._write(before, stored(spark, [("b", "k", 0, "u", [1.0])]), [0, 1])
    assert s.count() == 1


def test_store_works_out_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def once(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = stored(spark, [("a", "k", 0, "t", [1.0]), ("b", "k", 0, "u", [1.0])])
    ChunkStore(spark, f"file://{tmp_path}/store").replace_attachments(rows.mapInPandas(once, rows.schema))
    assert seen.value == 2


def state(spark, rows):
    return manifest.migrated(spark.createDataFrame(rows, "attachment_key string, citation_key string, pdf_path string, pdf_mtime double, pdf_size long, number_of_pages int, number_of_chunks int, indexed_at string, index_status string, pipeline_version string"))


def test_manifest(spark):
    old = state(spark, [("a", "k", "p", 1.0, 10, 3, 2, "2024", "indexed", "2"), ("b", "k2", "p", 1.0, 10, 3, 2, "2024", "indexed", "1"), ("c", "k3", "abstract:c", None, 5, 0, 1, "2024", "indexed", "2"), ("d", "k4", "p", 1.0, 1, 1, 1, "2024", "failed", "2")])
    assert old.columns == [c.split()[0] for c in MANIFEST.split(", ")]
    items = spark.createDataFrame([("a", "p", 1.0, 10, True), ("b", "p", 1.0, 10, True), ("c", "abstract:c", None, 6, None), ("d", "p", 1.0, 1, False), ("e", "p", 1.0, 1, True)], "attachment_key string, pdf_path string, pdf_mtime double, pdf_size long, path_exists boolean")
    got = {r.attachment_key: r.decision for r in manifest.decisions(items, old).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "d": "deleted", "e": "new"}
    merged = manifest.upsert(old, state(spark, [("a", "k9", "p", 2.0, 11, 3, 2, "2025", "indexed", "2")]))
    assert merged.count() == 4 and manifest.entry(merged, "a").first().citation_key == "k9"
    bad = manifest.failed(merged, spark.createDataFrame([("a", "boom"), ("z", "new one")], "attachment_key string, error_message string"))
    assert {r.attachment_key: (r.index_status, r.error_message) for r in bad.filter("attachment_key in ('a','z')").collect()} == {"a": ("failed", "boom"), "z": ("failed", "new one")}
    assert manifest.entry(bad, "a").first().pdf_size == 11
    found = spark.createDataFrame([("a",)], "attachment_key string")
    assert sorted(r.attachment_key for r in manifest.to_prune(old, found, True).collect()) == ["b", "c"] and manifest.to_prune(old, found, False).count() == 0
    assert manifest.status_counts(old).first() == (3, 5)
    keys = spark.createDataFrame([("k",), ("k4",), ("zz",)], "citation_key string")
    assert {r.citation_key: r.status for r in manifest.key_status(keys, old).collect()} == {"k": "indexed", "k4": "known", "zz": "unknown"}
    assert manifest.deleted(old, found).count() == 3 and manifest.listing(old, "failed").count() == 1


def test_audit(spark):
    m = state(spark, [("a", "k", "p", 1.0, 1, 2, 2, "2024", "indexed", "2"), ("b", "k", "p", 1.0, 1, 9, 6, "2024", "indexed", "1")])
    rows = [("a", 1, 1, "x"), ("a", 2, 3, "x")] + [("b", 1, 1, f"t{i}") for i in range(6)] + [("z", 0, 0, "w " * 801)]
    c = spark.createDataFrame(rows, "attachment_key string, page_start int, page_end int, text string")
    r = audit.index_audit(m, c).first()
    assert (r.documents, r.chunks, r.oversized_chunks, r.invalid_page_ranges, r.potential_duplicate_chunks, r.manifest_page_mismatches, r.stale_pipeline_documents, r.all_page_one_anomalies, r.passed) == (2, 9, 1, 2, 1, 0, 1, 1, False)


def test_sync_round(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/store", buckets=2)
    items = spark.createDataFrame(
        [("a", "pa", "k1", "T", ["A"], None, "x.pdf", 1.0, 5, True), ("b", "pb", "k2", "T", ["A"], "An abstract of words", "abstract:b", None, 20, None), ("c", "pc", "k3", "T", ["A"], None, "y.pdf", 1.0, 5, True), ("d", "pd", "", "T", ["A"], None, "z.pdf", 1.0, 5, True)],
        "attachment_key string, parent_key string, citation_key string, title string, authors array<string>, abstract string, pdf_path string, pdf_mtime double, pdf_size long, path_exists boolean",
    )
    text = spark.createDataFrame([("a", 1, "words of page one", None), ("a", 2, "and two", None), ("c", None, None, "cannot be opened")], "attachment_key string, page_number int, text string, error string")
    make = lambda: embed.hashing_embedder(8)
    hashes = spark.createDataFrame([("a", "f00d")], "attachment_key string, pdf_hash string")
    first = sync.sync(items, text, manifest.empty(spark), s, make, hashes=hashes)
    assert first.manifest.filter("attachment_key = 'a'").first().pdf_hash == "f00d"
    count = first.counters.first().asDict()
    assert count == {"discovered": 4, "new": 3, "changed": 0, "unchanged": 0, "deleted": 0, "no_citation": 1, "abstracts": 1, "failed": 1, "chunks": 2}
    assert {r.attachment_key: r.index_status for r in first.manifest.collect()} == {"a": "indexed", "b": "indexed", "c": "failed"}
    assert s.count() == 2 and s.by_attachment("a").first().page_end == 2
    assert sync.counters(first.decided).first().new == 4
    again = sync.sync(items.withColumn("citation_key", F.concat("citation_key", F.lit("x"))).filter("attachment_key <> 'b'"), text.limit(0), first.manifest, s, make, full_scan=True)
    assert {r.attachment_key: r.citation_key for r in again.manifest.filter("index_status = 'indexed'").collect()} == {"a": "k1x"} and s.count() == 1


def test_stream(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/store", buckets=2)
    page = spark.createDataFrame([("a", "p", "k", 1, "one two"), ("a", "p", "k", 2, "three")], "attachment_key string, parent_key string, citation_key string, page_number int, text string")
    page.write.parquet(f"file://{tmp_path}/in/1")
    page.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/drop")
    for _ in range(2):
        ingest_pages(spark, f"file://{tmp_path}/drop", s, f"file://{tmp_path}/cp", lambda: embed.hashing_embedder(8)).awaitTermination()
    assert s.count() == 1 and s.read().first().text == "one two three"
    # More pages of the same attachment in a later file, one of them anew.
    spark.createDataFrame([("a", "p", "k", 3, "four"), ("a", "p", "k", 2, "III")], page.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/drop")
    ingest_pages(spark, f"file://{tmp_path}/drop", s, f"file://{tmp_path}/cp", lambda: embed.hashing_embedder(8)).awaitTermination()
    assert s.count() == 1 and s.read().first().text == "one two III four"


# Papers and questions -----------------------------------------------------------
SENTENCE = "This passage holds enough plain words to be used as evidence in a comparison of papers, number {}."


def paper_store(spark):
    rows = []
    for i in range(6):
        v = [0.0] * 8
        v[i] = 1.0
        rows.append(("src", "source", i, SENTENCE.format(i), v))
        if i < 4:
            rows.append(("br", "broad", i, SENTENCE.format(f"b{i}"), [0.9 * x + 0.1 for x in v]))
    rows += [("si", "single", 0, SENTENCE.format("s"), [1.0] + [0.0] * 7), ("cp", "copy", 0, "All rights reserved. " + SENTENCE, [1.0] + [0.0] * 7)]
    df = stored(spark, rows)
    return df.withColumn("title", F.col("citation_key")).withColumn("section_type", F.lit("other")).withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(1)).withColumn("authors", F.lit("A")).withColumn("year", F.lit(0))


def test_similar_papers(spark):
    got = similar_papers(paper_store(spark), "source")
    assert [r.candidate for r in got.papers.collect()] == ["broad", "single"]
    assert got.papers.first().covered == 4 and got.diagnostics["representative_source_chunks"] == 6
    assert got.overlaps.filter("candidate = 'broad'").count() == 3
    with pytest.raises(UnknownKey):
        similar_papers(paper_store(spark), "nobody")
    assert similar_papers(paper_store(spark), "copy").papers.count() == 0


def question_engine(spark, reply):
    make = embed.hashing_embedder(64)
    texts = [("a", "k1", 0, "Health literacy means the skill to find and use health texts."), ("a", "k1", 1, "It was studied, for example by interviews."), ("b", "k2", 0, "Health literacy is the skill of readers."), ("c", "k3", 0, "Nothing of note.")]
    rows = stored(spark, [(a, k, i, t, make([t])[0]) for a, k, i, t in texts])
    rows = rows.withColumn("title", F.lit("T")).withColumn("section_type", F.lit("other")).withColumn("page_start", F.lit(3)).withColumn("page_end", F.lit(3)).withColumn("authors", F.lit("A")).withColumn("year", F.lit(0))
    return tasks.Engine(spark, rows, make, provider.Scripted(reply))


def ids_in(body):
    import re

    return re.findall(r"^\[(\w+)\]", body, re.M)


def test_define(spark):
    def reply(task, body):
        return [{"evidence_id": i, "requested_concept": "health-literacy", "classification": "explicit_definition", "extracted_definition": "The skill.", "confidence": "high", "concept_match": "requested_concept"} for i in [*ids_in(body), "X99"]]

    got = question_engine(spark, reply).define("health literacy").collect()
    assert len(got) == 1 and got[0].extracted_text == "The skill."
    none = question_engine(spark, reply)
    none.model = None
    assert none.define("health literacy").count() == 0 and none.define(" ").count() == 0


def test_explain_examples_summarise(spark):
    def reply(task, body):
        ids = ids_in(body)
        if task == "examples":
            return [{"statement": "Interviews.", "concept_match": "requested_concept", "confidence": "high", "evidence_ids": ids[:1]}, {"statement": "interviews", "concept_match": "requested_concept", "confidence": "medium", "evidence_ids": ids[:1]}, {"statement": "Weak", "concept_match": "requested_concept", "confidence": "low", "evidence_ids": ids[:1]}]
        if task in ("explain-synthesis", "summary-synthesis"):
            sections = ("overview", "aspect", "perspective") if task.startswith("explain") else ("topics", "limitations", "overview")
            return [{"section": sections[0], "statement": "All in all.", "evidence_ids": ["P01", "P77"]}, {"section": sections[1], "statement": "It is so [P01].", "evidence_ids": ["P01"]}, {"section": sections[2], "statement": "Made up.", "evidence_ids": ["P99"]}, {"section": sections[2], "statement": "Bare.", "evidence_ids": []}]
        return [{"statement": "A point.", "evidence_ids": ids[:1], "source_excerpt": "x", "facet": "topic"}, {"statement": "a point", "evidence_ids": ids[-1:], "source_excerpt": "xyz", "facet": "topic"}, {"statement": "Unknown ids", "evidence_ids": ["Q1"], "source_excerpt": "x", "facet": "topic"}]

    engine = question_engine(spark, reply)
    told = engine.explain("health literacy")
    row = told.points.collect()
    assert len(row) == 1 and row[0].source_excerpt == "xyz" and set(row[0].evidence_ids) <= {r.evidence_id for r in told.evidence.collect()}
    # The overview stays with the ids that are known; other statements need all of theirs.
    assert [(r.section, r.statement, r.point_ids) for r in told.statements.orderBy("ref_no").collect()] == [("overview", "All in all.", ["P01"]), ("aspect", "It is so", ["P01"])] and not told.insufficient
    keys = {r.citation_key for r in told.evidence.filter(F.col("evidence_id").isin(row[0].evidence_ids)).collect()}
    pages = told.pages.collect()
    assert {(r.ref_no, r.citation_key) for r in pages} == {(n, k) for n in (0, 1) for k in keys} and {r.citation_key for r in told.sources.collect()} == keys
    lines = [r.line for r in told.rendered().orderBy("ref_no").collect()]
    assert lines[1].startswith("It is so [P01 | ") and all(k in lines[0] for k in keys)
    assert [r.statement for r in engine.examples("health literacy").collect()] == ["Interviews."]
    told = engine.summarise("k1", "book")
    assert [r.facet for r in told.points.collect()] == ["topic"] and told.evidence.count() > 0 and told.rejected.count() == 0 and told.document_type == "book"
    assert [(r.section, r.statement) for r in told.statements.collect()] == [("limitations", "It is so")]


def test_malformed_and_missing_answers(spark):
    """Answers that stay malformed are no evidence; a provider that fails is an error."""
    told = question_engine(spark, lambda task, body: "no json").explain("health literacy")
    assert told.insufficient and told.points.count() == told.statements.count() == told.sources.count() == 0

    def broken(task, body):
        raise provider.ProviderError("gone")

    with pytest.raises(provider.ProviderError):
        question_engine(spark, broken).explain("health literacy")


def test_citation_pages(spark):
    points = spark.createDataFrame([("P01", ["E1", "E2"]), ("P02", ["E3"])], "point_id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("E1", "b", 7, 9), ("E2", "a", 0, 4), ("E3", "b", 3, 7), ("E4", "c", 1, 1), ("E5", None, 1, 1)], "evidence_id string, citation_key string, page_start int, page_end int")
    refs = spark.createDataFrame([(0, ["P02", "P01"]), (1, ["P01", "P09"]), (2, [])], "ref_no int, point_ids array<string>")
    passages = answers.cited_pages(evidence)
    got = {(r.ref_no, r.citation_key): r.pages for r in rank.citation_pages(points, passages, refs).collect()}
    assert got == {(0, "b"): [3, 7, 9], (0, "a"): [4], (1, "b"): [7, 9], (1, "a"): [4]}
    assert [(r.citation_key, r.pages) for r in rank.sources(points, passages, refs).orderBy("first").collect()] == [("b", [3, 7, 9]), ("a", [4])]


def test_classify(spark):
    calls = []

    def reply(task, body):
        calls.append(body)
        ids = ids_in(calls[0])
        bad = len(calls) == 1
        return [{"evidence_id": "Smith 2004" if bad else i, "requested_concept": "Health  Literacy", "classification": "explicit_definition", "extracted_definition": "", "confidence": "high", "concept_match": "requested_concept"} for i in ids[:3]]

    engine = question_engine(spark, reply)
    got = engine.classify("health literacy", 2).collect()
    assert len(calls) == 2 and [r.evidence_id for r in got] == ["P01", "P02"] and all(r.classification == "explicit_definition" and r.definition_text for r in got)
    none = question_engine(spark, lambda task, body: [])
    assert none.classify("health literacy").count() == 0
    assert {r.classification for r in none.classify("health literacy", 2, discussion=True).collect()} == {"unclassified_candidate"}
    silent = question_engine(spark, lambda task, body: "?")
    assert silent.classify("health literacy").count() == 0 and silent.classify("health literacy", 1, discussion=True).count() == 1


def test_chat_service():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def _say(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._say(200, {"data": []})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if asked["model"] == "none":
                return self._say(404, {})
            self._say(200, {"choices": [{"message": {"content": f"{asked['messages'][0]['content']} {self.headers['Authorization']}"}}]})

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1"
    good = provider.create("chat", base=base, model="m", key="k")
    assert good.available() and good.answer([{"role": "user", "content": "hello"}], "t") == "hello Bearer k"
    with pytest.raises(provider.ConfigError):
        provider.create("chat", base=base, model="none").answer([], "t")
    server.shutdown()
    server.server_close()
    gone = provider.create("chat", base=base, model="m", timeout=2.0)
    assert not gone.available()
    with pytest.raises(provider.ProviderError):
        gone.answer([], "t")


def test_provider():
    calls = []

    def reply(task, body):
        calls.append(body)
        return "no json" if len(calls) == 1 else "```json\n[]\n```"

    assert provider.structured(provider.Scripted(reply), [{"role": "user", "content": "q"}], provider.POINT, "t") == [] and len(calls) == 2
    with pytest.raises(provider.SchemaError):
        provider.validated([{"statement": "x", "evidence_ids": [], "extra": 1}], provider.POINT)
    with pytest.raises(provider.SchemaError):
        provider.validated([{"statement": "x", "concept_match": "y", "evidence_ids": [], "confidence": "sure"}], provider.EXAMPLE)
    with pytest.raises(provider.ConfigError):
        provider.create("nobody")
    assert tasks._same("organisation-theory", "Organization theory") and not tasks._same("a", "b")


def test_schemas(spark):
    assert [c.split()[0] for c in STORED.split(", ")][0] == "chunk_id"
    assert X.facet_queries("k")[0] == ("topic", 0, "k topic")


def test_session(spark):
    from lumensift.session import Session, parse_author

    states = state(spark, [("a", "k1", "p", 1.0, 10, 3, 2, "2024", "indexed", "2")])
    s = Session(question_engine(spark, lambda task, body: []), states)
    assert parse_author(["x", "--author", "Roe", "y"]) == (["x", "y"], "Roe") and parse_author(["--author=Poe"]) == ([], "Poe")
    s.run("set source k1, zz, k1")
    assert {r.citation_key: r.status for r in s.run("show").collect()} == {"k1": "indexed", "zz": "unknown"}
    s.run("clear")
    assert s.run("search health literacy").count() == 4 and s.seen[:1] and s.run("find health --author Nobody").count() == 0
    assert s.run("evidence a:0:h").count() == 1 and s.run("define health literacy").count() == 0
    with pytest.raises(ValueError):
        s.run("search ' '")
    with pytest.raises(ValueError):
        s.run("dance")


def page_texts(content):
    return [t for t in content.decode().split("\f")]


def test_command_line(spark, tmp_path, capsys):
    """sync, status, documents, define without a model, the shell, and purge, over a small library."""
    from lumensift.__main__ import main

    dump = [
        {"key": "i1", "data": {"key": "i1", "itemType": "book", "title": "One", "citationKey": "one", "collections": ["c1"], "version": 1}},
        {"key": "a1", "data": {"key": "a1", "itemType": "attachment", "parentItem": "i1", "contentType": "application/pdf", "filename": "x.pdf"}},
        {"key": "i2", "data": {"key": "i2", "itemType": "book", "title": "Two", "citationKey": "two", "abstractNote": "Trust means confidence.", "collections": []}},
    ]
    (tmp_path / "dump.json").write_text(json.dumps(dump))
    (tmp_path / "files" / "a1").mkdir(parents=True)
    (tmp_path / "files" / "a1" / "x.pdf").write_text("Trust is the belief in others.\fPage two.")
    base = ["--store", f"file://{tmp_path}/store", "--manifest", f"file://{tmp_path}/manifest"]
    ingest = ["--export", f"file://{tmp_path}/dump.json", "--files", f"file://{tmp_path}/files", "--extractor", f"{__name__}:page_texts"]
    assert main([*base, "sync", *ingest]) == 0
    states = {r.attachment_key: r for r in spark.read.parquet(f"file://{tmp_path}/manifest").collect()}
    assert {k: r.index_status for k, r in states.items()} == {"a1": "indexed", "i2": "indexed"} and len(states["a1"].pdf_hash) == 64
    assert main([*base, "sync", *ingest]) == 0
    assert capsys.readouterr().out.splitlines()[-1].split("\t")[:4] == ["2", "0", "0", "2"]
    assert main([*base, "documents"]) == 0 and "one" in capsys.readouterr().out
    assert main([*base, "examples", "trust"]) == 0
    assert main([*base, "rebuild", *ingest]) == 0 and ChunkStore(spark, f"file://{tmp_path}/store").count() == 2
    assert main([*base, "purge"]) == 1 and main([*base, "purge", "--yes"]) == 0 and ChunkStore(spark, f"file://{tmp_path}/store").count() == 0
