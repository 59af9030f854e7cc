"""define, classify, explain, examples and summarise: retrieval plans around bounded model calls.

Retrieval, ranking, expansion and deduplication are DataFrames; what reaches the driver is the
bounded evidence of a question (some tens of passages), in batches, and the answers come back as
small DataFrames that are joined with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import text as X
from lumensift.functions.boilerplate import excluded_for
from lumensift.io import settle
from lumensift.operators import context, knn, rank
from lumensift.plans import answers, find, prompts, provider

ACCEPTED = ("explicit_definition", "operational_definition", "conceptualization")
NO_ROWS_POINT = "point_id string, statement string, facet string, evidence_ids array<string>, source_excerpt string, pos int"


@dataclass
class Engine:
    """What a question needs: the store's rows, an embedding function, and a model if there is one."""

    spark: SparkSession
    store: DataFrame
    embed: Callable[[list[str]], list[list[float]]]
    model: provider.Provider | None = None
    cfg: EngineConfig = DEFAULT

    # retrieval -----------------------------------------------------------
    def _results(self, queries: list[str], k: int, filters: knn.Filters | None) -> list[DataFrame]:
        return [find.search(self.store, v, filters, k, self.cfg) for v in self.embed(queries)]

    def ranked(self, concept: str, filters: knn.Filters | None = None) -> DataFrame:
        """The concept's candidates over all its query variants."""
        queries = X.query_variants(concept)
        rows = find.union_first(self._results(queries, self.cfg.define_top_k, filters)) if queries else knn.hits(self.store.withColumn("score", F.lit(0.0))).limit(0).withColumn("pos", F.lit(0))
        return settle(rank.rank_candidates(rows, concept, self.cfg))

    def expanded(self, anchors: DataFrame, max_words: int, key: list, order: list) -> DataFrame:
        """Anchors with their texts widened by their neighbours; of equal passages the first."""
        needed = self.store.join(anchors.select("attachment_key").distinct(), "attachment_key", "left_semi").select("chunk_id", "attachment_key", "text")
        wide = context.expand(anchors, context.ordered_siblings(needed), self.cfg.context_before, self.cfg.context_after, max_words, True, self.cfg)
        rows = anchors.drop("text").join(wide.withColumnRenamed("anchor_id", "chunk_id"), "chunk_id")
        return rank.keep_one(rows, key, order)

    def _ask(self, evidence: DataFrame, task: str, schema: provider.Schema, question: str, chars: int) -> list[dict]:
        """Batches of evidence to the model; the answers with the ids of their batch."""
        rows = evidence.select("evidence_id", "batch", X.evidence_excerpt(F.col("text"), chars).alias("text"), *(["facet"] if "facet" in evidence.columns else [])).orderBy("evidence_id").collect()
        out = []
        for b in sorted({r.batch for r in rows}):
            own = [r for r in rows if r.batch == b]
            body = "\n\n".join(f"[{r.evidence_id}] {r.text}" for r in own)
            ids = [r.evidence_id for r in own]
            messages = prompts.messages(task, question, body, own[0].facet if "facet" in own[0] else None)
            for a in provider.structured(self.model, messages, schema, task):
                out.append(a | {"batch_ids": ids} | ({"asked_facet": own[0].facet} if "facet" in own[0] else {}))
        return out

    # questions -----------------------------------------------------------
    def define(self, concept: str, k: int = 5, filters: knn.Filters | None = None) -> DataFrame:
        """Definitions found in the candidates, best first; none without a model."""
        schema = "evidence_id string, extracted_text string, classification string, confidence string"
        anchors = self.ranked(concept, filters)
        found: list[tuple] = []
        if self.model is None or not self.cfg.llm_enabled:
            evidence = rank.batches(anchors, [F.desc("candidate_score"), "pos"], self.cfg.define_batch, "D")
        else:
            wide = self.expanded(anchors, self.cfg.define_context_words, [F.col("citation_key"), F.substring(X.collapse(F.lower("text")), 1, 1000)], [F.desc("candidate_score"), "pos"])
            evidence = settle(rank.batches(wide, [F.desc("candidate_score"), "pos"], self.cfg.define_batch, "D"))
            got = self._ask(evidence, "define", provider.ASSESSMENT, f"Which passages define {concept}?", self.cfg.define_chars)
            ok = [a for a in got if a["evidence_id"] in a["batch_ids"] and a["classification"] in ACCEPTED and a["concept_match"] == "requested_concept" and _same(concept, a["requested_concept"])]
            found = [(a["evidence_id"], a["extracted_definition"], a["classification"], a["confidence"]) for a in ok]
        joined = evidence.drop("confidence").join(self.spark.createDataFrame(found, schema), "evidence_id")
        # Where the model quotes nothing, the passage's own defining sentence stands.
        quoted = F.nullif(X.trim(F.col("extracted_text")), F.lit(""))
        # Settled, so that the compatibility form (Python) is taken of rows as they lie and never within the join before it.
        return rank.best_definitions(settle(joined.withColumn("extracted_text", X.trim(F.coalesce(quoted, X.definition_text(F.col("text")))))), k)

    def classify(self, concept: str, k: int = 5, discussion: bool = False, filters: knn.Filters | None = None) -> DataFrame:
        """The single-stage form of define: one question over the ten best candidates, in retrieval order, the first k accepted.

        Where nothing is accepted the question is put once more with a correction. Without a model, or with `discussion`
        when nothing is accepted or the answer is malformed, the best candidates stand as unclassified_candidate.
        """
        ranked = self.ranked(concept, filters)
        evidence = settle(rank.batches(ranked, [F.desc("candidate_score"), "pos"], 10, "P"))
        classes = ("explicit_definition", "implicit_definition", *(("conceptual_discussion",) if discussion else ()))
        hits: list[tuple] = []
        if self.model is not None and self.cfg.llm_enabled:
            rows = evidence.filter("batch = 0").select("evidence_id", X.evidence_excerpt(F.col("text"), self.cfg.classify_chars).alias("text")).orderBy("evidence_id").collect()
            asked = prompts.messages("classify", f"Which passages define {concept}?", "\n\n".join(f"[{r.evidence_id}] {r.text}" for r in rows))
            ids = {r.evidence_id for r in rows}
            for _ in range(2 if rows else 0):
                try:
                    got = provider.structured(self.model, asked, provider.ASSESSMENT, "classify")
                except provider.SchemaError:
                    break
                ok = [a for a in got if a["evidence_id"] in ids and a["classification"] in classes and a["concept_match"] == "requested_concept" and _same(concept, a["requested_concept"])]
                hits = [(a["evidence_id"], a["classification"], a["confidence"], n) for n, a in enumerate(ok[:k])]
                if hits:
                    break
                asked = [*asked, {"role": "user", "content": prompts.CORRECTION}]
        model_off = self.model is None or not self.cfg.llm_enabled
        if not hits and (model_off or discussion):
            hits = [(f"P{n + 1:02d}", "unclassified_candidate", None, n) for n in range(k)]
        judged = self.spark.createDataFrame(hits, "evidence_id string, classification string, confidence string, place int")
        whole = X.trim(F.col("text"))
        text = F.when(F.lit(discussion) & (F.col("classification") != "unclassified_candidate"), whole).otherwise(X.definition_text(F.col("text")))
        return evidence.drop("confidence").join(judged, "evidence_id").withColumn("definition_text", text).withColumn("page", F.nullif("page_start", F.lit(0))).orderBy("place").drop("place", "batch")

    def explain(self, concept: str, filters: knn.Filters | None = None) -> answers.Answer:
        """The best anchors' points, duplicates merged, and what the model makes of them; insufficient without points."""
        anchors = self.ranked(concept, filters).orderBy(F.desc("candidate_score"), "pos").limit(self.cfg.explain_anchors)
        wide = self.expanded(anchors, self.cfg.explain_context_words, [F.col("citation_key"), F.substring("text", 1, 500)], [F.desc("candidate_score"), "pos"])
        evidence = settle(rank.batches(wide, [F.desc("candidate_score"), "pos"], self.cfg.explain_batch, "E"))
        try:
            points = self._points(evidence, "explain", f"What do the passages say of {concept}?", self.cfg.explain_chars, 5, False)
        except provider.SchemaError:  # an answer that stays malformed is no evidence
            points = rank.merge_points(self.spark.createDataFrame([], NO_ROWS_POINT), [])
        points = settle(points)
        got = answers.synthesised(self.model, points, "explain-synthesis", f"Explain {concept}.", prompts.EXPLAIN_SECTIONS)
        return answers.finished(self.spark, points, evidence, got, ("overview",))

    def examples(self, concept: str, filters: knn.Filters | None = None) -> DataFrame:
        """Examples of a concept, the best of equal statements, at most examples_results."""
        queries = X.example_variants(concept)
        rows = find.union_first(self._results(queries, self.cfg.define_top_k, filters)).orderBy(F.desc("score"), "pos").limit(self.cfg.define_top_k)
        wide = self.expanded(settle(rows), self.cfg.define_context_words, [F.col("citation_key"), F.substring("text", 1, 500)], [F.desc("score"), "pos"])
        evidence = settle(rank.batches(wide, [F.desc("score"), "pos"], self.cfg.examples_batch, "E"))
        schema = "statement string, evidence_ids array<string>, confidence string, pos int"
        got = self._ask(evidence, "examples", provider.EXAMPLE, f"Which examples of {concept} do the passages give?", self.cfg.examples_chars) if self.model else []
        kept = [(a["statement"], a["evidence_ids"], a["confidence"], n) for n, a in enumerate(got) if a["concept_match"] == "requested_concept" and a["confidence"] != "low" and a["evidence_ids"] and set(a["evidence_ids"]) <= set(a["batch_ids"])]
        given = self.spark.createDataFrame(kept, schema)
        first = given.withColumn("evidence_id", F.get("evidence_ids", 0)).join(evidence.select("evidence_id", "citation_key", "page_start", "score", "zotero_link"), "evidence_id")
        weight = F.when(F.col("confidence") == "high", 3).otherwise(2)
        one = rank.keep_one(first.withColumn("_c", weight), [X.statement_key(F.col("statement"))], [F.desc("_c"), F.desc("score"), "pos"])
        return one.orderBy(F.desc("_c"), F.desc("score"), "pos").limit(self.cfg.examples_results).drop("_c")

    def summarise(self, citation_key: str, item_type: str | None = None) -> answers.Answer:
        """One paper's points, facet by facet, and the summary the model makes of them; `rejected` are passages that were left out."""
        asked = X.facet_queries(citation_key)
        vectors = self.embed([q for _, _, q in asked])
        parts = None
        for (facet, n, _), v in zip(asked, vectors):
            rows = find.search(self.store, v, knn.Filters(citation_key=citation_key), self.cfg.facet_top_k, self.cfg).withColumn("facet", F.lit(facet)).withColumn("query_no", F.lit(n))
            parts = rows if parts is None else parts.unionByName(rows)
        pool = settle(find.best_of_facets(parts, self.cfg.facet_top_k))
        out = excluded_for(F.col("text"), F.col("facet"))
        rejected = pool.filter(out).select("facet", F.substring("text", 1, 120).alias("text"))
        anchors = pool.filter(~out)
        needed = self.store.select("chunk_id", "attachment_key", "text").join(anchors.select("attachment_key").distinct(), "attachment_key", "left_semi")
        wide = context.expand(anchors, context.ordered_siblings(needed), self.cfg.context_before, self.cfg.context_after, self.cfg.define_context_words, True, self.cfg)
        rows = anchors.drop("text").join(wide.withColumnRenamed("anchor_id", "chunk_id"), "chunk_id").filter(~excluded_for(F.col("text"), F.col("facet")))
        rows = rank.keep_one(rows, [F.col("facet"), F.col("citation_key"), F.substring("text", 1, 200)], [F.desc("score"), "rank"])
        order = F.array_position(F.array(*[F.lit(f) for f in X.FACET_TERMS]), F.col("facet"))
        evidence = rank.batches(rows, [order, F.desc("score"), "rank"], 1, "E", 3)
        # Batches are of one facet each.
        within = F.floor((F.row_number().over(rank.W.partitionBy("facet").orderBy("evidence_id")) - 1) / self.cfg.summary_batch)
        evidence = settle(evidence.withColumn("batch", (order * 1000 + within).cast("int")))
        points = settle(self._points(evidence, "summarise", f"What does {citation_key} say?", self.cfg.summary_chars, None, True))
        kind = X.DOCUMENT_TYPES.get(item_type or "", "other")
        got = answers.synthesised(self.model, points, "summary-synthesis", f"Summarise {citation_key} ({kind}).", prompts.SUMMARY_SECTIONS)
        return answers.finished(self.spark, points, evidence, got, (), document_type=kind, rejected=rejected)

    def _points(self, evidence: DataFrame, task: str, question: str, chars: int, most: int | None, facets: bool) -> DataFrame:
        got = self._ask(evidence, task, provider.POINT, question, chars) if self.model and self.cfg.llm_enabled else []
        kept, seen = [], {}
        for n, a in enumerate(got):
            batch = tuple(a["batch_ids"])
            seen[batch] = seen.get(batch, 0) + 1
            ok = a["evidence_ids"] and set(a["evidence_ids"]) <= set(batch) and a["statement"].strip() and (most is None or seen[batch] <= most)
            if facets:
                ok = ok and a["facet"] == a["asked_facet"] and (a["facet"] not in ("limitation", "future_research") or a["explicitly_stated"])
            else:
                ok = ok and (a["source_excerpt"] or "").strip()
            if ok:
                kept.append((a["point_id"], a["statement"], a["facet"] or "", a["evidence_ids"], a["source_excerpt"] or "", n))
        points = self.spark.createDataFrame(kept, NO_ROWS_POINT)
        return rank.merge_points(points, ["facet"] if facets else [])


def _same(a: str, b: str) -> bool:
    import re
    import unicodedata

    def normal(t: str) -> str:
        t = re.sub(r"[‐-―\-]+", " ", unicodedata.normalize("NFKC", t).casefold())
        t = re.sub(r"\s+", " ", t).strip()
        for british, new in X.SPELLINGS:
            t = re.sub(rf"\b{british}\b", new, t)
        return t

    return normal(a) == normal(b)
