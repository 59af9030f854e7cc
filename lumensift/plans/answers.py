"""The last step of explain and summarise: statements over merged points, their ids checked, and the pages behind them.

The model's answer is a bounded list of statements, which becomes a small DataFrame; checks and pages are joins with
the points and the evidence they rest on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumensift.functions import cite
from lumensift.functions import text as X
from lumensift.operators import rank
from lumensift.plans import prompts, provider

STATEMENTS = "ref_no int, section string, statement string, point_ids array<string>"
PAGES = "ref_no int, citation_key string, pages array<int>, label string"


@dataclass
class Answer:
    """points and evidence as they were merged; statements (STATEMENTS) with known ids only; pages (PAGES) of each
    statement's citations; sources (citation_key, pages) over all of them; rejected passages of a summary."""

    points: DataFrame
    evidence: DataFrame
    statements: DataFrame
    pages: DataFrame
    sources: DataFrame
    insufficient: bool
    document_type: str | None = None
    rejected: DataFrame | None = None

    def rendered(self) -> DataFrame:
        """(ref_no, section, line): each statement with "[P01, P02 | key (p. 3)]" behind it."""
        keys = self.pages.groupBy("ref_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]).alias("labels"))
        return self.statements.join(keys, "ref_no", "left").select("ref_no", "section", F.concat_ws(" ", "statement", cite.provenance(F.col("point_ids"), F.coalesce("labels", F.array().cast("array<string>")))).alias("line"))


def cited_pages(evidence: DataFrame) -> DataFrame:
    """(evidence_id, citation_key, page): first and last page of each passage, null where a passage has none."""
    pages = F.array_distinct(F.array("page_start", "page_end"))
    return evidence.filter("coalesce(citation_key, '') <> ''").select("evidence_id", "citation_key", F.explode(pages).alias("page"))


def finished(spark: SparkSession, points: DataFrame, evidence: DataFrame, got: list[dict], open_sections: tuple[str, ...], **more) -> Answer:
    """The answer from the model's statements `got` (section, statement, evidence_ids: ids of points).

    Statements without ids or with an unknown one are left out; those of `open_sections` stay, with the ids that are known.
    Brackets of ids at a statement's end are taken off, as the ids are given beside it.
    """
    rows = spark.createDataFrame([(n, a["section"], a["statement"], a["evidence_ids"]) for n, a in enumerate(got)], STATEMENTS)
    known = points.agg(F.collect_list("point_id").alias("known"))
    said = rows.crossJoin(F.broadcast(known)).filter(rank.known_ids(F.col("point_ids"), F.col("known")) | F.col("section").isin(*open_sections))
    said = said.select("ref_no", "section", X.without_bracket(F.col("statement")).alias("statement"), F.array_intersect("point_ids", "known").alias("point_ids"))
    passages = cited_pages(evidence)
    pages = rank.citation_pages(points, passages, said).withColumn("label", cite.cited(F.col("citation_key"), F.col("pages")))
    return Answer(points, evidence, said, pages, rank.sources(points, passages, said), points.isEmpty() or not got, **more)


def synthesised(model: provider.Provider | None, points: DataFrame, task: str, question: str, sections: tuple[str, ...]) -> list[dict]:
    """The model's statements over the points; none without a model or without points, which are not asked about.

    An answer that stays malformed gives none; a provider that fails is an error.
    """
    rows = points.orderBy("point_id").collect() if model is not None else []
    if not rows:
        return []
    facet = "facet" in points.columns
    body = "\n".join(f"[{r.point_id}]{f' ({r.facet})' if facet else ''} {r.statement}" for r in rows)
    schema = {"section": provider.Field(str, sections), "statement": provider.Field(str), "evidence_ids": provider.Field(list)}
    try:
        return provider.structured(model, prompts.messages(task, question, body), schema, task)
    except provider.SchemaError:
        return []
