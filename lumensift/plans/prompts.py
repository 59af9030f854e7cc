"""What a model is told for each task."""

from __future__ import annotations

EXPLAIN_SECTIONS = ("overview", "aspect", "perspective")
SUMMARY_SECTIONS = ("overview", "topics", "problem_or_purpose", "methodology_or_approach", "findings_or_contributions", "limitations", "future_research")

_IDS = "Name evidence by the ids in brackets and by no other name. Answer with a JSON list and nothing else."
TASKS = {
    "classify": "Judge for each passage whether it defines the concept asked for: explicit_definition, implicit_definition, conceptual_discussion or no_definition. concept_match is requested_concept only for that very concept, not for a wider, narrower or neighbouring one.",
    "define": "Find the definitions of the concept in the passages: explicit_definition, operational_definition or conceptualization. Quote the defining words as extracted_definition. concept_match is requested_concept only for that very concept.",
    "explain": "Collect what the passages say of the concept as separate points, at most five, each with the words it rests on as source_excerpt.",
    "explain-synthesis": "Write from the points alone: one overview, the aspects of the concept, and perspectives where sources differ. Every statement names the points it rests on.",
    "examples": "Collect concrete examples of the concept from the passages. concept_match is requested_concept only for examples of that very concept; confidence is low where a passage only hints at it.",
    "summarise": "Collect what the passages say under the facet asked for, as separate points. explicitly_stated is true only where the authors say it themselves.",
    "summary-synthesis": "Write from the points alone, section by section, leaving out sections without points. Every statement names the points it rests on.",
}
FACETS = {
    "topic": "What the document is about.", "problem_or_purpose": "The problem it takes up, or its aim.", "methodology_or_approach": "How it proceeds: design, sample, data, or line of argument.",
    "finding_or_contribution": "What it finds or adds, not what it sets out to do.", "limitation": "Limits the authors state themselves.", "future_research": "Further work the authors call for themselves.",
}


def messages(task: str, question: str, body: str, facet: str | None = None) -> list[dict[str, str]]:
    rule = f" Facet: {facet}. {FACETS[facet]}" if facet else ""
    return [{"role": "system", "content": f"{TASKS[task]}{rule} {_IDS}"}, {"role": "user", "content": f"{question}\n\n{body}"}]


#: A second try of `classify` that accepted nothing.
CORRECTION = "No passage was accepted. Use exactly the ids in brackets as evidence_id, and name the requested concept as it was asked."
