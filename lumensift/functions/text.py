"""Text functions as Column expressions (all stay in the JVM, but for NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.config import DEFAULT, EngineConfig

#: White space as the engine means it: Unicode's, and the four separators U+001C to U+001F.
WS = r"[\s\x1c-\x1f]"
#: A word's characters: letters and numbers of any script, but no combining marks.
WORD = r"[\p{L}\p{N}_]"

# Word lists, lookup tables and patterns that results depend on.
SPELLINGS = [
    ("organisation", "organization"), ("organisations", "organizations"), ("organisational", "organizational"), ("behaviour", "behavior"), ("behaviours", "behaviors"),
    ("labour", "labor"), ("centre", "center"), ("catalogue", "catalog"), ("programme", "program"),
]
SECTIONS = [
    ("abstract", "abstract"), ("introduction", "introduction"), ("literature review", "literature_review"), ("literature", "literature_review"), ("theory", "theory"),
    ("methods", "methods"), ("method", "methods"), ("methodology", "methods"), ("materials and methods", "methods"), ("research design", "methods"), ("results", "results"),
    ("discussion", "discussion"), ("limitations", "limitations"), ("conclusion", "conclusion"), ("concluding remarks", "conclusion"), ("references", "references"),
    ("reference", "references"), ("bibliography", "references"), ("literaturverzeichnis", "references"), ("literatur", "references"), ("références", "references"),
    ("methoden", "methods"), ("methodik", "methods"), ("forschungsdesign", "methods"),
]
DEFINITION_CUES = ["is the", "refers to", "defined as", "means", "understood as", "conceptualized as", "conceptualised as"]
EXAMPLE_PHRASES = ["for example", "such as", "including", "specifically", "managers", "leaders", "supervisors", "employees", "held one-to-one", "adjusted workload", "involved employees"]
EXAMPLE_VERBS = ["held", "adjusted", "involved", "encouraged", "checked", "regularly", "reported", "discussed", "supported", "managed"]
DEFINE_TEMPLATES = ["{}", "definition of {}", "how {} is defined", "what is meant by {}", "conceptualization of {}", "conceptualisation of {}", "understanding of {}"]
EXAMPLE_TEMPLATES = ["{}", "examples of {}", "specific {} behaviors", "practical manifestations of {}", "manager behaviours demonstrating {}", "concrete examples of {}", "{} practices", "observable {} actions"]
FACET_TERMS = {
    "topic": ["topic", "focus", "scope", "this paper examines", "this book focuses on", "themes", "concepts", "Thema", "Schwerpunkt"],
    "problem_or_purpose": ["purpose", "aim", "objective", "research question", "problem", "this study investigates", "this book aims", "Zweck", "Ziel", "Forschungsfrage"],
    "methodology_or_approach": ["method", "methodology", "research design", "sample", "data", "analysis", "clinical research", "observational", "interviews", "survey", "experiment", "conceptual approach", "Methode", "Stichprobe"],
    "finding_or_contribution": ["results", "findings", "we found", "conclude", "shows", "demonstrates", "contribution", "argument", "proposition", "implications", "Ergebnisse", "Befunde"],
    "limitation": ["limitation", "limitations", "caution", "cannot", "restricted", "boundary", "first approximation", "generalizability", "Einschränkung", "Grenzen"],
    "future_research": ["future research", "further research", "future studies", "needs investigation", "should examine", "remains to be explored", "weitere Forschung", "zukünftige Forschung"],
}
DOCUMENT_TYPES = {"journalArticle": "journal_article", "book": "book", "bookSection": "book_chapter", "conferencePaper": "conference_paper", "report": "report", "thesis": "thesis"}
LIST_MARKER = r"(?:[•*+-]|\d+[.)]|[a-z][.)]|\([ivx]+\))"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{WS}+|{WS}+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def collapse(text: Column) -> Column:
    return F.array_join(words(text), " ")


def fold(text: Column) -> Column:
    """Case-folded: lower case, with the sharp s and the final sigma folded too."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form; the one text function without an equal in the JVM."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) and not t.isascii() else t)


def normalise_text(text: Column) -> Column:
    """Page text as it is kept: line ends, blank runs and line-end hyphens evened out, in this order."""
    steps = [(r"\r\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"\n +", "\n"), (r"(?<=[A-Za-z])\n(?=[A-Za-z])", " "), (r"(?<=[A-Za-z])-(?=\n)", ""), (r"\n{2,}", "\n\n")]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return trim(text)


def section_type(title: Column) -> Column:
    flat = F.regexp_replace(F.lower(trim(title)), rf"(?U){WS}+", " ")
    found = F.lit("other")
    for part, kind in reversed(SECTIONS):
        found = F.when(flat.contains(part), kind).otherwise(found)
    return F.coalesce(found, F.lit("other"))


def section_title(title: Column) -> Column:
    return F.when(title != "", trim(title))


def simple_sentences(text: Column) -> Column:
    """Split after . ! ? and white space before a capital, bracket or quote; blanks dropped."""
    return F.filter(F.transform(F.split(text, rf"(?U)(?<=[.!?]){WS}+(?=[A-Z(\[\"'])"), trim), lambda s: s != "")


def paragraph_array(text: Column) -> Column:
    """(ordering, text) structs of the blank-line paragraphs; the numbering keeps the gaps of blank ones."""
    parts = F.transform(F.split(text, rf"(?U)\n{WS}*\n"), lambda p, i: F.struct(i.alias("ordering"), trim(p).alias("text")))
    return F.filter(parts, lambda p: p["text"] != "")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def chunk_id(attachment: Column, index: Column, text: Column) -> Column:
    return F.concat_ws(":", attachment, index.cast("string"), content_hash(text))


def chunk_index(ident: Column) -> Column:
    """The number in the second field of a chunk id, 0 where there is none."""
    return F.coalesce(F.get(F.split(ident, ":", 3), 1).try_cast("int"), F.lit(0))


def american(text: Column) -> Column:
    out = fold(text)
    for british, new in SPELLINGS:
        out = F.regexp_replace(out, rf"(?U)\b{british}\b", new)
    return out


def normal_phrase(text: Column) -> Column:
    return american(collapse(F.regexp_replace(fold(text), r"[‐-―\-]+", " ")))


def definition_key(text: Column) -> Column:
    """What makes two definitions the same: the normalised whole text, null where nothing of it is left."""
    return F.nullif(normal_phrase(nfkc(text)), F.lit(""))


def same_concept(a: Column, b: Column) -> Column:
    return normal_phrase(a) == normal_phrase(b)


def lexical_level(concept: Column, text: Column) -> Column:
    raw, phrase, body = trim(fold(concept)), normal_phrase(concept), normal_phrase(text)
    terms = F.filter(F.split(phrase, " "), lambda t: F.length(t) > 2)
    quoted = lambda t: F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E\b"))
    return (
        F.when((raw != "") & F.contains(fold(text), raw), "exact_phrase")
        .when((phrase != "") & F.contains(body, phrase), "normalized_phrase")
        .when(F.exists(terms, lambda t: F.regexp_like(body, quoted(t))), "partial_term_match")
        .otherwise("no_match")
    )


def reference_like(text: Column) -> Column:
    count = lambda c, p: F.regexp_count(c, F.lit("(?U)" + p))
    start, end = rf"(?<!{WORD})", rf"(?!{WORD})"
    return (count(fold(text), rf"{start}doi{WS}*:{WS}*|https?://doi\.org/") >= 2) | (
        (count(text, rf"{start}[A-Z][a-z]+(?:{WS}+et{WS}+al\.)?[, ]+\(?20\d{{2}}\)?") >= 3) & (count(text, rf"{start}(?:19|20)\d{{2}}{end}") >= 4)
    )


def candidate_score(score: Column, level: Column, section: Column, text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    bonus = F.when(level == "exact_phrase", cfg.exact_bonus).when(level == "normalized_phrase", cfg.normalised_bonus).when(level == "partial_term_match", cfg.partial_bonus).otherwise(0.0)
    place = (
        F.when((section == "references") | reference_like(text), -cfg.reference_penalty)
        .when(section.isin("abstract", "introduction", "literature_review", "theory"), cfg.section_bonus)
        .otherwise(0.0)
    )
    return score + bonus + place


def first_sentence_with(text: Column, cues: list[str]) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\. "), trim), lambda s: s != "")
    return F.get(F.filter(parts, lambda s: F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(F.lower(s), c))), 0)


def definition_text(text: Column) -> Column:
    flat = trim(text)
    return F.coalesce(first_sentence_with(flat, DEFINITION_CUES), F.get(F.split(flat, r"\. "), 0))


def example_text(text: Column) -> Column:
    flat = trim(text)
    whole = F.exists(F.array(*[F.lit(c) for c in EXAMPLE_PHRASES]), lambda c: F.contains(F.lower(flat), c))
    return F.when(whole, flat).otherwise(F.coalesce(first_sentence_with(flat, EXAMPLE_VERBS), F.get(F.split(flat, r"\. "), 0)))


def excerpt(text: Column, most: int = 240) -> Column:
    flat = collapse(text)
    first = F.get(F.split(flat, r"(?<=[.!?]) ", 2), 0)
    chosen = F.when(F.length(first) >= 40, first).otherwise(flat)
    cut = F.regexp_replace(F.substring(chosen, 1, most - 3), r" [^ ]*\z", "")
    return F.when(F.length(chosen) > most, F.concat(cut, F.lit("..."))).otherwise(chosen)


def evidence_excerpt(text: Column, most: int = 4000) -> Column:
    head = most // 2
    cut = F.concat(F.substring(text, 1, head), F.lit("\n[...middle omitted...]\n"), F.substring(text, -(most - head), most - head))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def without_bracket(text: Column) -> Column:
    """Without a model's trailing "[P01, P02]"."""
    return trim(F.regexp_replace(trim(text), r"(?U)\s*\[P\d+(?:,\s*P\d+)*\]\.?\s*\z", ""))


def without_fences(text: Column) -> Column:
    flat = trim(text)
    json_ = flat.startswith("```json") & flat.endswith("```")
    plain = flat.startswith("```") & flat.endswith("```")
    inner = lambda n: trim(F.substring(flat, n + 1, F.greatest(F.length(flat) - n - 3, F.lit(0))))
    return F.when(json_, inner(7)).when(plain, inner(3)).otherwise(flat)


def statement_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def full_name(first: Column, last: Column) -> Column:
    name = F.trim(F.concat_ws(" ", F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit(""))))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Unknown"))


def document_type(item_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair])[item_type], F.lit("other"))


def query_variants(concept: str) -> list[str]:
    """The define queries of a concept and of its American spelling, each once."""
    base = concept.strip()
    if not base:
        return []
    other = base.casefold()
    import re

    for british, new in SPELLINGS:
        other = re.sub(rf"\b{british}\b", new, other)
    concepts = [base] if other == base.casefold() else [base, other]
    return list(dict.fromkeys(t.format(c) for c in concepts for t in DEFINE_TEMPLATES))


def example_variants(concept: str) -> list[str]:
    base = concept.strip()
    return [t.format(base) for t in EXAMPLE_TEMPLATES] if base else []


def facet_queries(citation_key: str) -> list[tuple[str, int, str]]:
    """(facet, number, query)"""
    return [(facet, n, f"{citation_key} {term}") for facet, terms in FACET_TERMS.items() for n, term in enumerate(terms)]
