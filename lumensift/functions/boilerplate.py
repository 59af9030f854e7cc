"""Front and back matter, recognised by patterns; the first class that fits is the text's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the classes.
DISCLAIMER = [
    r"is sold with the understanding", r"may not be suitable for your (situation|particular circumstances)",
    r"(publisher|author)s? (is|are) not (engaged|responsible) in (rendering|providing)", r"if (legal|expert|professional) assistance is required",
    r"consult a competent professional", r"neither the publisher nor the author",
]
COPYRIGHT = [
    r"all rights reserved", r"library of congress", r"\bisbn\b", r"©\s*\d{4}", r"no part of this (book|publication)", r"printed in the united states",
    r"cataloging-in-publication data", r"national library of \w+ cataloguing",
]
BIOGRAPHY = [
    r"about the author", r"\b(he|she|they) (received|holds|earned) (his|her|their) (ph\.?d|doctorate|m\.?a\.?|degree)",
    r"\bis (a|an) (professor|senior lecturer|research fellow|consultant) (of|at|in)", r"\bhas (written|published|authored) (numerous|several|many) (books|articles|papers)",
    r"lives in .{0,40} with (his|her|their)",
]
MARKETING = [r"praise for", r"acclaim for", r"one of the (most|best)[- ]?(selling|influential)", r"\bbestseller\b", r"\bnational bestseller\b", r"advance praise"]
TOC = r"\b(chapter|part)\s+(\d+|[ivxlc]+)\b"
BLURB = r"[—-]\s*[A-Z][a-zA-Z.]+ [A-Z][a-zA-Z.]+,"
REFERENCE = r"[A-Z][a-zA-Z'-]+,\s?[A-Z]\.\s?(&|and)?\s?"
INDEX_LINE = r"^\s*\S[\w\s'-]*,\s*\d+(,\s*\d+)*\s*$"
FRONT_MATTER_FACETS = ["topic", "problem_or_purpose"]


def boilerplate(text: Column) -> Column:
    """disclaimer, copyright, biography, marketing, toc, index or references; null for substance and for blanks."""
    any_of = lambda patterns: text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))
    count = lambda flags, p: F.regexp_count(text, F.lit(flags + p))
    return (
        F.when(~text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(None).cast("string"))
        .when(any_of(DISCLAIMER), "disclaimer")
        .when(any_of(COPYRIGHT), "copyright")
        .when(any_of(BIOGRAPHY), "biography")
        .when(any_of(MARKETING) | (count("(?U)", BLURB) >= 2), "marketing")
        .when(count("(?iU)", TOC) >= 3, "toc")
        .when(count("(?mdU)", INDEX_LINE) >= 4, "index")
        .when(count("(?U)", REFERENCE) >= 4, "references")
    )


def excluded_for(text: Column, facet: Column) -> Column:
    """Whether a passage is no evidence for a facet: boilerplate, but for tables of contents where they tell of topic or purpose."""
    kind = boilerplate(text)
    return F.coalesce(kind.isNotNull() & ~((kind == "toc") & facet.isin(FRONT_MATTER_FACETS)), F.lit(False))
