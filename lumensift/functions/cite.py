"""Citations, page labels and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_ranges(pages: Column) -> Column:
    """Distinct pages in order as "3-5, 10"; '' for none. Runs are the islands of page minus place."""
    ordered = F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    starts = F.filter(ordered, lambda p: ~F.array_contains(ordered, p - 1))
    ends = F.filter(ordered, lambda p: ~F.array_contains(ordered, p + 1))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))), ", ")


def cited(key: Column, pages: Column) -> Column:
    """"key (pp. 3-5, 10)"; "p." for one page, the key alone for none."""
    n = F.size(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, key).otherwise(F.concat(key, F.lit(" ("), F.when(n == 1, "p. ").otherwise("pp. "), page_ranges(pages), F.lit(")")))


def deep_link(attachment: Column, page: Column | None = None) -> Column:
    """Link to an attachment; the page only if it is above 0. '' without an attachment."""
    tail = F.when(page > 0, F.concat(F.lit("?page="), page.cast("string"))).otherwise("") if page is not None else F.lit("")
    return F.when(F.coalesce(attachment, F.lit("")) == "", "").otherwise(F.concat(F.lit("zotero://open-pdf/library/items/"), attachment, tail))


def hit_link(attachment: Column, page: Column) -> Column:
    """The form of retrieval results, which always names a page."""
    return F.concat(F.lit("zotero://open-pdf/library/items/"), attachment, F.lit("?page="), F.coalesce(page, F.lit(1)).cast("string"))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), None).when(end.isNull() | (end == start), F.concat(F.lit("PDF p. "), start.cast("string"))).otherwise(F.concat(F.lit("PDF pp. "), start.cast("string"), F.lit("–"), end.cast("string")))


def ordinal(prefix: str, n: Column, width: int = 2) -> Column:
    """P01, E001 and the like."""
    return F.format_string(f"{prefix}%0{width}d", n)


def provenance(ids: Column, keys: Column) -> Column:
    """"[P01, P05 | key; key]" with words for what is missing."""
    named = lambda c, sep, none: F.coalesce(F.nullif(F.array_join(c, sep), F.lit("")), F.lit(none))
    return F.concat(F.lit("["), named(ids, ", ", "evidence unavailable"), F.lit(" | "), named(keys, "; ", "citation key unavailable"), F.lit("]"))
