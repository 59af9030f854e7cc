"""Collection trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumensift.io import settle


def descendants(collections: DataFrame, names: list[str]) -> DataFrame:
    """(key): the collections of these names (in any case) and all below them; cycles end by themselves.

    collections: key, name, parent. Each round joins the frontier only, and its lineage is cut.
    """
    wanted = [n.casefold() for n in names]
    edges = collections.select("key", "parent").filter("key is not null").distinct()
    found = settle(collections.filter(F.lower("name").isin(wanted)).select("key").distinct())
    frontier = found
    while not frontier.isEmpty():
        below = edges.join(frontier.withColumnRenamed("key", "parent"), "parent", "left_semi").select("key").distinct()
        frontier = settle(below.join(found, "key", "left_anti"))
        found = settle(found.unionByName(frontier))
    return found


def in_collections(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items of any of the collections; each once (the last by key order of its attachment)."""
    hit = items.select("item_key", F.explode("collections").alias("key")).join(keys, "key", "left_semi").select("item_key").distinct()
    return items.join(hit, "item_key", "left_semi")
