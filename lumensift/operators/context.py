"""Neighbouring chunks of an anchor, stitched within a word budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumensift.config import DEFAULT, EngineConfig
from lumensift.functions import text as X


def continues(previous: Column, current: Column) -> Column:
    """Whether a list or a sentence goes on from one chunk into the next."""
    left, right = F.regexp_replace(previous, rf"(?U){X.WS}+\z", ""), F.regexp_replace(current, rf"(?U)\A{X.WS}+", "")
    return left.endswith(":") | right.rlike(rf"(?iU)\A{X.LIST_MARKER}") | ~left.rlike(r"[.!?][\"')\]]?\z")


def overlap(left: Column, right: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Words (arrays) that end the left and begin the right: the longest such run of stitch_least to stitch_most, or 0."""
    most = F.least(F.lit(cfg.stitch_most), F.size(left), F.size(right))
    sizes = F.when(most >= cfg.stitch_least, F.sequence(most, F.lit(cfg.stitch_least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    # The first words are compared first; only where they agree are the runs.
    same = lambda n: (F.get(left, F.size(left) - n) == F.get(right, 0)) & (F.slice(left, -n, n) == F.slice(right, F.lit(1), n))
    return F.coalesce(F.get(F.filter(sizes, same), 0), F.lit(0))


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once (a lambda's argument), however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _joined(text: Column, rest: Column) -> Column:
    """A text and the words that follow it; a list item begins a line."""
    return F.when(F.size(rest) == 0, text).otherwise(
        _let(F.array_join(rest, " "), lambda r: X.trim(F.concat(text, F.when(r.rlike(rf"(?i)\A{X.LIST_MARKER}"), "\n").otherwise(" "), r)))
    )


def stitch(left: Column, right: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Two texts joined without the words they share."""
    return _let(F.struct(X.words(left).alias("a"), X.words(right).alias("b")), lambda w: _joined(X.trim(left), F.slice(w["b"], overlap(w["a"], w["b"], cfg) + 1, F.size(w["b"]))))


def ordered_siblings(chunks: DataFrame) -> DataFrame:
    """One chunk of each index of an attachment (the last by id), with its place in a run of chunks that continue each other."""
    rows = chunks.withColumn("idx", X.chunk_index(F.col("chunk_id")))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("attachment_key", "idx").orderBy(F.desc("chunk_id")))).filter("_n = 1").drop("_n")
    w = W.partitionBy("attachment_key").orderBy("idx")
    linked = (F.lag("idx").over(w) == F.col("idx") - 1) & continues(F.lag("text").over(w), F.col("text"))
    return rows.withColumn("run", F.sum(F.when(linked, 0).otherwise(1)).over(w))


def neighbours(anchors: DataFrame, siblings: DataFrame, before: int, after: int) -> DataFrame:
    """(anchor_id, anchor_idx, idx, chunk_id, text, run): chunks of the same attachment within the band of indices.

    An anchor asks for the places of its band, so attachment and place are the join's keys and nothing else of the attachment is met.
    """
    a = anchors.select(F.col("chunk_id").alias("anchor_id"), "attachment_key", X.chunk_index(F.col("chunk_id")).alias("anchor_idx"))
    return siblings.join(_band(a, before, after), ["attachment_key", "idx"])


def _band(anchors: DataFrame, before: int, after: int) -> DataFrame:
    return anchors.withColumn("idx", F.explode(F.sequence(F.col("anchor_idx") - before, F.col("anchor_idx") + after)))


def expand(anchors: DataFrame, siblings: DataFrame, before: int = 1, after: int = 1, max_words: int = 2500, structures: bool = True, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(anchor_id, text, context_chunk_ids, context_start, context_end, n_continued) of every anchor.

    The band around the anchor is taken, then, as long as each next chunk continues the last, the run beyond either
    end. Pieces are stitched in order; one that would exceed max_words is passed over (the anchor never is), and
    later ones are still tried, so the fold runs in order over each anchor's few neighbours.
    `siblings` comes from ordered_siblings() of all chunks of the anchors' attachments.
    """
    a = anchors.select(F.col("chunk_id").alias("anchor_id"), "attachment_key", X.chunk_index(F.col("chunk_id")).alias("anchor_idx")).dropDuplicates(["anchor_id"])
    names = ["anchor_id", "anchor_idx", "idx", "chunk_id", "text"]
    band = siblings.join(_band(a, before, after), ["attachment_key", "idx"])
    near = band.select(*names, F.lit(True).alias("in_band"))
    if structures:
        # Beyond the band only the runs at its ends are met.
        ends = band.groupBy("attachment_key", "anchor_id", "anchor_idx").agg(F.min_by("run", "idx").alias("low_run"), F.max_by("run", "idx").alias("high_run"), F.min("idx").alias("low"), F.max("idx").alias("high"))
        asked = ends.withColumn("run", F.explode(F.array_distinct(F.array("low_run", "high_run"))))
        onward = ((F.col("idx") < F.col("low")) & (F.col("run") == F.col("low_run"))) | ((F.col("idx") > F.col("high")) & (F.col("run") == F.col("high_run")))
        near = near.unionByName(siblings.join(asked, ["attachment_key", "run"]).filter(onward).select(*names, F.lit(False).alias("in_band")))
    near = near.withColumn("t", X.trim(F.col("text"))).withColumn("w", X.words(F.col("text")))
    pieces = near.groupBy("anchor_id", "anchor_idx").agg(F.sort_array(F.collect_list(F.struct("idx", "chunk_id", "t", "w"))).alias("p"), F.count_if(~F.col("in_band")).alias("n_continued"))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("w"), F.array().cast("array<string>").alias("ids"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, p: Column) -> Column:
        rest = F.slice(p["w"], overlap(acc["w"], p["w"], cfg) + 1, F.greatest(F.size(p["w"]), F.lit(1)))

        def put(rest: Column) -> Column:
            text = F.when(acc["text"] == "", p["t"]).otherwise(_joined(acc["text"], rest))
            fits = (F.size(acc["w"]) + F.size(rest) <= max_words) | (p["idx"] == F.col("anchor_idx"))
            grown = F.struct(text.alias("text"), F.concat(acc["w"], rest).alias("w"), F.concat(acc["ids"], F.array(p["chunk_id"])).alias("ids"), F.concat(acc["at"], F.array(p["idx"])).alias("at"))
            return F.when(fits, grown).otherwise(acc)

        return _let(rest, put)

    folded = pieces.withColumn("f", F.aggregate("p", start, step))
    return folded.select("anchor_id", F.col("f.text").alias("text"), F.col("f.ids").alias("context_chunk_ids"), F.array_min("f.at").alias("context_start"), F.array_max("f.at").alias("context_end"), "n_continued")
