"""Problem 1: the k most similar vectors of every vector, by a hash-prefix forest.

Each of TREES trees gives a vector a long hash string of signs of random hyperplanes, and keeps the
strings in sorted order. The trees stand in GROUPS groups. The trees of a group share the leading LEAD
signs of their strings and differ in the BITS signs after them, so that one range partitioning by the
leading signs (and the id, so that no run of equal signs is ever too long) brings a stretch of all the
group's trees into one task, a run of about RUN vectors. Vectors so move once a group, not once a tree.

In a run each vector descends to its longest-prefix match in every tree: the prefixes that neighbours in
sorted order have in common give the size of its bucket at every depth. From there all trees of the
group ascend in step, each to the same, ever shorter prefix length, until the buckets hold CANDIDATES
places together (LSH forest, Bawa et al. 2005). That common depth differs from vector to vector: a
tight group is told apart by many signs, a lonely vector by few. What a vector is compared with is
bounded at any tightness: where one step up would open a bucket of any size, the nearest places of it
are taken, SIDE on either side. Signs after the leading ones are of planes through the run's own
centre, which part a run that is one tight group as evenly as any other. The candidates are compared
exactly; each run hands on its k best of each vector, and the best of all groups stay.

The forest finds vectors that are alike: below the cosine FOREST_FROM common prefixes tell little,
and a walk that still found nine in ten would look at more places than there are vectors. Where
less is asked for, every vector is compared with every other instead, in tiles of two blocks.
That is exact, and its work grows with the square of the collection.

Equal vectors form one class, which stands in the forest once; its members get their
neighbours from the class, in SALTS shares, as a class may hold any part of the rows. Vectors that are
null, zero, of another length or hold NaN or infinite values take no part; rows repeated under one id
count once; no vector is its own neighbour; ties go to the lesser id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumensift.io import written

#: Trees and their groups; signs of a hash string that a group's trees share, and own signs of each tree.
TREES, GROUPS, LEAD, BITS = 40, 5, 64, 32
#: Places (of all trees of a group together) that a vector ascends for, and nearest places on either side that it takes of a larger bucket.
CANDIDATES, SIDE = 3072, 1536
#: Vectors of a run, and vectors whose candidates are compared at once.
RUN, BLOCK = 40_000, 512
#: Shares of a class of equal vectors.
SALTS = 16
#: Cosine from which on the forest is asked, and vectors of a block where all are compared; tasks at most for the tiles.
FOREST_FROM, TILE, TASKS = 0.85, 10_000, 10_000
_PLACED = pa.schema([("tree_group", pa.int32()), ("h", pa.int64()), ("id", pa.int64()), ("v", pa.binary())])


def planes(dim: int, group: int, signs: int) -> np.ndarray:
    """(dim, signs): the hyperplanes of a group, the leading ones first."""
    return np.random.default_rng(1000 + group).standard_normal((signs, dim)).astype(np.float32).T


def valid(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(rows: DataFrame, dim: int) -> DataFrame:
    """(tree_group, h, id, v): every vector once for each group of trees, with the leading signs as an ordered number and its values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [planes(dim, group, LEAD) for group in range(GROUPS)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            low = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            ends = np.arange(0, low.nbytes + 1, 4 * dim, dtype=np.int32)
            values = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(low.tobytes())])
            unit = matrix(batch.column(1), dim).astype(np.float32)
            for group, own in enumerate(every):
                # The sign bit turned keeps the order of the strings in that of signed numbers.
                h = (np.packbits(unit @ own > 0, axis=1).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group, np.int32)), pa.array(h), batch.column(0), values], schema=_PLACED)

    return rows.mapInArrow(run, "tree_group int, h long, id long, v binary")


def common_prefixes(sorted_strings: np.ndarray) -> np.ndarray:
    """Signs that each string shares with the next in sorted order."""
    differ = (sorted_strings[1:] ^ sorted_strings[:-1]).astype(np.float64)
    return np.where(differ > 0, BITS - 1 - np.floor(np.log2(np.maximum(differ, 1))), BITS).astype(np.int64)


def trees(low: np.ndarray, group: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in sorted order, common prefixes of neighbours) of each tree of the group, for one run."""
    each = TREES // GROUPS
    own = planes(low.shape[1], group, LEAD + each * BITS)[:, LEAD:]
    signs = (low @ own > low.mean(axis=0) @ own).reshape(len(low), each, BITS)
    out = []
    for j in range(each):
        strings = np.packbits(signs[:, j], axis=1).view(">u4").ravel().astype(np.uint32)
        order = np.argsort(strings, kind="stable")
        out.append((order, common_prefixes(strings[order])))
    return out


def buckets(shared: np.ndarray, depth: int) -> np.ndarray:
    """Where the buckets of one prefix length begin, and the end of the last."""
    return np.concatenate([[0], np.flatnonzero(shared < depth) + 1, [len(shared) + 1]])


def depths(forest: list[tuple[np.ndarray, np.ndarray]], n: int, enough: int) -> np.ndarray:
    """The prefix length to which each vector ascends in all trees: the longest at which its buckets hold `enough` places together."""
    out, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for depth in range(BITS, 0, -1):
        held = np.zeros(n, np.int64)
        for order, shared in forest:
            sizes = np.diff(buckets(shared, depth))
            held[order] += np.repeat(sizes, sizes)
        reached = open_ & (held >= enough)
        out[reached] = depth
        open_ &= ~reached
        if not open_.any():
            break
    return out


def matches(unit: np.ndarray, ids: np.ndarray, group: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, neighbours, cosines) of a run: the k best of each vector's candidates in the group's trees (ties: lesser id)."""
    low, n = unit.astype(np.float32), len(ids)
    forest = trees(low, group)
    depth = depths(forest, n, CANDIDATES)
    met = [np.empty(0, np.int64)]
    for order, shared in forest:
        values, own = low[order], depth[order]
        for d in np.unique(own):
            begins = buckets(shared, int(d))
            at = np.flatnonzero(own == d)
            bucket = np.searchsorted(begins, at, "right") - 1
            for places in np.split(at, np.flatnonzero(np.diff(bucket)) + 1):
                b = int(np.searchsorted(begins, places[0], "right"))
                for i in range(0, len(places), BLOCK):
                    q = places[i : i + BLOCK]
                    left, right = max(int(begins[b - 1]), int(q[0]) - SIDE), min(int(begins[b]), int(q[-1]) + SIDE + 1)
                    cos = values[q] @ values[left:right].T
                    cos[np.arange(len(q)), q - left] = -2
                    # Single precision only chooses; the small slack keeps what double precision might rank higher.
                    floor = np.float32(least - 1e-6)
                    x, y = np.nonzero(cos >= floor)
                    few = min(k, right - left - 1)
                    if few > 0 and len(x) > 4 * k * len(q):
                        edge = np.partition(cos, -few, axis=1)[:, -few]
                        x, y = np.nonzero(cos >= np.maximum(edge - np.float32(1e-6), floor)[:, None])
                    met.append(order[q[x]] * n + order[left + y])
    pair = np.unique(np.concatenate(met))
    a, b = pair // n, pair % n
    cosine = np.empty(len(pair))
    for i in range(0, len(pair), 500_000):
        cosine[i : i + 500_000] = np.einsum("ij,ij->i", unit[a[i : i + 500_000]], unit[b[i : i + 500_000]])
    keep = (cosine >= least) & (a != b)
    a, b, cosine = a[keep], b[keep], cosine[keep]
    order = np.lexsort((ids[b], -cosine, a))
    a, b, cosine = a[order], b[order], cosine[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
    return ids[a[rank < k]], ids[b[rank < k]], cosine[rank < k]


def _found(hashed: DataFrame, n: int, k: int, dim: int, least: float) -> DataFrame:
    """(a, b, cosine) of each run's best, runs being partitions in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=_PLACED).combine_chunks()
        if not table.num_rows:
            return
        group = table["tree_group"].to_numpy()
        for own in np.unique(group):  # a partition may hold the end of one group and the beginning of the next
            part = table.filter(pa.array(group == own)).combine_chunks()
            # Equal vectors stand here once, and the order within a run is that of the leading signs and ids.
            x = np.frombuffer(b"".join(part["v"].to_pylist()), np.float32).astype(np.float64).reshape(-1, dim)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            a, b, cosine = matches(unit, part["id"].to_numpy(), int(own), k, least)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cosine)], names=["a", "b", "cosine"])

    runs = max(1, -(-n * GROUPS // RUN))
    placed = hashed.repartitionByRange(runs, "tree_group", "h", "id").sortWithinPartitions("tree_group", "h", "id")
    return placed.mapInArrow(run, "a long, b long, cosine double")


def across(unit: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, neighbours, cosines): the k best others (all that tie with the last) of each vector, itself left out."""
    low, low_others = unit.astype(np.float32), np.ascontiguousarray(others.astype(np.float32).T)
    few = min(k + 1, len(other_ids))  # one more, as a vector may stand among the others
    if few < 1:
        return
    for begin in range(0, len(ids), BLOCK):
        cos = low[begin : begin + BLOCK] @ low_others
        edge = np.partition(cos, -few, axis=1)[:, -few]
        # Single precision only chooses; the slack is above its error.
        q, c = np.nonzero(cos >= np.maximum(edge, least)[:, None] - 1e-5)
        exact = np.einsum("ij,ij->i", unit[begin + q], others[c])
        keep = (exact >= least) & (ids[begin + q] != other_ids[c])
        yield ids[begin + q[keep]], other_ids[c[keep]], exact[keep]


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, from batches sorted by tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if held and held[-1].column(0)[0].as_py() != at[begin]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _compared(classes: DataFrame, n: int, k: int, dim: int, least: float) -> DataFrame:
    """(a, b, cosine) of each tile's best: every vector against every other, a tile being the pair of two blocks."""
    blocks = max(1, -(-n // TILE))
    count = blocks * (blocks + 1) // 2
    parts = min(count, TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles(batches):
            own = table["own"].to_numpy()
            unit, ids = matrix(table["v"].chunk(0), dim), table["id"].to_numpy()
            cut = int(np.searchsorted(own, own[0], "right"))
            sides = [(unit[:cut], ids[:cut]), (unit[cut:], ids[cut:])]
            # A tile of one block has no second side; one of two is looked at from both.
            pairs = [(sides[0], sides[1]), (sides[1], sides[0])] if cut < len(own) else [(sides[0], sides[0])] if table["one"][0].as_py() else []
            for x, y in pairs:
                for a, b, c in across(*x, *y, k, least):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["a", "b", "cosine"])

    rows = classes.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tile = F.floor(high * (high + 1) / 2).cast("long") + low
    rows = rows.select(tile.alias("tile"), "own", (low == high).alias("one"), "id", "v")
    placed = rows.repartitionById(parts, (F.col("tile") % parts).cast("int")).sortWithinPartitions("tile", "own")
    return placed.mapInArrow(run, "a long, b long, cosine double")


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best b of each a: highest cosine, then least id. Moved once, by a."""
    one = pairs.repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, k: int = 10, dim: int = 64, least: float = -1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, cosine, rank): up to k most similar vectors b of every vector a, of at least the cosine `least`."""
    rows = valid(vectors, id_col, vec_col, dim).withColumn("c", F.xxhash64("v")).withColumn("d", F.xxhash64(F.lit(1), "v"))
    # A vector's class is known by its values; each task first keeps one row of a class.
    classes = written(rows.groupBy("c", "d", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "c", "d", "n"), "forest-classes")
    n = classes.count()
    alone = classes.select("id", "v")
    found = best(_found(_hashed(alone, dim), n, k, dim, least) if least >= FOREST_FROM else _compared(alone, n, k, dim, least), k)
    # Only classes of several rows have members; their shares keep a class that holds most rows from being one task's work.
    share, shares = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    several = classes.filter("n > 1").select("c", "d", F.col("id").alias("rep"), shares.alias("salt"))
    members = rows.select("c", "d", "id", share.alias("salt")).join(several, ["c", "d", "salt"]).filter("id <> rep").select("rep", "id", "salt").distinct()
    members = written(members, "forest-members")
    if members.isEmpty():
        return found
    reps = members.select("rep").distinct()
    # Copies: the first k + 1 ids of a class can be anyone's neighbours (WindowGroupLimit cuts each task's share first).
    everyone = members.unionByName(reps.select("rep", F.col("rep").alias("id"), share.alias("salt")).select("rep", "id", "salt"))
    first = everyone.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).select("rep", "id")
    near = written(found.select("a", "b", "cosine"), "forest-near")
    wide = near.join(first.select(F.col("rep").alias("b"), F.col("id").alias("m")), "b", "left").select("a", F.coalesce("m", "b").alias("b"), "cosine")
    wide = wide.unionByName(first.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine")))
    # A class needs k + 1, as each member leaves itself out.
    wide = written(best(wide, k + 1).select("a", "b", "cosine"), "forest-wide")
    copied = reps.withColumnRenamed("rep", "a")
    own = wide.join(copied, "a", "left_semi").withColumn("salt", shares).join(everyone.select(F.col("rep").alias("a"), "salt", F.col("id").alias("m")), ["a", "salt"])
    own = wide.join(copied, "a", "left_anti").unionByName(own.select(F.col("m").alias("a"), "b", "cosine"))
    return best(own.filter("a <> b"), k)
