"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_wide(a), F.lit(0.0), lambda t, x: t + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 for null, empty, zero or unlike vectors."""
    ratio = F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.try_divide(dot(a, b), norm(a) * norm(b)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def similarity(distance: Column, metric: str) -> Column:
    """Similarity of a distance; another metric than cosine, ip or l2 is an error."""
    if metric in ("cosine", "ip"):
        return 1 - distance
    if metric == "l2":
        return 1 - distance / 2
    raise ValueError(f"unknown metric: {metric}")


def centroid(df: DataFrame, group: list[str], vector: str, dim: int) -> DataFrame:
    """(group, centroid): sums over vectors of length `dim`, divided by the number of all vectors.

    The sums are per place, so partial aggregation leaves `dim` rows of each group and task.
    """
    counts = df.groupBy(*group).agg(F.count(vector).alias("_n"))
    sums = df.filter(F.size(vector) == dim).select(*group, F.posexplode(_wide(F.col(vector))).alias("_i", "_x")).groupBy(*group, "_i").agg(F.sum("_x").alias("_s"))
    placed = sums.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_v"))
    return placed.join(counts, group).select(*group, F.transform("_v", lambda p: p["_s"] / F.col("_n")).alias("centroid"))
