"""Problem 3: per-key results where a few keys hold most rows, by exact distributed selection.

The value at a rank of a key is found by narrowing an interval: a histogram of the
interval is counted (counts merge, so each task sends at most one row per key and bin
whatever the key's size), the bin that holds the rank becomes the next interval, until
it holds one value or no more than GATHER rows. No task ever holds a hot key's values.
Each bin also keeps its least and greatest value, so each round parts at least these
two and the result is exact, for any distribution and with ties.

Rows whose key or value is null (values also: NaN) take no part. Ranks beyond a key's
rows give its last value. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumensift.io import settle, written

#: Bins of a histogram, and rows an interval may hold when its values are listed.
BINS, GATHER = 1024, 256
#: Intervals (one per key and rank still open) that may be broadcast; more are joined by salted shuffle.
BROADCAST_STATES, SALTS = 200_000, 32


def _narrowed(cells: DataFrame) -> DataFrame:
    """Of each key and target, the bin that holds the rank: its bounds, rows and the rank within it."""
    w = W.partitionBy("key", "target").orderBy("bin")
    whole = W.partitionBy("key", "target")
    return (
        cells.withColumn("upto", F.sum("n").over(w))
        .withColumn("rank", F.least("rank", F.sum("n").over(whole)))
        .filter("upto >= rank and upto - n < rank")
        .select("key", "target", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi", "n")
    )


def _meet(rows: DataFrame, states: DataFrame, n_states: int) -> DataFrame:
    """Rows that lie in their key's open intervals, whatever the keys' sizes."""
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    if n_states <= BROADCAST_STATES:
        return rows.join(F.broadcast(states), "key").filter(inside)
    salted = states.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("value", F.spark_partition_id()), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).filter(inside).drop("salt")


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Linear bins of [lo, hi]; halves keep the width finite."""
    width = F.when(hi > lo, hi / 2 - lo / 2).otherwise(F.lit(1.0))
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((value / 2 - lo / 2) / width * BINS))).cast("int")


def select_ranks(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, target, value): the `rank`-th least value of each key.

    rows has key and value (any orderable number), targets has key, target and rank (from 1).
    """
    kind = rows.schema["value"].dataType
    rows = rows.select("key", "value").filter("key is not null and value is not null")
    if kind.typeName() in ("double", "float"):
        rows = rows.filter(~F.isnan("value"))
    if kind.typeName() in ("long", "integer"):
        number = F.col("value").cast("decimal(38,0)").cast("double")
    else:
        number = F.col("value").cast("double")
    rows = rows.withColumn("x", number)
    bounds = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi = (bounds.lo, bounds.hi) if bounds and bounds.lo is not None else (0.0, 0.0)
    cells = rows.groupBy("key", _bin(F.col("x"), F.lit(lo), F.lit(hi)).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    states = settle(_narrowed(cells.join(targets.select("key", "target", F.col("rank").cast("long").alias("rank")), "key")))
    done: list[DataFrame] = []
    while True:
        done.append(states.filter("lo = hi").select("key", "target", F.col("lo").alias("value")))
        few = states.filter(f"lo < hi and n <= {GATHER}")
        n_few, n_many = states.agg(F.count_if(F.expr(f"lo < hi and n <= {GATHER}")), F.count_if(F.expr(f"lo < hi and n > {GATHER}"))).first()
        if n_few:
            held = _meet(rows, few, n_few).groupBy("key", "target").agg(F.sort_array(F.collect_list("value")).alias("values"), F.first("rank").alias("rank"))
            done.append(held.select("key", "target", F.element_at("values", F.col("rank").cast("int")).alias("value")))
        if not n_many:
            break
        many = states.filter(f"lo < hi and n > {GATHER}")
        inside = _meet(rows, many, n_many)
        cells = inside.groupBy("key", "target", "rank", _bin(F.col("x"), F.col("lo").cast("double"), F.col("hi").cast("double")).alias("bin")).agg(
            F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
        )
        states = settle(_narrowed(cells))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def top_rows(df: DataFrame, key: str, value: str, ident: str, k: int) -> DataFrame:
    """The rows (key, value, ident) of each key's k greatest values (ties: least ident; fewer if it has fewer).

    Rows of one `ident` count once. Blank keys and null values take no part.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("score"), F.col(ident).alias("ident")).filter("key is not null and trim(key) <> '' and score is not null and not isnan(score)")
    # Unique ids spread evenly, so this is the one step that moves each row, and no key is hot in it.
    rows = written(rows.dropDuplicates(["ident"]), "selection")
    keys = rows.select("key", (-F.col("score")).alias("value"))
    # Every key is asked for its k-th; the keys themselves are found with a combining aggregate.
    wanted = rows.groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit(0).alias("target"), F.least(F.col("n"), F.lit(k)).alias("rank"))
    edge = settle(select_ranks(keys, wanted).select("key", (-F.col("value")).alias("edge")))
    n_keys = edge.count()
    side = F.broadcast(edge) if n_keys <= BROADCAST_STATES else edge.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = ["key"] if n_keys <= BROADCAST_STATES else ["key", "salt"]
    near = rows if len(on) == 1 else rows.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int"))
    near = written(near.join(side, on).filter("score >= edge").select("key", "score", "ident", "edge"), "near")
    above = near.filter("score > edge")
    tied = near.filter("score = edge")
    free = tied.groupBy("key").agg(F.count("*").alias("n_tied")).join(above.groupBy("key").agg(F.count("*").alias("n_above")), "key", "left").selectExpr("key", "0 AS target", f"{k} - coalesce(n_above, 0) AS rank", "n_tied")
    last = select_ranks(tied.selectExpr("key", "ident AS value"), free).select("key", F.col("value").alias("last"))
    if n_keys <= BROADCAST_STATES:
        kept = tied.join(F.broadcast(last), "key")
    else:  # a key may have any number of tied rows
        salted = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = tied.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    kept = kept.filter("ident <= last")
    cols = [F.col("key").alias(key), F.col("score").alias(value), F.col("ident").alias(ident)]
    return above.select(*cols).unionByName(kept.select(*cols))


def key_quantiles(df: DataFrame, key: str, value: str, shares: list[float], ident: str | None = None) -> DataFrame:
    """(key, n, q<percent>...): exact quantiles of each key, the least value with at least that share of rows up to it."""
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), *([F.col(ident).alias("ident")] if ident else [])).filter("key is not null and trim(key) <> '' and value is not null and not isnan(value)")
    if ident:
        rows = rows.dropDuplicates(["ident"])
    rows = written(rows.select("key", "value"), "quantiles")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    ranks = F.array(*[F.struct(F.lit(i).alias("target"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(s))).alias("rank")) for i, s in enumerate(shares)])
    found = select_ranks(rows, counts.select("key", F.explode(ranks).alias("t")).select("key", "t.target", "t.rank"))
    wide = found.groupBy("key").agg(*[F.max(F.when(F.col("target") == i, F.col("value"))).alias(f"q{round(s * 100)}") for i, s in enumerate(shares)])
    return counts.join(wide, "key").withColumnRenamed("key", key)
