"""The top N rows of every group, for very many and very uneven groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfree.session import BROADCAST_ROWS

#: A group is filtered by its histogram once it has this many rows per kept row.
HEAVY_FACTOR = 16


def score_bin(score: Column, per_octave: int = 8) -> Column:
    """A bin number that never falls as the score grows, about 9 % wide."""
    size = F.floor(F.log2(1 + F.abs(score)) * per_octave)
    return F.when(score < 0, -size - 1).otherwise(size).cast("long")


def top_n(df: DataFrame, group: list[str], key: str, score: str, n: int) -> DataFrame:
    """(group..., rank_pos, key, score): the n rows of each group with the highest
    score, ties by the lesser key, ranks from 1.

    Rows that agree in group, key and score are copies and count once. Rows with
    a null in the group, the key or the score are left out, NaN scores too. Groups
    with fewer than n rows come out whole; an empty table gives an empty result;
    other columns of `df` are dropped. Output names never clash with `df`'s
    because only the columns above are read.

    A histogram per group and score bin gives the lowest bin that certainly holds
    the n best: each bin keeps a 64-bit map of key hashes, whose number of set
    bits cannot exceed the number of different keys, so copies cannot push the
    threshold too high. Rows of heavy groups below their threshold are dropped
    before the exact ranking; light groups skip the filter. The ranking itself
    keeps n rows per group and task before its shuffle.
    """
    rows = df.select(*group, F.col(key), F.col(score).cast("double").alias(score)).where(
        " and ".join(f"`{c}` is not null" for c in [*group, key, score]) + f" and not isnan(`{score}`)"
    )
    binned = rows.withColumn("_bin", score_bin(F.col(score)))
    slot = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))")
    hist = binned.groupBy(*group, "_bin").agg(F.bit_or(slot).alias("_map"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    above = whole.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sure = hist.withColumn("_rows", F.sum("_n").over(whole)).where(F.col("_rows") > HEAVY_FACTOR * n)
    sure = sure.withColumn("_sure", F.sum(F.bit_count("_map").cast("long")).over(above)).where(F.col("_sure") >= n)
    floors = sure.groupBy(*group).agg(F.max("_bin").alias("_floor"))
    floors = floors.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "_floor")
    from stepfree.session import cut

    floors = cut(floors)
    same = F.lit(True)
    for i, c in enumerate(group):
        same = same & (F.col(c) == F.col(f"_g{i}"))
    if floors.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        floors = F.broadcast(floors)
    kept = binned.join(floors, same, "left").where(F.col("_floor").isNull() | (F.col("_bin") >= F.col("_floor")))
    single = kept.select(*group, key, score).distinct()
    order = whole.orderBy(F.desc(score), F.asc(key))
    return single.withColumn("rank_pos", F.row_number().over(order)).where(F.col("rank_pos") <= n).select(*group, "rank_pos", key, score)
