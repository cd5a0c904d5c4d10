"""Exact ranks without a one-task window.

A `row_number()` over a hot group sorts the whole group in one task. Here every
group is cut into buckets that follow the order, the buckets are counted (a
partial aggregation), running totals over the few buckets of a group give each
bucket its offset, and rows are ranked inside (group, bucket) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*columns: str) -> Column:
    """A repeatable, evenly spread order: the md5 of the columns as text.
    Nulls count as the empty text."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def spread_rank(df: DataFrame, group: list[str], order: str, name: str = "rank_pos", digits: int = 3) -> DataFrame:
    """Append the 1-based rank by `order` inside `group`.

    `order` is a column of lower-case hexadecimal text such as `hash_order`
    gives; its first `digits` digits are the bucket (16**digits of them), so a
    group with a third of all rows is ranked by up to 4096 tasks. Ties in
    `order` are broken by nothing else: pass a unique order. An empty frame
    stays empty, null group keys form one group.
    """
    bucket = "_bucket"
    keyed = df.withColumn(bucket, F.substring(order, 1, digits))
    counts = keyed.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    right = offsets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, bucket])], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*group, bucket])]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    local = Window.partitionBy(*group, bucket).orderBy(order)
    return (
        keyed.withColumn("_local", F.row_number().over(local))
        .join(right, condition)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop(bucket, "_local", "_before", *[f"_k{i}" for i in range(len(group) + 1)])
    )
