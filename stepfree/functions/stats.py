"""Rounding, index quantiles and rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(x: Column, digits: int = 6) -> Column:
    """Half-up rounding by the same double operations in every engine; no -0."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits) + 0.0


def units(x: Column, digits: int = 6) -> Column:
    """A double as a whole number of 10**-digits, for sums that do not depend on order."""
    return F.floor(x * F.lit(10.0**digits) + 0.5).cast("bigint")


def fair_draw(size: Column, *parts: Column | str) -> Column:
    """A repeatable number from 0 to size - 1 out of a digest of the parts."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint"), size)


def value_bucket(value: Column) -> Column:
    """A number that never falls as a double grows, from its exponent and first bits:
    about 128 buckets an octave, whatever the scale."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-12))) * 128).cast("bigint") + 8192
    return F.when(value < 0, -size).when(value > 0, size).otherwise(F.lit(0).cast("bigint"))


def running_totals(df: DataFrame, by: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Append the total weight of the group's rows with a lesser or the same value, which
    has to be unique in the group. Weights are summed by bucket of the value first;
    a group's few thousand buckets are added up, and rows only inside their bucket."""
    keyed = df.withColumn("_bucket", value_bucket(F.col(value).cast("double")))
    sums = keyed.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    local = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumn("_local", F.sum(weight).over(local)).join(starts, same)
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_b", "_before", *[f"_k{i}" for i in range(len(by))])


def wilcoxon(df: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """(by..., n, statistic, p): signed ranks of first - second, zeros dropped, mean
    ranks for ties, two-sided normal approximation with tie correction. Groups
    whose differences are all below 1e-9 have null statistic and p.

    Rows go in groups of `by`; equal absolute differences are counted before
    ranking, and ranks come from bucket counts (`running_totals`), so no task sorts a
    group.
    """
    d = df.withColumn("_d", F.col(first) - F.col(second)).where("_d is not null and _d <> 0")
    d = d.withColumn("_a", F.abs("_d"))
    tied = d.groupBy(*by, "_a").agg(F.count(F.lit(1)).alias("_t"), F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("_plus"))
    ranked = running_totals(tied, by, "_a", "_t", "_upto").withColumn("_rank", F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / 2)
    total = ranked.groupBy(*by).agg(
        F.sum("_t").alias("n"),
        F.sum(F.col("_rank") * F.col("_plus")).alias("w_plus"),
        F.sum(F.col("_rank") * (F.col("_t") - F.col("_plus"))).alias("w_minus"),
        F.sum(F.pow(F.col("_t"), F.lit(3)) - F.col("_t")).alias("_ties"),
        F.max("_a").alias("_most"),
    )
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.abs(F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(var * 2)
    real = F.col("_most") >= 1e-9
    done = total.select(*by, "n", F.when(real, F.least("w_plus", "w_minus")).alias("statistic"), F.when(real, z).cast("double").alias("_z"))
    return done.select(*by, "n", "statistic", F.expr(erfc_sql("_z")).alias("p"))


def erfc_sql(x: str) -> str:
    """SQL of the complementary error function for x >= 0, right to about 1e-12 of its
    value: a series below 2, a continued fraction above."""
    series, fraction = "1", x
    for n in range(50, 0, -1):
        series = f"(1 + 2 * {x} * {x} / {2 * n + 1} * {series})"
    for n in range(60, 0, -1):
        fraction = f"({x} + {n / 2} / {fraction})"
    scale = f"exp(-1.0 * {x} * {x}) / sqrt(pi())"
    return f"(case when {x} < 2 then 1 - 2 * {x} * {series} * {scale} else {scale} / {fraction} end)"
