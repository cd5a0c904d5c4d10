"""Seeded, partition-independent samples: origin-destination pairs and label strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfree.functions.geo import add_projection
from stepfree.functions.stats import fair_draw
from stepfree.operators.ranking import hash_order, spread_rank
from stepfree.session import cut

PROBES = 5000
#: Draws a wanted pair: more only while a band is short, the last at most.
ATTEMPTS = (20, 100, 500)


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, east, north, zone, number from 0) in a repeatable order."""
    at = add_projection(nodes.select("node_id", "x", "y"), "y", "x").select("node_id", "zone", "east", "north")
    ranked = spread_rank(at.withColumn("_order", hash_order("node_id")).withColumn("_all", F.lit(1)), ["_all"], "_order", "number")
    return ranked.withColumn("number", F.col("number") - 1).drop("_order", "_all")


def _drawn(numbered: DataFrame, total: int, seeds: list[int], many: int, tag: str) -> DataFrame:
    """(seed, i, o, d, dist): pairs drawn by number; both ends in one zone, o <> d."""
    spark = numbered.sparkSession
    base = spark.range(many).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    n = F.lit(total)
    draws = base.select(
        "seed", F.col("id").alias("i"), fair_draw(n, F.col("seed").cast("string"), F.lit(tag), F.lit("o"), F.col("id").cast("string")).alias("a"),
        fair_draw(n, F.col("seed").cast("string"), F.lit(tag), F.lit("d"), F.col("id").cast("string")).alias("b"),
    )
    side = lambda end: numbered.select(F.col("number").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("node_id", "zone", "east", "north")])
    both = draws.join(side("a"), "a").join(side("b"), "b").where("a <> b and zone_a = zone_b")
    dx, dy = F.col("east_a") - F.col("east_b"), F.col("north_a") - F.col("north_b")
    return both.select("seed", "i", F.col("node_id_a").alias("o"), F.col("node_id_b").alias("d"), F.sqrt(dx * dx + dy * dy).alias("dist"))


def band_of(dist: Column, cuts: Column, strata: int) -> Column:
    """First band whose threshold lies above the distance, else the last."""
    return F.least(F.size(F.filter(cuts, lambda t: dist >= t)), F.lit(strata - 1))


def od_pairs(nodes: DataFrame, n: int = 1000, strata: int = 4, seeds: list[int] | None = None, probes: int = PROBES) -> DataFrame:
    """(seed, pair_id, o, d, dist, band): `n` pairs a seed, equally from bands of
    distance whose limits are taken from `probes` drawn pairs by position
    (element floor(q * m)). A pair and its reverse count once; the first bands get
    what does not divide. Draws go on until every band is full, up to `ATTEMPTS[-1]`
    a pair; only then a band may be short. The first draws hold, so how many are made
    at once does not show.
    Nothing joins all nodes with all nodes; the work follows n, not the network.
    """
    seeds = seeds or [42]
    numbered = cut(numbered_nodes(nodes))
    total = nodes.count()
    if total < 2:
        return nodes.sparkSession.createDataFrame([], "seed int, pair_id bigint, o bigint, d bigint, dist double, band int")
    probe = _drawn(numbered, total, seeds, probes, "probe")
    ordered = Window.partitionBy("seed").orderBy("dist", "i")  # at most `probes` rows
    ranked = probe.withColumn("r", F.row_number().over(ordered) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("seed")))
    wanted = F.array(*[F.least(F.floor(F.col("m") * (j / strata)), F.col("m") - 1) for j in range(1, strata)])
    cuts = ranked.where(F.array_contains(wanted, F.col("r"))).groupBy("seed").agg(F.array_sort(F.collect_list("dist")).alias("cuts"))
    for attempts in ATTEMPTS:
        drawn = _drawn(numbered, total, seeds, attempts * n, "pair").join(F.broadcast(cuts), "seed")
        rows = drawn.select("seed", "i", "o", "d", "dist", band_of(F.col("dist"), F.col("cuts"), strata).alias("band"))
        first = rows.groupBy("seed", F.least("o", "d").alias("_a"), F.greatest("o", "d").alias("_b")).agg(F.min(F.struct("i", "o", "d", "dist", "band")).alias("p"))
        kept = first.select("seed", "p.*").withColumn("_n", F.row_number().over(Window.partitionBy("seed", "band").orderBy("i")))
        quota = F.lit(n // strata) + F.when(F.col("band") < n % strata, 1).otherwise(0)
        pairs = cut(kept.where(F.col("_n") <= quota).select("seed", F.col("i").alias("pair_id"), "o", "d", "dist", "band"))
        if pairs.count() >= n * len(seeds):
            break
    return pairs


def label_strata(labels: DataFrame, quotas: dict[tuple[str, str], int], seed: int = 7) -> DataFrame:
    """(segment_id, attribute, verdict): a seeded sample of given size per
    (attribute, verdict); the rank limit is applied before the shuffle."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "segment_id", "attribute"))
    wanted = F.coalesce(*[F.when((F.col("attribute") == a) & (F.col("verdict") == v), q) for (a, v), q in quotas.items()], F.lit(0))
    ranked = labels.withColumn("_n", F.row_number().over(Window.partitionBy("attribute", "verdict").orderBy(order, "segment_id")))
    return ranked.where(F.col("_n") <= max(quotas.values())).where(F.col("_n") <= wanted).select("segment_id", "attribute", "verdict")
