"""Street-image metadata: flatten, dedupe, tile, filter, split, shard, down-select."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfree.functions.geo import add_projection, usable
from stepfree.operators.ranking import hash_order, spread_rank

RAW_IMAGE = "id string, captured_at bigint, compass_angle double, camera_type string, geometry struct<coordinates:array<double>>, thumb_1024_url string"
MOST_TILE_DEG = 0.01


def required(*candidates: str) -> Column:
    """First non-blank of several columns, trimmed; null if all are blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates])


def required_or_fail(what: str, *candidates: str) -> Column:
    return F.coalesce(required(*candidates), F.raise_error(F.lit(f"{what}: no value in {', '.join(candidates)}")).cast("string"))


def flatten_raw(raw: DataFrame, json: str, city: str) -> DataFrame:
    """Manifest rows from raw image JSON: [lon, lat] to columns; rows without id,
    picture or a position of exactly two numbers are dropped."""
    parsed = raw.select(F.from_json(json, RAW_IMAGE).alias("i")).select("i.*")
    at = F.col("geometry.coordinates")
    return parsed.where((F.col("id") != "") & (F.col("thumb_1024_url") != "") & (F.size(at) == 2)).select(
        F.col("id").alias("image_id"), F.col("thumb_1024_url").alias("image_path"), at[1].alias("latitude"), at[0].alias("longitude"),
        F.lit(city).alias("city"), "compass_angle", F.col("captured_at").cast("string").alias("captured_at"),
    )


def first_delivery(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One whole row per non-blank key: the least by `order`, nulls last. Copies
    are folded before they are shuffled."""
    whole = F.struct(*df.columns)
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))])
    best = df.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != "")).groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, rank).alias("_row"))
    return best.select("_row.*")


def tiles(spark: SparkSession, west: float, south: float, east: float, north: float, cell: float = 0.004) -> DataFrame:
    """Row-major tiles of equal size that cover the box, none wider than `cell`."""
    if not 0 < cell < MOST_TILE_DEG:
        raise ValueError(f"cell must lie between 0 and {MOST_TILE_DEG}")
    if not (west < east and south < north):
        raise ValueError("the box is empty")
    nx, ny = max(1, math.ceil((east - west) / cell)), max(1, math.ceil((north - south) / cell))
    dx, dy = (east - west) / nx, (north - south) / ny
    i, j = F.col("id") % nx, F.floor(F.col("id") / nx)
    return spark.range(nx * ny).select(
        F.col("id").alias("tile"), (F.lit(west) + i * dx).alias("west"), (F.lit(south) + j * dy).alias("south"),
        (F.lit(west) + (i + 1) * dx).alias("east"), (F.lit(south) + (j + 1) * dy).alias("north"),
    )


def in_box(df: DataFrame, lat: str, lon: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows inside the box, edges included; two range predicates that reach the scan."""
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def in_city(df: DataFrame, city: str) -> DataFrame:
    """Case-blind equality; null and blank cities never match."""
    return df.where((F.lower(F.trim("city")) == city.lower()) & (F.trim("city") != ""))


def hash_split(key: Column, train: float) -> Column:
    """train or val by the first 32 bits of SHA-256."""
    if not 0 < train < 1:
        raise ValueError("the share must lie between 0 and 1")
    part = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    return F.when(part < train, "train").otherwise("val")


def shards(df: DataFrame, key: str, split: str, size: int) -> DataFrame:
    """`df` with shard and shard_name: per split, `size` rows a shard in a repeatable
    order. Ranks come from bucket counts, so a split with most rows is no bottleneck."""
    if size <= 0:
        raise ValueError("the shard size must be positive")
    ranked = spread_rank(df.withColumn("_order", hash_order(key)), [split], "_order", "_at").drop("_order")
    shard = F.floor((F.col("_at") - 1) / size).cast("int")
    return ranked.withColumn("shard", shard).withColumn("shard_name", F.format_string("%s_shard_%04d.json", split, shard)).drop("_at")


def downselect(df: DataFrame, cell_m: float = 20.0, most: int = 1) -> DataFrame:
    """The newest `most` images per (square of `cell_m` metres, compass quadrant).

    `captured_at` is compared as text, a null sorting above everything as the text
    None; missing or NaN headings count as 0; ties go to the lesser image_id. The
    rank limit is applied per task before the shuffle.
    """
    ok = df.where(usable(F.col("latitude"), F.col("longitude")))
    at = add_projection(ok, "latitude", "longitude")
    heading = F.coalesce(F.nanvl("compass_angle", F.lit(0.0)), F.lit(0.0))
    turned = heading - 360.0 * F.floor(heading / 360.0)
    keyed = at.withColumns({
        "cell_x": F.floor(F.col("east") / cell_m), "cell_y": F.floor(F.col("north") / cell_m), "quadrant": F.least(F.floor(turned / 90.0), F.lit(3)),
    })
    order = Window.partitionBy("zone", "cell_x", "cell_y", "quadrant").orderBy(F.coalesce("captured_at", F.lit("None")).desc(), "image_id")
    return keyed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select(*df.columns, "zone", "cell_x", "cell_y", "quadrant")
