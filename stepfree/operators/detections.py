"""Detections: cleaning, barrier scores, width agreement, review samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions.labels import BARRIER_WEIGHT, CLASS_OF_KEY, CLASSES, output_class
from stepfree.functions.polygon import shoelace_area, valid_points
from stepfree.functions.stats import units
from stepfree.functions.tags import WIDTHS
from stepfree.functions.text import class_key
from stepfree.functions.vision import kerb_width, pinhole_width

IMAGE_AREA = 1280.0 * 720.0
THRESHOLD = 0.30
LEAST_AREA_PX = 50.0


def clean(df: DataFrame) -> DataFrame:
    """`valid` rows, one per det_id: copies of a det_id count once."""
    return valid(df).dropDuplicates(["det_id"])


def valid(df: DataFrame) -> DataFrame:
    """det_id, trimmed image_id, class_name, class_key, confidence, points with two
    coordinates and their area. Rows without image, class, positive confidence or a
    valid point are dropped; copies stay, for what asks only whether there is one."""
    rows = df.where("confidence > 0 and not isnan(confidence)").select(
        "det_id", F.trim("image_id").alias("image_id"), "class_name", class_key(F.col("class_name")).alias("class_key"),
        "confidence", valid_points(F.col("polygon_xy")).alias("points"),
    )
    rows = rows.where("image_id <> '' and class_key <> '' and size(points) > 0")
    # the area comes before the shuffle, so that polygons are shuffled only where a query reads them
    return rows.withColumn("area", shoelace_area(F.col("points")))


def mapped(df: DataFrame) -> DataFrame:
    """Rows of classes that matter, large enough to be a mask."""
    return df.where(F.col("class_key").isin(list(CLASS_OF_KEY)) & (F.col("area") >= LEAST_AREA_PX) & (F.size("points") >= 3))


def barrier_scores(df: DataFrame, image_area: float = IMAGE_AREA, threshold: float = THRESHOLD) -> DataFrame:
    """(image_id, n_<class>..., score) per image; an image whose detections are all
    below the threshold keeps a row of zeros. One conditional aggregation, whose
    partial results take a hot image apart."""
    if image_area <= 0 or not 0 <= threshold <= 1:
        raise ValueError("bad image area or threshold")
    out = output_class(F.col("class_name"))
    rows = df.select("image_id", F.when(F.col("confidence") >= threshold, out).alias("c"), "confidence", "area")
    share = F.least(F.col("area") / image_area, F.lit(1.0)) * F.col("confidence")
    weighted = F.coalesce(*[F.when(F.col("c") == k, share * w) for k, w in BARRIER_WEIGHT.items()])
    counts = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n_{k}") for k in CLASSES]
    score = F.coalesce(F.sum(units(weighted, 9)), F.lit(0)) / 1e9
    return rows.groupBy("image_id").agg(*counts, score.alias("score"))


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of a class with the smallest area, ties by det_id: a top-k, no full sort."""
    return df.where(F.col("class_key") == key).orderBy("area", "det_id").limit(n).select("det_id", "image_id", "area")


def review_sample(df: DataFrame, seed: int, key: str, n: int) -> DataFrame:
    """n rows of a class in a seeded order that depends on nothing but det_id."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("det_id").cast("string")))
    return df.where(F.col("class_key") == key).withColumn("order_key", order).orderBy("order_key").limit(n).select("det_id", "order_key")


def crop_window(points, width: float, height: float) -> dict:  # noqa: ANN001
    """Zoom window around a mask: padded by half its larger side, 40 px at least, cut to the frame."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    pad = F.greatest(F.lit(40.0), F.greatest(x1 - x0, y1 - y0) * 0.5)
    return {
        "crop_x0": F.greatest(x0 - pad, F.lit(0.0)), "crop_y0": F.greatest(y0 - pad, F.lit(0.0)),
        "crop_x1": F.least(x1 + pad, F.lit(width)), "crop_y1": F.least(y1 + pad, F.lit(height)),
    }


def width_pairs(df: DataFrame, height: float) -> DataFrame:
    """(image_id, pinhole, kerb) for images with a sidewalk and a kerb: both width
    estimates from the first (least det_id) mask of each; nulls where no estimate."""
    key = F.col("class_key")
    first = lambda k: F.min_by(F.when(key == k, F.col("points")), F.when(key == k, F.col("det_id"))).alias(k)
    both = df.where(key.isin("sidewalk", "curb")).groupBy("image_id").agg(first("sidewalk"), first("curb"))
    both = both.where("sidewalk is not null and curb is not null")
    h = F.lit(height)
    return both.select("image_id", pinhole_width(F.col("sidewalk"), h).alias("pinhole"), kerb_width(F.col("sidewalk"), F.col("curb"), h).alias("kerb"))


def width_confusion(pairs: DataFrame) -> DataFrame:
    """(pinhole, kerb, n) for all nine pairs of buckets, zeros included."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in WIDTHS for b in WIDTHS], "pinhole string, kerb string")
    counts = pairs.groupBy("pinhole", "kerb").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["pinhole", "kerb"], "left").select("pinhole", "kerb", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """(eligible, compared, agree_pct, kappa); percentages are null for no pair."""
    n = F.sum(F.when(F.col("pinhole").isNotNull() & F.col("kerb").isNotNull(), 1).otherwise(0))
    sums = {"eligible": F.count(F.lit(1)), "compared": n, "same": F.sum(F.when(F.col("pinhole") == F.col("kerb"), 1).otherwise(0))}
    for w in WIDTHS:
        sums |= {f"p_{w}": F.sum(F.when((F.col("pinhole") == w) & F.col("kerb").isNotNull(), 1).otherwise(0)), f"k_{w}": F.sum(F.when((F.col("kerb") == w) & F.col("pinhole").isNotNull(), 1).otherwise(0))}
    total = pairs.agg(*[v.alias(k) for k, v in sums.items()])
    chance = sum((F.col(f"p_{w}") * F.col(f"k_{w}") for w in WIDTHS), F.lit(0)) / (F.col("compared") * F.col("compared"))
    some = F.col("compared") > 0
    po = F.col("same") / F.col("compared")
    return total.select(
        "eligible", "compared", F.when(some, F.floor(po * 1000 + 0.5) / 10).alias("agree_pct"),
        F.when(some & (chance < 1), F.floor((po - chance) / (1 - chance) * 1e6 + 0.5) / 1e6).alias("kappa"),
    )
