"""The street network: clean edges, snapping, evidence, fusion, labels, conditions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfree.functions import tags as T
from stepfree.functions.cost import CostConfig, edge_cost
from stepfree.functions.geo import EARTH_RADIUS_M, add_projection, project, zone_meridian
from stepfree.functions.labels import evidence_attribute, lookup
from stepfree.functions.tags import ABSENT, PRESENT, UNKNOWN
from stepfree.functions.vision import pinhole_width
from stepfree.operators.kdtree import KDTree

KEY = ["u", "v", "k"]
MOST_SNAP_M = 25.0
_CELL_M = 50.0
#: Steps of half a cell in a part of a long edge (3.2 km); cells to a side of the blocks in which images near it are looked for.
_PART = 128
#: Up to so many metres the nearest node is measured on the projection plane; nodes a search task is sent at once.
PLANE_M, NODE_BLOCK = 100_000.0, 200_000

# fixed values: default of a missing attribute, by policy
DEFAULTS = {
    "tactile_paving_present": ABSENT,
    "handrail_present": ABSENT,
    "ramp_present": ABSENT,
    "marked_crossing_present": ABSENT,
    "steps_present": UNKNOWN,
    "fixed_obstacle_present": UNKNOWN,
    "surface_material_tier": "fair",
    "smoothness_tier": "fair",
    "width_bucket": "50_to_90cm",
}
# fixed values: condition to (source of ramps, source of obstacles)
CONDITIONS = {
    "baseline": ("baseline", "baseline"),
    "full_validated": ("validated", "validated"),
    "full_raw": ("raw", "raw"),
    "ramp_only": ("validated", "baseline"),
    "obstacle_only": ("baseline", "validated"),
}


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row per (u, v, k); rows without a node or with a length that is null,
    NaN or negative are dropped."""
    ok = edges.where("u is not null and v is not null and k is not null and length >= 0 and not isnan(length)")
    return ok.dropDuplicates(KEY)


def valid_elevation(elevation: Column, nodata: float = -9999.0) -> Column:
    """Null for NaN, NoData (within 1e-5 of it) and anything outside 0..3000 m."""
    bad = F.isnan(elevation) | (F.abs(elevation - nodata) <= abs(nodata) * 1e-5) | (elevation < 0) | (elevation > 3000)
    return F.when(~bad, elevation)


def with_nodes(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both end nodes as <column>_u and <column>_v."""
    out = edges
    for end in "uv":
        side = nodes.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        out = out.join(side, end, "left")
    return out


def grades(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, k, grade, grade_abs) from node elevations; null where one is missing
    or the edge has no length."""
    z = nodes.select("node_id", valid_elevation(F.col("elevation")).alias("z"))
    both = with_nodes(edges, z, "z")
    grade = F.when(F.col("length") > 0, (F.col("z_v") - F.col("z_u")) / F.col("length"))
    return both.select(*KEY, grade.alias("grade"), F.abs(grade).alias("grade_abs"))


def map_evidence(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """(u, v, k, nine attributes): what tags say, null where they say nothing; with the
    edges' own `columns`, if given."""
    both = with_nodes(edges, nodes.select("node_id", "tags").withColumnRenamed("tags", "ntags"), "ntags")
    found = T.canonical(F.col("tags"), F.col("ntags_u"), F.col("ntags_v"))
    return both.select(*KEY, *columns, *[c.alias(n) for n, c in found.items()])


def segment_id(u: Column, v: Column, k: Column) -> Column:
    """The same text for both directions: ends in text order."""
    a, b = u.cast("string"), v.cast("string")
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b), k.cast("string"))


#: Degrees of longitude times the cosine of latitude that make a bit more than `MOST_SNAP_M`.
_NEAR_SEAM = 3e-4


def zones_of_ends(x0: str, y0: str, x1: str, y1: str) -> list[str]:
    """SQL of the zones that an edge's ends are in or within reach of."""
    out = []
    for x, y in ((x0, y0), (x1, y1)):
        for sign in ("-", "+"):
            moved = f"({x} {sign} {_NEAR_SEAM} / cos(radians(least(abs({y}), 85.0))))"
            out.append(zone_meridian(f"({moved} - 360 * floor(({moved} + 180) / 360))"))
    return out


def in_zones(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with zone and the east and north of both ends on its plane, once for each
    zone an edge may have images in: one, but for those at a seam."""
    both = with_nodes(edges, nodes.select("node_id", "x", "y"), "x", "y").where("x_u is not null and x_v is not null and y_u is not null and y_v is not null")
    zones = F.array_distinct(F.array(*[F.expr(z).cast("int") for z in zones_of_ends("x_u", "y_u", "x_v", "y_v")]))
    out = both.withColumn("zone", F.explode(zones))
    for end in "uv":
        at = add_projection(out, f"y_{end}", f"x_{end}", "zone").select(*out.columns, F.col("east").alias(f"east_{end}"), F.col("north").alias(f"north_{end}"))
        out = at
    return out.drop("x_u", "x_v", "y_u", "y_v")


def snap(images: DataFrame, edges: DataFrame, nodes: DataFrame, most_m: float = MOST_SNAP_M) -> DataFrame:
    """(image_id, u, v, k, dist): each image's nearest edge, at most `most_m` away.

    Images are (image_id, latitude, longitude), usable and unique. Equal distances
    go to the least (u, v, k). Each image is measured on the plane of its own 6-degree
    zone; an edge lies on the planes of all zones its ends are in or near. Edges are straight; they are laid into square cells
    along their course, wide enough that an image need only look into its own cell:
    an equi-join instead of a comparison of all with all. Twins and parallel edges are
    one line, laid once; the least (u, v, k) stands for it. See `lay` for long edges.
    """
    if most_m > _CELL_M / 2:
        raise ValueError(f"at most {_CELL_M / 2} m")
    im = add_projection(images, "latitude", "longitude")
    # NaN, which is near nothing, instead of null: a filter for nulls would work out the projection once more, term by term
    plane = lambda c: F.coalesce(c, F.lit(float("nan")))
    im = im.select("image_id", "zone", plane("east").alias("east"), plane("north").alias("north"))
    im = im.withColumns({c: F.coalesce(F.floor(F.col(x) / _CELL_M), F.lit(0)) for c, x in (("cx", "east"), ("cy", "north"))})
    known = edges.where("u is not null and v is not null")
    lines = known.groupBy(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b")).agg(F.min(F.struct(*KEY)).alias("_key"))
    ends = in_zones(lines.select(F.col("_a").alias("u"), F.col("_b").alias("v"), "_key"), nodes)
    at = {"x0": "east_u", "y0": "north_u", "x1": "east_v", "y1": "north_v"}
    lines = ends.select(*[F.col(f"_key.{c}") for c in KEY], "zone", *[plane(c).alias(n) for n, c in at.items()])
    laid = lay(lines, im)
    near = im.join(laid, ["zone", "cx", "cy"]).withColumn("dist", segment_distance("east", "north", "x0", "y0", "x1", "y1"))
    near = near.where(F.col("dist") <= most_m)
    best = near.groupBy("image_id").agg(F.min(F.struct("dist", *KEY)).alias("b"))
    return best.select("image_id", "b.u", "b.v", "b.k", "b.dist")


def lay(lines: DataFrame, images: DataFrame) -> DataFrame:
    """(u, v, k, zone, x0, y0, x1, y1, cx, cy): the cells along each line and those around them.
    Of a line of more than `_PART` steps only the parts that have images about them are laid:
    a ferry or a misplaced node would else fill the disk with cells that no image looks into."""
    columns = lines.columns
    long = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    lines = lines.withColumn("_n", F.greatest(F.ceil(long / (_CELL_M / 2)), F.lit(1)).cast("int"))
    along = lambda a, share: F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * share
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    far = (lines.agg(F.max("_n")).first()[0] or 0) > _PART
    short = lines.where(F.col("_n") <= _PART) if far else lines  # a filter works out the projection once more
    spots = short.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    if far:
        # a part's ends are half a block from its middle at most, so its images are in the middle's block or one beside it
        blocks = images.select("zone", F.floor(F.col("cx") / _PART).alias("_bx"), F.floor(F.col("cy") / _PART).alias("_by")).distinct()
        blocks = blocks.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        blocks = blocks.select("zone", (F.col("_bx") + F.col("_dx")).alias("_bx"), (F.col("_by") + F.col("_dy")).alias("_by")).distinct()
        parts = lines.where(F.col("_n") > _PART).withColumn("_p", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _PART).cast("int"))))
        middle = F.least((F.col("_p") + 0.5) * _PART / F.col("_n"), F.lit(1.0))
        parts = parts.withColumns({f"_b{a}": F.floor(along(a, middle) / (_CELL_M * _PART)) for a in "xy"}).join(blocks, ["zone", "_bx", "_by"], "left_semi")
        some = parts.withColumn("_i", F.explode(F.sequence(F.col("_p") * _PART, F.least("_n", (F.col("_p") + 1) * _PART))))
        spots = spots.unionByName(some.select(*spots.columns))
    share = F.col("_i") / F.col("_n")
    spots = spots.withColumns({f"_{a}": F.floor(along(a, share) / _CELL_M) for a in "xy"})
    spots = spots.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    return spots.select(*columns, (F.col("_x") + F.col("_dx")).alias("cx"), (F.col("_y") + F.col("_dy")).alias("cy")).distinct()


def segment_distance(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> Column:
    """Distance of a point to a segment; to its end for a segment without length."""
    text = (
        f"case when ({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}) > 0 then greatest(0D, least(1D, "
        f"(({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0})))) else 0D end"
    )
    t = F.expr(text)
    dx, dy = F.col(px) - (F.col(x0) + t * (F.col(x1) - F.col(x0))), F.col(py) - (F.col(y0) + t * (F.col(y1) - F.col(y0)))
    return F.sqrt(dx * dx + dy * dy)


def mirror(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Assignments to their own edge and to the reverse twin, where there is one;
    a loop is not given its own image twice."""
    keys = edges.select(*KEY)
    twin = assigned.where("u <> v").select("image_id", F.col("v").alias("u"), F.col("u").alias("v"), "k")
    return assigned.select("image_id", *KEY).unionByName(twin.join(keys, KEY, "left_semi").select("image_id", *KEY))


def image_evidence(assigned: DataFrame, detections: DataFrame) -> DataFrame:
    """(u, v, k, ramp_present, marked_crossing_present, fixed_obstacle_present,
    n_images): present where any image of the edge shows a class that says so.
    Pictures can show presence, never absence. Detections are reduced to one row
    per image before they meet the edges."""
    kinds = ["ramp_present", "marked_crossing_present", "fixed_obstacle_present"]
    attr = evidence_attribute(F.col("class_name"))
    per_image = detections.select("image_id", attr.alias("attr")).groupBy("image_id").agg(
        *[F.max(F.when(F.col("attr") == a, 1)).alias(a) for a in kinds]
    )  # numbers: texts would be sorted before they are folded
    joined = assigned.join(per_image, "image_id")
    done = joined.groupBy(*KEY).agg(*[F.max(a).alias(a) for a in kinds], F.count(F.lit(1)).alias("n_images"))
    return done.select(*KEY, *[F.when(F.col(a) == 1, PRESENT).alias(a) for a in kinds], "n_images")


def picture_geometry(images: DataFrame, detections: DataFrame, height: float, slopes: DataFrame | None = None) -> DataFrame:
    """(image_id, width_bucket_uncalibrated_estimate, ramp_declivity_pct): the
    narrowest walkway seen, and the terrain's slope where a kerb ramp is seen.
    `slopes` is (image_id, slope). Kept apart from the attributes: neither may
    stand in for a measured width or a tag."""
    key, order = F.col("class_key"), {w: i for i, w in enumerate(T.WIDTHS)}
    width = F.when(key.isin("sidewalk", "pedestrian-area"), pinhole_width(F.col("points"), F.lit(height)))
    seen = detections.select("image_id", lookup(width, order).alias("w"), (key == "curb-cut").cast("int").alias("ramp"))
    per = seen.groupBy("image_id").agg(F.min("w").alias("w"), F.max("ramp").alias("ramp"))
    per = per.select("image_id", F.coalesce(*[F.when(F.col("w") == i, w) for w, i in order.items()]).alias("width_bucket_uncalibrated_estimate"), "ramp")
    out = images.select("image_id").join(per, "image_id")
    slope = F.lit(None).cast("double")
    if slopes is not None:
        out = out.join(slopes, "image_id", "left")
        slope = F.when(F.col("ramp") == 1, F.floor(F.col("slope") * 100 + 0.5) / 100)
    return out.select("image_id", "width_bucket_uncalibrated_estimate", slope.alias("ramp_declivity_pct"))


def edge_geometry(assigned: DataFrame, per_image: DataFrame) -> DataFrame:
    """(u, v, k, width..., ramp_declivity_pct): narrowest width and steepest ramp of an edge's images."""
    order = {w: i for i, w in enumerate(T.WIDTHS)}
    rows = assigned.join(per_image, "image_id").withColumn("w", lookup(F.col("width_bucket_uncalibrated_estimate"), order))
    done = rows.groupBy(*KEY).agg(F.min("w").alias("w"), F.max("ramp_declivity_pct").alias("ramp_declivity_pct"))
    return done.select(*KEY, F.coalesce(*[F.when(F.col("w") == i, w) for w, i in order.items()]).alias("width_bucket_uncalibrated_estimate"), "ramp_declivity_pct")


def is_missing(c: Column) -> Column:
    return c.isNull() | (c == UNKNOWN)


def fuse(edges: DataFrame, from_map: DataFrame, from_images: DataFrame) -> DataFrame:
    """Per edge: tags before pictures before policy default, with <a>_imputed and
    <a>_source (osm, imagery or null), and the number of images."""
    pictures = from_images.select(*KEY, "n_images", *[F.col(a).alias(f"i_{a}") for a in DEFAULTS if a in from_images.columns])
    both = edges.select(*KEY, "length", "grade", "grade_abs").join(from_map, KEY, "left").join(pictures, KEY, "left")
    out = [*KEY, "length", "grade", "grade_abs"]
    for a, default in DEFAULTS.items():
        seen = F.col(f"i_{a}") if f"i_{a}" in pictures.columns else F.lit(None).cast("string")
        known = F.coalesce(F.col(a), seen)
        missing = is_missing(known)
        out += [
            F.when(missing, F.lit(default)).otherwise(known).alias(a), missing.alias(f"{a}_imputed"),
            F.when(F.col(a).isNotNull(), "osm").when(seen.isNotNull(), "imagery").alias(f"{a}_source"),
        ]
    return both.select(*out, F.coalesce("n_images", F.lit(0)).alias("n_images_observed"))


def imputation_rate(fused: DataFrame) -> DataFrame:
    """(attribute, pct): share of imputed values; no rows for an empty table."""
    flags = fused.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"{a}_imputed").cast("int")).alias(a) for a in DEFAULTS])
    pairs = ", ".join(f"'{a}', {a}" for a in DEFAULTS)
    long = flags.selectExpr("n", f"stack({len(DEFAULTS)}, {pairs}) as (attribute, c)").where("n > 0")
    return long.select("attribute", (F.floor(F.col("c") * 100.0 / F.col("n") * 100 + 0.5) / 100).alias("pct"))


def tag_coverage(edges: DataFrame, names: Iterable[str] = tuple(T.WAY_TAGS)) -> DataFrame:
    """(tag, pct, n): edges that have the tag."""
    names = list(names)
    sums = edges.agg(F.count(F.lit(1)).alias("n"), *[F.sum(T.values(F.col("tags"), t).isNotNull().cast("int")).alias(f"t_{t}") for t in names])
    pairs = ", ".join(f"'{t}', t_{t}" for t in names)
    long = sums.selectExpr("n as total", f"stack({len(names)}, {pairs}) as (tag, n)").where("total > 0")
    return long.select("tag", (F.floor(F.col("n") * 100.0 / F.col("total") * 100 + 0.5) / 100).alias("pct"), F.col("n").cast("bigint").alias("n"))


# --- labels ------------------------------------------------------------------------


def latest_labels(labels: DataFrame) -> DataFrame:
    """(segment_id, attribute, verdict, note): an upsert by (segment, attribute): the
    latest label holds, ties go to the greater verdict. Segment ids are brought to
    one direction; blank verdicts and damaged ids are dropped. A segment with very
    many labels is folded task by task."""
    p = F.split("segment_id", "_")
    ok = labels.where((F.size(p) == 3) & (F.trim("verdict") != "") & F.col("attribute").isNotNull())
    keyed = ok.select(
        segment_id(p[0], p[1], p[2]).alias("segment_id"), "attribute",
        F.struct("labelled_at", F.lower(F.trim("verdict")).alias("verdict"), F.coalesce("note", F.lit("")).alias("note")).alias("l"),
    )
    best = keyed.groupBy("segment_id", "attribute").agg(F.max("l").alias("l"))
    return best.select("segment_id", "attribute", "l.verdict", "l.note")


def apply_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with <attribute>_validated_value for ramps and obstacles: present and
    absent reach both directed twins, uncertain reaches none."""
    wide = labels.where(F.col("verdict").isin(PRESENT, ABSENT)).groupBy(F.col("segment_id").alias("_seg")).agg(
        *[F.max(F.when(F.col("attribute") == a, F.col("verdict"))).alias(f"{a}_validated_value") for a in ("ramp_present", "fixed_obstacle_present")]
    )
    keyed = edges.withColumn("_seg", segment_id(F.col("u"), F.col("v"), F.col("k")))
    return keyed.join(wide, "_seg", "left").drop("_seg")


def worklist(assigned: DataFrame, detections: DataFrame) -> DataFrame:
    """(segment_id, attribute, image_id, det_id, area, n_detections, n_images): per
    segment and attribute the largest mask (ties: least det_id) and how many
    detections and images speak for it. Twins hold the same images, so a
    detection counts once per directed edge, as in the mirrored evidence."""
    attr = F.col("attribute").isin("ramp_present", "fixed_obstacle_present")
    found = detections.select("image_id", "det_id", "area", evidence_attribute(F.col("class_name")).alias("attribute")).where(attr)
    rows = assigned.withColumn("segment_id", segment_id(F.col("u"), F.col("v"), F.col("k"))).join(found, "image_id")
    best = F.max_by(F.struct("image_id", "det_id", "area"), F.struct("area", -F.col("det_id")))
    per_image = rows.groupBy("segment_id", "attribute", "image_id").agg(best.alias("b"), F.count(F.lit(1)).alias("c"))
    top = F.max_by("b", F.struct(F.col("b.area"), -F.col("b.det_id")))
    done = per_image.groupBy("segment_id", "attribute").agg(top.alias("b"), F.sum("c").alias("n_detections"), F.count(F.lit(1)).alias("n_images"))
    return done.select("segment_id", "attribute", "b.image_id", "b.det_id", "b.area", "n_detections", "n_images")


def unlabelled(work: DataFrame, labels: DataFrame, attribute: str | None = None, most: int | None = None) -> DataFrame:
    """Rows of the worklist without a label; optionally one attribute, the first `most`."""
    left = work.join(labels, ["segment_id", "attribute"], "left_anti")
    left = left.where(F.col("attribute") == attribute) if attribute else left
    return left.orderBy("segment_id", "attribute").limit(most) if most is not None else left


# --- conditions --------------------------------------------------------------------


def condition_edges(fused: DataFrame, discounts: list[float] | None = None, penalties: list[float] | None = None, config: CostConfig = CostConfig()) -> DataFrame:
    """Edges of every condition with their cost, times every (discount, penalty).

    raw keeps the fused value, baseline the policy default, validated the adjudicated
    value or else the default. Conditions and settings are a literal array that is
    exploded: the edges are read once and never joined with them.
    """
    spark_rows = [(c, r, o) for c, (r, o) in CONDITIONS.items()]
    cond = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(r).alias("r"), F.lit(o).alias("o")) for c, r, o in spark_rows])
    grid = [(d, p) for d in (discounts or [config.ramp_discount]) for p in (penalties or [config.obstacle_penalty])]
    cfg = F.array(*[F.struct(F.lit(i).alias("cfg_id"), F.lit(float(d)).alias("discount"), F.lit(float(p)).alias("penalty")) for i, (d, p) in enumerate(grid)])
    rows = fused.withColumn("c", F.explode(cond)).withColumn("g", F.explode(cfg))

    def pick(attr: str, source: Column, default: str) -> tuple[Column, Column]:
        value = F.col(f"{attr}_validated_value")
        chosen = F.when(source == "raw", F.col(attr)).when(source == "validated", F.coalesce(value, F.lit(default))).otherwise(F.lit(default))
        imputed = F.when(source == "raw", F.col(f"{attr}_imputed")).when(source == "validated", value.isNull()).otherwise(F.lit(True))
        return chosen, imputed

    ramp, ramp_i = pick("ramp_present", F.col("c.r"), ABSENT)
    stop, stop_i = pick("fixed_obstacle_present", F.col("c.o"), UNKNOWN)
    rows = rows.withColumns({"ramp_present": ramp, "ramp_present_imputed": ramp_i, "fixed_obstacle_present": stop, "fixed_obstacle_present_imputed": stop_i})
    cost = edge_cost(F.col("g.discount"), F.col("g.penalty"), config)
    return rows.select("c.condition", "g.cfg_id", *KEY, "length", "ramp_present", "ramp_present_imputed", "fixed_obstacle_present", "steps_present", cost.alias("cost"))


def guard_violations(costed: DataFrame) -> DataFrame:
    """(guard, violations): a sound build has zeros only."""
    base = F.col("condition") == "baseline"
    sums = costed.agg(
        F.coalesce(F.sum((base & (F.col("ramp_present") != ABSENT)).cast("int")), F.lit(0)).alias("baseline_ramps"),
        F.coalesce(F.sum((base & (F.col("fixed_obstacle_present") != UNKNOWN)).cast("int")), F.lit(0)).alias("baseline_obstacles"),
        F.coalesce(F.sum((F.col("cost").isNull() | (F.col("cost") < 0)).cast("int")), F.lit(0)).alias("negative_costs"),
    )
    return sums.selectExpr("stack(3, 'baseline_ramps', baseline_ramps, 'baseline_obstacles', baseline_obstacles, 'negative_costs', negative_costs) as (guard, violations)")


def parallel_min(costed: DataFrame) -> DataFrame:
    """(condition, cfg_id, u, v, k, cost): the cheapest of parallel edges, ties to the least k."""
    best = costed.groupBy("condition", "cfg_id", "u", "v").agg(F.min(F.struct("cost", "k")).alias("b"))
    return best.select("condition", "cfg_id", "u", "v", "b.k", "b.cost")


def segment_midpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(segment_id, lat, lon): middle of the end nodes, per undirected segment."""
    both = with_nodes(edges.select(*KEY), nodes.select("node_id", "x", "y"), "x", "y")
    seg = both.select(segment_id(F.col("u"), F.col("v"), F.col("k")).alias("segment_id"), F.struct((F.col("y_u") + F.col("y_v")).alias("y"), (F.col("x_u") + F.col("x_v")).alias("x")).alias("m"))
    return seg.groupBy("segment_id").agg(F.min("m").alias("m")).select("segment_id", (F.col("m.y") / 2).alias("lat"), (F.col("m.x") / 2).alias("lon"))


def nearest_node(points: DataFrame, nodes: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """(key, node_id, dist): nearest node of every point on the globe, ties to the
    least node_id. Within `PLANE_M` the distance is that on the plane of the point's
    own 6-degree zone, whichever zone the node is in; beyond it, and past 84 degrees,
    that on the great circle. Nodes are sent to the tasks in blocks of at most
    about `NODE_BLOCK`; the nearest of all blocks holds."""
    spark = points.sparkSession
    inside = lambda y, x: (F.abs(y) <= 90) & (F.abs(x) <= 180)
    known = nodes.where("node_id is not null").where(inside(F.col("y"), F.col("x"))).select("node_id", F.col("y").cast("double"), F.col("x").cast("double"))
    p = points.where(inside(F.col(lat), F.col(lon))).select(F.col(key), F.col(lat).cast("double"), F.col(lon).cast("double"))
    kind, id_kind = p.schema[key].dataType.simpleString(), known.schema["node_id"].dataType.simpleString()
    blocks = max(1, -(-known.count() // NODE_BLOCK))
    out = None
    for i in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("node_id"), F.lit(blocks)) == i).toPandas().sort_values("node_id")
        search = _nearest_in(spark.sparkContext.broadcast((rows["node_id"].to_numpy(), rows["y"].to_numpy(), rows["x"].to_numpy())))
        part = p.mapInArrow(search, f"`{key}` {kind}, node_id {id_kind}, plane boolean, dist double")
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct((~F.col("plane")).alias("far"), "dist", "node_id"))
    return out.groupBy(key).agg(best.alias("b")).select(key, "b.node_id", "b.dist")


def _nearest_in(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        phi, lam = np.radians(lat), np.radians(lon)
        return np.column_stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, x = shared.value
        if not len(ids):
            return
        globe, planes = KDTree(vectors(y, x)), {}

        def plane(meridian: float) -> tuple[np.ndarray, KDTree]:
            """The nodes that may lie within reach of the zone's points, on its plane."""
            if meridian not in planes:
                off = np.abs((x - meridian + 180) % 360 - 180)
                reach = 3 + np.degrees(1.02 * PLANE_M / 6_335_000) / np.cos(np.radians(np.minimum(np.abs(y) + 1, 88)))
                some = np.flatnonzero((off <= reach) & (np.abs(y) <= 86))
                planes[meridian] = some, KDTree(project(y[some], x[some], meridian))
            return planes[meridian]

        for batch in batches:
            lat, lon = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            best, dist, on_plane = np.full(len(lat), -1), np.full(len(lat), np.inf), np.zeros(len(lat), bool)
            meridians = np.minimum(np.floor((lon + 180) / 6), 59) * 6 - 177
            for meridian in np.unique(meridians):
                here = np.flatnonzero((meridians == meridian) & (np.abs(lat) <= 84))
                some, tree = plane(float(meridian))
                if len(here) and len(some):
                    found, d2 = tree.nearest(project(lat[here], lon[here], meridian))
                    hit = d2 <= PLANE_M * PLANE_M
                    best[here[hit]], dist[here[hit]], on_plane[here[hit]] = some[found[hit]], np.sqrt(d2[hit]), True
            far = np.flatnonzero(~on_plane)
            if len(far):
                best[far], d2 = globe.nearest(vectors(lat[far], lon[far]))
                dist[far] = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(np.sqrt(d2) / 2, 1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[best]), pa.array(on_plane), pa.array(dist)], [batch.schema.names[0], "node_id", "plane", "dist"])

    return search


def greedy_order(stops: list[tuple[str, float, float]]) -> list[str]:
    """Visiting order of a few stops (a day's list): the northmost first, then always
    the nearest left by squared degrees, ties in the order given."""
    left = list(stops)
    if not left:
        return []
    here = max(left, key=lambda s: s[1])
    out = []
    while True:
        left.remove(here)
        out.append(here[0])
        if not left:
            return out
        here = min(left, key=lambda s, h=here: (s[1] - h[1]) ** 2 + (s[2] - h[2]) ** 2)


def newest_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    window = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
