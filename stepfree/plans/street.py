"""Queries over images, detections and the street network, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.functions import geo, tags as T
from stepfree.functions.geo import EARTH_RADIUS_M
from stepfree.functions.labels import BARRIER_WEIGHT, CLASS_OF_KEY, CLASSES, EVIDENCE_OF_KEY, output_class
from stepfree.functions.polygon import shoelace_area, valid_points
from stepfree.functions.stats import fixed
from stepfree.functions.text import class_key
from stepfree.functions.vision import MOST_RAMP_PCT, ramp_compliance
from stepfree.operators import audit
from stepfree.operators import detections as D
from stepfree.operators import images as I
from stepfree.operators import network as N
from stepfree.operators.components import connected_components
from stepfree.session import cut, table

FRAME_W, FRAME_H = 1024.0, 768.0
BOX = (-61.43, -23.32, -61.41, -23.30)
CITY = "ombrel alto"
# fixed values: addresses of the public map service that a place in the list is opened with
LINKS = {"map_url": "https://www.google.com/maps/search/?api=1&query=", "view_url": "https://www.google.com/maps/@?api=1&map_action=pano&viewpoint="}
DISCOUNTS, PENALTIES = [0.7, 0.8, 0.9], [15.0, 25.0, 40.0]


_DELIVERY = ("ingested_at", "image_path", "captured_at")


def images(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The first delivery of each image; only the given columns are read and kept."""
    rows = table(spark, sf, "manifest")
    if columns:
        rows = rows.select(*dict.fromkeys(("image_id", *columns, *_DELIVERY)))
    return I.first_delivery(rows, "image_id", *_DELIVERY)


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """Images with a usable position, one row each."""
    rows = images(spark, sf, "latitude", "longitude", "compass_angle", "captured_at")
    return rows.where(geo.usable(F.col("latitude"), F.col("longitude")))


def dets(spark: SparkSession, sf: str) -> DataFrame:
    return D.clean(table(spark, sf, "detections"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return N.clean_edges(table(spark, sf, "edges_raw"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nodes")


def snapped(spark: SparkSession, sf: str) -> DataFrame:
    return N.snap(placed(spark, sf).select("image_id", "latitude", "longitude"), edges(spark, sf), nodes(spark, sf))


def mirrored(spark: SparkSession, sf: str) -> DataFrame:
    return N.mirror(snapped(spark, sf), edges(spark, sf))


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return N.image_evidence(mirrored(spark, sf), dets(spark, sf))


def from_map(spark: SparkSession, sf: str) -> DataFrame:
    return N.map_evidence(edges(spark, sf), nodes(spark, sf))


def fused(spark: SparkSession, sf: str) -> DataFrame:
    return N.fuse(edges(spark, sf), from_map(spark, sf), evidence(spark, sf))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return N.latest_labels(table(spark, sf, "seg_labels"))


def validated(spark: SparkSession, sf: str) -> DataFrame:
    """Fused edges with their labels. The edges are cleaned once, for tags, snapping, twins and
    the rest, and what was found is written before it is joined: in one plan the driver would
    hold all of it, and describe it anew after each stage. Copies of a detection show nothing
    that the first does not, so detections are folded per image and not shuffled one by one."""
    own = ["length", "grade", "grade_abs"]
    known = cut(N.map_evidence(edges(spark, sf), nodes(spark, sf), *own))
    near = cut(N.snap(placed(spark, sf).select("image_id", "latitude", "longitude"), known, nodes(spark, sf)))
    seen = cut(N.image_evidence(N.mirror(near, known), D.valid(table(spark, sf, "detections"))))
    return N.apply_labels(N.fuse(known, known.drop(*own), seen), labels(spark, sf))


def costed(spark: SparkSession, sf: str) -> DataFrame:
    return N.condition_edges(validated(spark, sf))


def work(spark: SparkSession, sf: str) -> DataFrame:
    return N.worklist(mirrored(spark, sf), dets(spark, sf))


def image_flatten(spark: SparkSession, sf: str) -> DataFrame:
    number = {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("compass_angle", "longitude", "latitude")}
    raw = images(spark, sf).withColumns(number).select(
        F.to_json(
            F.struct(
                F.col("image_id").alias("id"), "compass_angle", F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
                F.col("image_path").alias("thumb_1024_url"),
            )
        ).alias("json")
    )
    flat = I.flatten_raw(raw, "json", "somewhere")
    return flat.groupBy("city").agg(
        F.count(F.lit(1)).alias("n"), F.count("compass_angle").alias("n_heading"), F.count(F.when(geo.usable(F.col("latitude"), F.col("longitude")), 1)).alias("n_usable")
    )


def csv_alias_required(spark: SparkSession, sf: str) -> DataFrame:
    return images(spark, sf, "city", "split").select("image_id", I.required("city", "split", "image_id").alias("place"))


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    t = I.tiles(spark, *BOX)
    return t.select("tile", *[fixed(F.col(c), 9).alias(c) for c in ("west", "south", "east", "north")])


def label_remap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "detections").select(class_key(F.col("class_name")).alias("key"), output_class(F.col("class_name")).alias("out"))
    return rows.groupBy("key", "out").agg(F.count(F.lit(1)).alias("n"))


def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "detections").select("det_id", shoelace_area(valid_points(F.col("polygon_xy"))).alias("area"))
    return rows.groupBy("det_id").agg(F.max("area").alias("area"))


def width_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return D.width_pairs(dets(spark, sf), FRAME_H)


def crop_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = dets(spark, sf).where("class_key = 'curb-cut'")
    return rows.select("det_id", *[c.alias(n) for n, c in D.crop_window(F.col("points"), FRAME_W, FRAME_H).items()])


def edge_grades(spark: SparkSession, sf: str) -> DataFrame:
    g = N.grades(edges(spark, sf), nodes(spark, sf))
    return g.select("u", "v", "k", fixed(F.col("grade")).alias("grade"), fixed(F.col("grade_abs")).alias("grade_abs"))


def nearest_edge_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return snapped(spark, sf).select("image_id", "u", "v", "k", fixed(F.col("dist"), 3).alias("dist"))


def twin_mirror(spark: SparkSession, sf: str) -> DataFrame:
    return mirrored(spark, sf).groupBy("u", "v", "k").agg(F.count(F.lit(1)).alias("n_images"))


def fused_edges(spark: SparkSession, sf: str) -> DataFrame:
    return fused(spark, sf).drop("length", "grade", "grade_abs")


def label_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = work(spark, sf).select("segment_id", "attribute").join(labels(spark, sf), ["segment_id", "attribute"], "left")
    kinds = ["present", "absent", "uncertain"]
    v = F.coalesce("verdict", F.lit("unlabelled"))
    return rows.groupBy("attribute").agg(*[F.count(F.when(v == k, 1)).alias(f"n_{k}") for k in [*kinds, "unlabelled"]])


def worklist_max(spark: SparkSession, sf: str) -> DataFrame:
    return work(spark, sf)


def nearest_node(spark: SparkSession, sf: str) -> DataFrame:
    near = N.nearest_node(placed(spark, sf), nodes(spark, sf), "image_id", "latitude", "longitude")
    return near.select("image_id", "node_id", fixed(F.col("dist"), 3).alias("dist"))


def condition_cost(spark: SparkSession, sf: str) -> DataFrame:
    c = costed(spark, sf)
    return c.select("condition", "u", "v", "k", "ramp_present", "ramp_present_imputed", "fixed_obstacle_present", fixed(F.col("cost")).alias("cost"))


def weight_grid_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.condition_edges(validated(spark, sf), DISCOUNTS, PENALTIES)
    total = F.sum(F.floor(F.col("cost") * 1e6 + 0.5).cast("bigint"))
    return rows.groupBy("condition", "cfg_id").agg(F.count(F.lit(1)).alias("n"), (total / 1e6).alias("total"))


def parallel_edge_min(spark: SparkSession, sf: str) -> DataFrame:
    return N.parallel_min(costed(spark, sf)).select("condition", "u", "v", "k", fixed(F.col("cost")).alias("cost"))


def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    return connected_components(edges(spark, sf).select("u", "v"))


def utm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    at = geo.add_projection(placed(spark, sf).select("image_id", "latitude", "longitude"), "latitude", "longitude")
    back = spark.sql(geo.unprojected("{at}", "east", "north", "zone"), at=at)
    return back.select("image_id", "zone", fixed(F.col("east"), 3).alias("east"), fixed(F.col("north"), 3).alias("north"), fixed(F.col("lat"), 6).alias("lat"), fixed(F.col("lon"), 6).alias("lon"))


def place_bounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = images(spark, sf, "city", "latitude", "longitude").withColumn("town", F.lower(F.trim("city"))).where("town <> ''")
    return audit.bounds(rows, "latitude", "longitude", ["town"])


def images_with_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return placed(spark, sf).join(dets(spark, sf), "image_id", "left_semi").select("image_id")


def edge_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Widths and slopes seen along edges; the slope table is the image's heading
    read as a percentage, as there is no raster of the towns."""
    slopes = images(spark, sf, "compass_angle").select("image_id", (F.col("compass_angle") / 10).alias("slope"))
    done = N.edge_geometry(mirrored(spark, sf), N.picture_geometry(images(spark, sf, "image_id"), dets(spark, sf), FRAME_H, slopes))
    return done.withColumn("ramp_compliance", ramp_compliance(F.col("ramp_declivity_pct")))


def label_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.value_audit(table(spark, sf, "seg_labels"), ["attribute", "verdict"])


def field_list(spark: SparkSession, sf: str) -> DataFrame:
    """The worklist with its label and the place to go to; segments without a place have nulls."""
    at = N.segment_midpoints(edges(spark, sf), nodes(spark, sf))
    rows = work(spark, sf).join(labels(spark, sf), ["segment_id", "attribute"], "left").join(at, "segment_id", "left")
    spot = F.concat_ws(",", *[fixed(F.col(c), 6).cast("decimal(12,6)").cast("string") for c in ("lat", "lon")])
    links = [F.when(F.col("lat").isNotNull(), F.concat(F.lit(start), spot)).otherwise("").alias(name) for name, start in LINKS.items()]
    return rows.select("segment_id", "attribute", "image_id", F.coalesce("verdict", F.lit("")).alias("verdict"), fixed(F.col("lat"), 6).alias("lat"), fixed(F.col("lon"), 6).alias("lon"), *links)


QUERIES = {
    "place_bounds": place_bounds,
    "images_with_predictions": images_with_predictions,
    "edge_geometry": edge_geometry,
    "label_audit": label_audit,
    "field_list": field_list,
    "image_dedupe": lambda s, d: images(s, d).select("image_id", "image_path", "captured_at", "split"),
    "image_flatten": image_flatten,
    "csv_alias_required": csv_alias_required,
    "tile_grid": tile_grid,
    "bbox_filter": lambda s, d: I.in_box(images(s, d, "latitude", "longitude"), "latitude", "longitude", *BOX).select("image_id", "latitude", "longitude"),
    "city_filter": lambda s, d: I.in_city(images(s, d, "city"), CITY).select("image_id", "city"),
    "hash_split": lambda s, d: images(s, d, "image_id").select("image_id", I.hash_split(F.col("image_id"), 0.85).alias("part")),
    "shard_manifest": lambda s, d: I.shards(images(s, d, "image_id").select("image_id", I.hash_split(F.col("image_id"), 0.85).alias("part")), "image_id", "part", 500),
    "downselect_topk": lambda s, d: I.downselect(images(s, d)).select("image_id", "zone", "quadrant"),
    "utm_round_trip": utm_round_trip,
    "label_remap": label_remap,
    "polygon_area": polygon_area,
    "class_area_filter": lambda s, d: D.mapped(dets(s, d)).select("det_id", "image_id", "class_key", "area"),
    "barrier_score": lambda s, d: D.barrier_scores(dets(s, d)),
    "width_estimates": width_estimates,
    "width_confusion": lambda s, d: D.width_confusion(width_estimates(s, d)),
    "width_agreement": lambda s, d: D.agreement(width_estimates(s, d)),
    "smallest_detections": lambda s, d: D.smallest(dets(s, d), "curb-cut", 10),
    "review_sample": lambda s, d: D.review_sample(dets(s, d), 1234, "curb-cut", 30),
    "crop_windows": crop_windows,
    "tag_coverage": lambda s, d: N.tag_coverage(edges(s, d)),
    "canonical_tags": from_map,
    "edge_grades": edge_grades,
    "nearest_edge_cutoff": nearest_edge_cutoff,
    "twin_mirror": twin_mirror,
    "edge_evidence": evidence,
    "fused_edges": fused_edges,
    "imputation_rate": lambda s, d: N.imputation_rate(fused(s, d)),
    "label_upsert": labels,
    "label_status": label_status,
    "apply_labels": lambda s, d: N.apply_labels(edges(s, d).select("u", "v", "k"), labels(s, d)),
    "worklist_max": worklist_max,
    "worklist_unlabelled": lambda s, d: N.unlabelled(work(s, d), labels(s, d)).select("segment_id", "attribute", "det_id"),
    "segment_midpoints": lambda s, d: N.segment_midpoints(edges(s, d), nodes(s, d)),
    "nearest_node": nearest_node,
    "condition_cost": condition_cost,
    "weight_grid_cost": weight_grid_cost,
    "guard_violations": lambda s, d: N.guard_violations(costed(s, d)),
    "parallel_edge_min": parallel_edge_min,
    "weak_components": weak_components,
}

# --- the same in SQL ---------------------------------------------------------------

_USABLE = (
    "latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude) "
    "and abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0)"
)
_IMAGES = """images as (
  select * exclude (rn) from (select *, row_number() over (partition by image_id
    order by ingested_at nulls last, image_path nulls last, captured_at nulls last) as rn
    from manifest where image_id is not null and trim(image_id) <> '') where rn = 1)"""
_PLACED = f"{_IMAGES}, placed as (select * from images where {_USABLE})"
_AREA = """case when len(points) < 3 then 0.0::double else abs(list_sum(list_transform(range(1, len(points) + 1),
  lambda i: points[i][1] * points[i % len(points) + 1][2] - points[i % len(points) + 1][1] * points[i][2]))) / 2 end"""
_KEY_OF = "regexp_replace(regexp_replace(lower(trim(class_name, ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_DETS = f"""dets as (
  select *, {_AREA} as area from (
    select distinct on (det_id) det_id, trim(image_id, ' ') as image_id, class_name, {_KEY_OF} as class_key, confidence,
           list_filter(polygon_xy, lambda p: len(p) = 2) as points
    from detections where confidence > 0 and not isnan(confidence))
  where image_id <> '' and class_key <> '' and len(points) > 0)"""
_EDGES = """edges as (
  select distinct on (u, v, k) * from edges_raw where u is not null and v is not null and k is not null and length >= 0 and not isnan(length))"""


def _case(column: str, mapping: dict, quote: bool = True) -> str:
    arms = " ".join(f"when '{k}' then " + (f"'{v}'" if quote else repr(v)) for k, v in mapping.items())
    return f"case {column} {arms} end"


def _fix(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits} + 0.0"


def _rank(values: str, table_: dict[str, str], order: list[str]) -> str:
    ranks = {k: order.index(t) for k, t in table_.items()}
    return f"(['" + "', '".join(order) + f"'])[list_min(list_transform({values}, lambda s: {_case('s', ranks, False)})) + 1]"


def _tag(owner: str, name: str) -> str:
    return f"(case when len({owner}['{name}']) > 0 then {owner}['{name}'] end)"


def _first(name: str) -> str:
    return f"coalesce({_tag('tags', name)}, {_tag('ut', name)}, {_tag('vt', name)})"


_BENIGN = "[" + ", ".join(f"'{b}'" for b in T.BENIGN_HIGHWAYS) + "]"
_WIDTH = "case when {w} < 0.5 then 'under_50cm' when {w} < 0.9 then '50_to_90cm' when {w} is not null then 'over_90cm' end"
_MAP = f"""map_evidence as (
  select u, v, k,
    case when list_contains({_first('tactile_paving')}, 'no') then 'absent' when list_contains({_first('tactile_paving')}, 'yes') then 'present' end as tactile_paving_present,
    case when list_contains({_tag('tags', 'handrail')}, 'no') then 'absent' when list_contains({_tag('tags', 'handrail')}, 'yes') then 'present' end as handrail_present,
    case when list_contains({_first('kerb')}, 'raised') then 'absent' when list_has_any({_first('kerb')}, ['lowered', 'flush']) then 'present' end as ramp_present,
    case when {_first('crossing')} is not null then 'present' end as marked_crossing_present,
    case when list_contains({_tag('tags', 'highway')}, 'steps') then 'present'
         when len(list_filter({_tag('tags', 'highway')}, lambda h: not list_contains({_BENIGN}, h))) = 0 then 'absent' end as steps_present,
    case when {_first('barrier')} is not null then 'present' end as fixed_obstacle_present,
    {_rank(_tag('tags', 'surface'), T.SURFACE_TIER, T.TIERS)} as surface_material_tier,
    {_rank(_tag('tags', 'smoothness'), T.SMOOTHNESS_TIER, T.TIERS)} as smoothness_tier,
    {_WIDTH.format(w="list_min(list_transform(" + _tag('tags', 'width') + ", lambda s: try_cast(s as double)))")} as width_bucket
  from (select e.*, a.tags as ut, b.tags as vt from edges e left join nodes a on a.node_id = e.u left join nodes b on b.node_id = e.v))"""
_MERIDIAN = geo.zone_meridian("longitude")
_SNAP = f"""im as (select *, {_MERIDIAN} as zone from ({geo.projected("placed", "latitude", "longitude", _MERIDIAN)})),
  ends as (select e.u, e.v, e.k, a.x as xu, a.y as yu, b.x as xv, b.y as yv, unnest(list_distinct([{", ".join(N.zones_of_ends("a.x", "a.y", "b.x", "b.y"))}])) as zone
    from edges e join nodes a on a.node_id = e.u join nodes b on b.node_id = e.v),
  eu as (select u, v, k, zone, xv, yv, east as eu, north as nu from ({geo.projected("ends", "yu", "xu", "zone")})),
  ev as (select u, v, k, zone, eu, nu, east as ev, north as nv from ({geo.projected("eu", "yv", "xv", "zone")})),
  lines as (
    select u, v, k, zone, case when u > v then ev else eu end as x0, case when u > v then nv else nu end as y0, case when u > v then eu else ev end as x1, case when u > v then nu else nv end as y1 from ev),
  cand as (
    select image_id, u, v, k, east, north, x0, y0, x1, y1, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as l2
    from im join lines on im.zone = lines.zone and east between least(x0, x1) - 26 and greatest(x0, x1) + 26 and north between least(y0, y1) - 26 and greatest(y0, y1) + 26),
  par as (select *, case when l2 > 0 then greatest(0.0, least(1.0, ((east - x0) * (x1 - x0) + (north - y0) * (y1 - y0)) / l2)) else 0 end as t from cand),
  dd as (select image_id, u, v, k, sqrt(pow(east - (x0 + t * (x1 - x0)), 2) + pow(north - (y0 + t * (y1 - y0)), 2)) as dist from par),
  snapped as (select * exclude (rn) from (select *, row_number() over (partition by image_id order by dist, u, v, k) as rn from dd where dist <= 25) where rn = 1),
  mirrored as (
    select image_id, u, v, k from snapped union all
    select s.image_id, e.u, e.v, e.k from snapped s join edges e on e.u = s.v and e.v = s.u and e.k = s.k where s.u <> s.v)"""
_EVIDENCE = f"""per_image as (
    select image_id, max(case when a = 'ramp_present' then 'present' end) as ramp_present,
           max(case when a = 'marked_crossing_present' then 'present' end) as marked_crossing_present,
           max(case when a = 'fixed_obstacle_present' then 'present' end) as fixed_obstacle_present
    from (select image_id, {_case('class_key', EVIDENCE_OF_KEY)} as a from dets) group by image_id),
  evidence as (
    select u, v, k, max(ramp_present) as ramp_present, max(marked_crossing_present) as marked_crossing_present,
           max(fixed_obstacle_present) as fixed_obstacle_present, count(*) as n_images
    from mirrored join per_image using (image_id) group by u, v, k)"""


def _fused_columns() -> str:
    out = []
    for a, default in N.DEFAULTS.items():
        seen = f"i.{a}" if a in ("ramp_present", "marked_crossing_present", "fixed_obstacle_present") else "null::varchar"
        known = f"coalesce(m.{a}, {seen})"
        missing = f"({known} is null or {known} = 'unknown')"
        out += [
            f"case when {missing} then '{default}' else {known} end as {a}", f"{missing} as {a}_imputed",
            f"case when m.{a} is not null then 'osm' when {seen} is not null then 'imagery' end as {a}_source",
        ]
    return ", ".join(out)


_ALL = f"{_PLACED}, {_DETS}, {_EDGES}, {_MAP}, {_SNAP}, {_EVIDENCE}"
_FUSED = f"""fused as (
  select e.u, e.v, e.k, e.length, e.grade_abs, {_fused_columns()}, coalesce(i.n_images, 0) as n_images_observed
  from edges e left join map_evidence m using (u, v, k) left join evidence i using (u, v, k))"""
_SEG = "least({u}::varchar, {v}::varchar) || '_' || greatest({u}::varchar, {v}::varchar) || '_' || {k}::varchar"
_LABELS = f"""labels as (
  select segment_id, attribute, verdict, note from (
    select *, row_number() over (partition by segment_id, attribute order by labelled_at desc, verdict desc, note desc) as rn from (
      select {_SEG.format(u="p[1]", v="p[2]", k="p[3]")} as segment_id, attribute, labelled_at, lower(trim(verdict, ' ')) as verdict, coalesce(note, '') as note
      from (select *, string_split(segment_id, '_') as p from seg_labels) where len(p) = 3 and trim(verdict, ' ') <> '' and attribute is not null))
  where rn = 1)"""
_WIDE = """wide as (
  select segment_id, max(case when attribute = 'ramp_present' then verdict end) as ramp_v, max(case when attribute = 'fixed_obstacle_present' then verdict end) as stop_v
  from labels where verdict in ('present', 'absent') group by segment_id)"""
_SLOPE = """case when g <= 0.03 then 1.0 when g <= 0.0833 then 1 + (g - 0.03) / (0.0833 - 0.03) * (1.5 - 1) else least(1.5 + 8.0 * (g - 0.0833), 2.3) end"""


def _costed(grid: str, protect: bool = True) -> str:
    surface, ramp = "(case surface_material_tier when 'good' then 1.0 when 'poor' then 1.4 else 1.15 end)::double", "(case when ramp_present = 'present' and ramp_present_imputed = false then discount else 1.0 end)::double"
    travel = f"length * {surface} * ({ramp} + ({_SLOPE})::double - 1)" if protect else f"{ramp} * length * {surface} * ({_SLOPE})::double"
    return f"""{_ALL}, {_FUSED}, {_LABELS}, {_WIDE}, conds as (
      select unnest(['baseline', 'full_validated', 'full_raw', 'ramp_only', 'obstacle_only']) as condition,
             unnest(['baseline', 'validated', 'raw', 'validated', 'baseline']) as r, unnest(['baseline', 'validated', 'raw', 'baseline', 'validated']) as o),
    grid as ({grid}),
    rows_ as (
      select condition, cfg_id, discount, penalty, u, v, k, length, steps_present, surface_material_tier, coalesce(grade_abs, 0) as g,
             case r when 'raw' then ramp_present when 'validated' then coalesce(ramp_v, 'absent') else 'absent' end as ramp_present,
             case r when 'raw' then ramp_present_imputed when 'validated' then ramp_v is null else true end as ramp_present_imputed,
             case o when 'raw' then fixed_obstacle_present when 'validated' then coalesce(stop_v, 'unknown') else 'unknown' end as fixed_obstacle_present
      from fused left join wide on wide.segment_id = {_SEG.format(u="u", v="v", k="k")}, conds, grid),
    costed as (
      select *, {travel}
                + (case when fixed_obstacle_present = 'present' then penalty else 0 end)::double
                + (case when steps_present = 'present' then 500 else 0 end)::double as cost
      from rows_)"""


_ONE = "select 0 as cfg_id, 0.8::double as discount, 25.0::double as penalty"
_NINE = "select (i * 3 + j)::integer as cfg_id, ([0.7, 0.8, 0.9])[i + 1]::double as discount, ([15.0, 25.0, 40.0])[j + 1]::double as penalty from range(3) a(i), range(3) b(j)"
_W, _S, _E, _N = (f"{x!r}::double" for x in BOX)
_COVER = ", ".join(f"'{t}'" for t in T.WAY_TAGS)
_SCORE = " ".join(f"when '{c}' then {w!r}" for c, w in BARRIER_WEIGHT.items())
_XS, _YS = "list_transform({p}, lambda q: q[1])", "list_transform({p}, lambda q: q[2])"
_FOCAL = "((768.0::double / 2) / tan(radians(65.0::double) / 2))"
_WIDTHS = f"""pairs0 as (
    select image_id, arg_min(case when class_key = 'sidewalk' then points end, case when class_key = 'sidewalk' then det_id end) as s,
           arg_min(case when class_key = 'curb' then points end, case when class_key = 'curb' then det_id end) as c
    from dets where class_key in ('sidewalk', 'curb') group by image_id),
  pairs1 as (
    select *, case when len(near) >= 2 then near else s end as band from (
      select *, list_filter(s, lambda q: low - q[2] <= greatest(2.0, 768.0 * 0.02)) as near from (
        select *, list_max({_YS.format(p="s")}) as low from pairs0 where s is not null and c is not null))),
  pairs2 as (
    select *, list_max({_XS.format(p="band")}) - list_min({_XS.format(p="band")}) as px,
           list_max({_YS.format(p="c")}) - list_min({_YS.format(p="c")}) as kpx, atan((low - 768.0::double / 2) / {_FOCAL}) as angle from pairs1),
  pairs3 as (
    select image_id, case when len(s) >= 3 and angle > 0 then px * (1.5::double / tan(angle) / {_FOCAL}) end as w1,
           case when kpx >= 2 then px * (0.15::double / kpx) end as w2 from pairs2),
  width_pairs as (select image_id, {_WIDTH.format(w="w1")} as pinhole, {_WIDTH.format(w="w2")} as kerb from pairs3)"""
_WORK = f"""work as (
  select {_SEG.format(u="u", v="v", k="k")} as segment_id, a as attribute, image_id, det_id, area from mirrored join (
    select image_id, det_id, area, {_case('class_key', EVIDENCE_OF_KEY)} as a from dets) using (image_id)
  where a in ('ramp_present', 'fixed_obstacle_present')),
  worklist as (
    select segment_id, attribute, arg_max(image_id, (area, -det_id)) as image_id, arg_max(det_id, (area, -det_id)) as det_id, max(area) as area,
           count(*) as n_detections, count(distinct image_id) as n_images from work group by segment_id, attribute)"""

ORACLE = {
    "place_bounds": f"""with {_PLACED} select lower(trim(city, ' ')) as town, min(longitude) as west, min(latitude) as south, max(longitude) as east, max(latitude) as north
        from placed where trim(city, ' ') <> '' group by 1""",
    "images_with_predictions": f"with {_PLACED}, {_DETS} select image_id from placed p where exists (select 1 from dets d where d.image_id = p.image_id)",
    "edge_geometry": f"""with {_PLACED}, {_DETS}, {_EDGES}, {_SNAP},
        m as (select *, list_max({_YS.format(p="points")}) as low from dets),
        b as (select *, list_filter(points, lambda q: low - q[2] <= greatest(2.0, 768.0 * 0.02)) as near, atan((low - 768.0::double / 2) / {_FOCAL}) as angle from m),
        w as (select image_id, class_key, case when class_key in ('sidewalk', 'pedestrian-area') and len(points) >= 3 and angle > 0 then
              (list_max({_XS.format(p="(case when len(near) >= 2 then near else points end)")}) - list_min({_XS.format(p="(case when len(near) >= 2 then near else points end)")}))
              * (1.5::double / tan(angle) / {_FOCAL}) end as width from b),
        i as (select image_id, min(case when width < 0.5 then 0 when width < 0.9 then 1 when width is not null then 2 end) as w, max((class_key = 'curb-cut')::int) as ramp from w group by image_id),
        g as (select image_id, w, case when ramp = 1 then floor(compass_angle / 10 * 100 + 0.5) / 100 end as s from i join images using (image_id)),
        e as (select u, v, k, min(w) as w, max(s) as s from mirrored join g using (image_id) group by u, v, k)
        select u, v, k, case w when 0 then 'under_50cm' when 1 then '50_to_90cm' when 2 then 'over_90cm' end as width_bucket_uncalibrated_estimate, s as ramp_declivity_pct,
          case when s <= {MOST_RAMP_PCT} then 'compliant' when s is not null then 'excessive' end as ramp_compliance from e""",
    "label_audit": " union all ".join(
        f"""select '{c}' as "column", count(*) as n, count(*) filter (where {c} is null) as n_null, count(distinct {c}) as n_different,
        (select string_agg(x, ';' order by x) from (select distinct {c} as x from seg_labels where {c} is not null order by x limit 20)) as first_values from seg_labels"""
        for c in ("attribute", "verdict")
    ),
    "field_list": f"""with {_PLACED}, {_DETS}, {_EDGES}, {_SNAP}, {_WORK}, {_LABELS}, at_mid as (
          select {_SEG.format(u="u", v="v", k="k")} as segment_id, min((a.y + b.y, a.x + b.x))[1] / 2 as lat, min((a.y + b.y, a.x + b.x))[2] / 2 as lon
          from edges e left join nodes a on a.node_id = e.u left join nodes b on b.node_id = e.v group by 1)
        select w.segment_id, w.attribute, w.image_id, coalesce(l.verdict, '') as verdict, {_fix("lat")} as lat, {_fix("lon")} as lon, {", ".join(f"case when lat is not null then '{start}' || ({_fix('lat')})::decimal(12,6)::varchar || ',' || ({_fix('lon')})::decimal(12,6)::varchar else '' end as {name}" for name, start in LINKS.items())}
        from worklist w left join labels l using (segment_id, attribute) left join at_mid using (segment_id)""",
    "image_dedupe": f"with {_IMAGES} select image_id, image_path, captured_at, split from images",
    "image_flatten": f"""with {_IMAGES} select 'somewhere' as city, count(*) as n, count(case when not isnan(compass_angle) then 1 end) as n_heading, count(case when {_USABLE} then 1 end) as n_usable
        from images where image_path is not null and image_path <> ''""",
    "csv_alias_required": f"with {_IMAGES} select image_id, coalesce(nullif(trim(city, ' '), ''), nullif(trim(split, ' '), ''), nullif(trim(image_id, ' '), '')) as place from images",
    "tile_grid": f"""with n as (select ceil(({_E} - {_W})::double / 0.004::double)::bigint as nx, ceil(({_N} - {_S})::double / 0.004::double)::bigint as ny),
        t as (select nx, ny, i, j from n, range(100) a(i), range(100) b(j) where i < nx and j < ny)
        select i + nx * j as tile, {_fix(f"{_W} + i * (({_E} - {_W})::double / nx)", 9)} as west, {_fix(f"{_S} + j * (({_N} - {_S})::double / ny)", 9)} as south,
        {_fix(f"{_W} + (i + 1) * (({_E} - {_W})::double / nx)", 9)} as east, {_fix(f"{_S} + (j + 1) * (({_N} - {_S})::double / ny)", 9)} as north from t""",
    "bbox_filter": f"with {_IMAGES} select image_id, latitude, longitude from images where latitude between {_S} and {_N} and longitude between {_W} and {_E}",
    "city_filter": f"with {_IMAGES} select image_id, city from images where lower(trim(city, ' ')) = '{CITY}'",
    "hash_split": f"""with {_IMAGES} select image_id, case when ('0x' || substr(sha256(image_id), 1, 8))::bigint / 4294967295.0::double < 0.85 then 'train' else 'val' end as part from images""",
    "shard_manifest": f"""with {_IMAGES}, parts as (select image_id, case when ('0x' || substr(sha256(image_id), 1, 8))::bigint / 4294967295.0::double < 0.85 then 'train' else 'val' end as part from images)
        select image_id, part, shard::integer as shard, format('{{}}_shard_{{:04d}}.json', part, shard::integer) as shard_name
        from (select *, floor((row_number() over (partition by part order by md5(image_id)) - 1) / 500) as shard from parts)""",
    "downselect_topk": f"""with {_PLACED}, im as (select *, {_MERIDIAN} as zone from ({geo.projected("placed", "latitude", "longitude", _MERIDIAN)})),
        h as (select *, case when compass_angle is null or isnan(compass_angle) then 0.0 else compass_angle end as hd from im),
        q as (select *, least(floor((hd - 360.0 * floor(hd / 360.0)) / 90.0), 3)::bigint as quadrant from h)
        select image_id, zone::integer as zone, quadrant from (select *, row_number() over (partition by zone, floor(east / 20), floor(north / 20), quadrant
          order by coalesce(captured_at, 'None') desc, image_id) as rn from q) where rn <= 1""",
    "utm_round_trip": f"""with {_PLACED}, im as (select image_id, {_MERIDIAN} as zone, east, north from ({geo.projected("placed", "latitude", "longitude", _MERIDIAN)}))
        select image_id, zone::integer as zone, {_fix("east", 3)} as east, {_fix("north", 3)} as north, {_fix("lat")} as lat, {_fix("lon")} as lon
        from ({geo.unprojected("im", "east", "north", "zone")})""",
    "label_remap": f"select {_KEY_OF} as key, {_case(_KEY_OF, CLASS_OF_KEY)} as out, count(*) as n from detections group by all",
    "polygon_area": f"select det_id, max({_AREA}) as area from (select det_id, list_filter(polygon_xy, lambda p: len(p) = 2) as points from detections) group by det_id".replace(
        "case when len(points) < 3", "case when points is null then null when len(points) < 3"
    ),
    "class_area_filter": f"with {_DETS} select det_id, image_id, class_key, area from dets where {_case('class_key', CLASS_OF_KEY)} is not null and area >= 50 and len(points) >= 3",
    "barrier_score": f"""with {_DETS}, r as (select image_id, case when confidence >= 0.3 then {_case('class_key', CLASS_OF_KEY)} end as c, confidence, area from dets)
        select image_id, {", ".join(f"sum(case when c = '{c}' then 1 else 0 end)::bigint as n_{c}" for c in CLASSES)},
        coalesce(sum(floor(least(area / 921600.0::double, 1.0::double) * confidence * (case c {_SCORE} end)::double * 1e9 + 0.5)::bigint), 0)::bigint / 1e9 as score from r group by image_id""",
    "width_estimates": f"with {_DETS}, {_WIDTHS} select * from width_pairs",
    "width_confusion": f"""with {_DETS}, {_WIDTHS}, b as (select unnest(['under_50cm', '50_to_90cm', 'over_90cm']) as w)
        select x.w as pinhole, y.w as kerb, count(p.image_id) as n from b x cross join b y left join width_pairs p on p.pinhole = x.w and p.kerb = y.w group by 1, 2""",
    "width_agreement": f"""with {_DETS}, {_WIDTHS}, t as (
          select count(*) as eligible, count(*) filter (where pinhole is not null and kerb is not null) as compared, count(*) filter (where pinhole = kerb) as same from width_pairs),
        m as (select sum(a.n * b.n) as chance from (select pinhole as w, count(*) as n from width_pairs where pinhole is not null and kerb is not null group by 1) a
          join (select kerb as w, count(*) as n from width_pairs where pinhole is not null and kerb is not null group by 1) b using (w))
        select eligible, compared, floor(same / compared * 1000 + 0.5) / 10 as agree_pct,
               floor((same / compared - chance / (compared * compared)) / (1 - chance / (compared * compared)) * 1e6 + 0.5) / 1e6 as kappa from t, m""",
    "smallest_detections": f"with {_DETS} select det_id, image_id, area from dets where class_key = 'curb-cut' order by area, det_id limit 10",
    "review_sample": f"with {_DETS} select det_id, md5('1234|' || det_id::varchar) as order_key from dets where class_key = 'curb-cut' order by 2 limit 30",
    "crop_windows": f"""with {_DETS}, b as (select det_id, list_min({_XS.format(p="points")}) as x0, list_max({_XS.format(p="points")}) as x1,
          list_min({_YS.format(p="points")}) as y0, list_max({_YS.format(p="points")}) as y1 from dets where class_key = 'curb-cut'),
        q as (select *, greatest(40.0, greatest(x1 - x0, y1 - y0) * 0.5) as pad from b)
        select det_id, greatest(x0 - pad, 0) as crop_x0, greatest(y0 - pad, 0) as crop_y0, least(x1 + pad, 1024) as crop_x1, least(y1 + pad, 768) as crop_y1 from q""",
    "tag_coverage": f"""with {_EDGES}, t as (select unnest([{_COVER}]) as tag)
        select tag, floor(n * 100.0::double / total * 100 + 0.5) / 100 as pct, n from (
          select tag, count(*) filter (where len(tags[tag]) > 0) as n, count(*) as total from edges, t group by tag)""",
    "canonical_tags": f"with {_EDGES}, {_MAP} select * from map_evidence",
    "edge_grades": f"""with {_EDGES}, z as (select node_id, case when not (isnan(elevation) or abs(elevation + 9999) <= 0.09999 or elevation < 0 or elevation > 3000) then elevation end as z from nodes),
        g as (select e.u, e.v, e.k, case when length > 0 then (b.z - a.z) / length end as g from edges e left join z a on a.node_id = e.u left join z b on b.node_id = e.v)
        select u, v, k, {_fix("g")} as grade, {_fix("abs(g)")} as grade_abs from g""",
    "nearest_edge_cutoff": f"with {_PLACED}, {_EDGES}, {_SNAP} select image_id, u, v, k, {_fix('dist', 3)} as dist from snapped",
    "twin_mirror": f"with {_PLACED}, {_EDGES}, {_SNAP} select u, v, k, count(*) as n_images from mirrored group by u, v, k",
    "edge_evidence": f"with {_PLACED}, {_DETS}, {_EDGES}, {_SNAP}, {_EVIDENCE} select * from evidence",
    "fused_edges": f"with {_ALL}, {_FUSED} select * exclude (length, grade_abs) from fused",
    "imputation_rate": f"with {_ALL}, {_FUSED} " + " union all ".join(
        f"select '{a}' as attribute, floor(sum({a}_imputed::int) * 100.0::double / count(*) * 100 + 0.5) / 100 as pct from fused" for a in N.DEFAULTS
    ),
    "label_upsert": f"with {_LABELS} select * from labels",
    "label_status": f"""with {_PLACED}, {_DETS}, {_EDGES}, {_SNAP}, {_WORK}, {_LABELS}
        select w.attribute, count(*) filter (where verdict = 'present') as n_present, count(*) filter (where verdict = 'absent') as n_absent,
               count(*) filter (where verdict = 'uncertain') as n_uncertain, count(*) filter (where verdict is null) as n_unlabelled
        from worklist w left join labels using (segment_id, attribute) group by w.attribute""",
    "apply_labels": f"""with {_EDGES}, {_LABELS}, {_WIDE} select u, v, k, ramp_v as ramp_present_validated_value, stop_v as fixed_obstacle_present_validated_value
        from edges left join wide on wide.segment_id = {_SEG.format(u="u", v="v", k="k")}""",
    "worklist_max": f"with {_PLACED}, {_DETS}, {_EDGES}, {_SNAP}, {_WORK} select * from worklist",
    "worklist_unlabelled": f"""with {_PLACED}, {_DETS}, {_EDGES}, {_SNAP}, {_WORK}, {_LABELS} select segment_id, attribute, det_id from worklist w
        where not exists (select 1 from labels l where l.segment_id = w.segment_id and l.attribute = w.attribute)""",
    "segment_midpoints": f"""with {_EDGES} select {_SEG.format(u="u", v="v", k="k")} as segment_id, min((a.y + b.y, a.x + b.x))[1] / 2 as lat, min((a.y + b.y, a.x + b.x))[2] / 2 as lon
        from edges e left join nodes a on a.node_id = e.u left join nodes b on b.node_id = e.v group by 1""",
    "nearest_node": f"""with {_PLACED}, far as (select image_id, node_id, latitude, longitude, y, x, {_MERIDIAN} as zone,
          2 * {EARTH_RADIUS_M}::double * asin(least(1.0, sqrt(pow(sin(radians(y - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(y)) * pow(sin(radians(x - longitude) / 2), 2)))) as arc
        from placed, nodes where node_id is not null and abs(y) <= 90 and abs(x) <= 180),
        close as (select * from far where arc <= {1.02 * N.PLANE_M + 1000} and abs(latitude) <= 84),
        a as (select image_id, node_id, east, north from ({geo.projected("close", "latitude", "longitude", "zone")})), b as (select image_id, node_id, east as e, north as n from ({geo.projected("close", "y", "x", "zone")})),
        d as (select image_id, node_id, false as off, sqrt(pow(east - e, 2) + pow(north - n, 2)) as dist from a join b using (image_id, node_id) where sqrt(pow(east - e, 2) + pow(north - n, 2)) <= {N.PLANE_M}
          union all select image_id, node_id, true, arc from far)
        select image_id, node_id, {_fix("dist", 3)} as dist from (select *, row_number() over (partition by image_id order by off, dist, node_id) as rn from d) where rn = 1""",
    "condition_cost": f"with {_costed(_ONE)} select condition, u, v, k, ramp_present, ramp_present_imputed, fixed_obstacle_present, {_fix('cost')} as cost from costed",
    "weight_grid_cost": f"with {_costed(_NINE)} select condition, cfg_id, count(*) as n, sum(floor(cost * 1e6 + 0.5)::bigint)::bigint / 1e6 as total from costed group by condition, cfg_id",
    "guard_violations": f"""with {_costed(_ONE)} select 'baseline_ramps' as guard, count(*) filter (where condition = 'baseline' and ramp_present <> 'absent') as violations from costed
        union all select 'baseline_obstacles', count(*) filter (where condition = 'baseline' and fixed_obstacle_present <> 'unknown') from costed
        union all select 'negative_costs', count(*) filter (where cost is null or cost < 0) from costed""",
    "parallel_edge_min": f"""with {_costed(_ONE)} select condition, u, v, k, {_fix('cost')} as cost from (
        select *, row_number() over (partition by condition, u, v order by cost, k) as rn from costed) where rn = 1""",
    "weak_components": f"""with recursive {_EDGES}, links as (select u as a, v as b from edges union select v, u from edges), walk as (
        select a as node, a as root from links union select links.b, walk.root from walk join links on links.a = walk.node)
        select node, min(root) as root from walk group by node""",
}
