"""Queries of the nested-record and neighbour operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.operators import nested
from stepfree.functions.geo import usable
from stepfree.operators.regions import regions_of
from stepfree.operators.spatial import near_links, near_pairs
from stepfree.session import cut, table

NEAR_M = 8.0


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return nested.parse_records(table(spark, sf, "predictions_raw"), "record_id", "payload", "received_at")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.valid_points(_records(spark, sf)).select(F.col("key").alias("record_id"), "item_pos", "det_pos", "point_pos")


def _flat(name: str):  # noqa: ANN202
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return nested.shred(cut(_records(spark, sf)), nested.PREDICTIONS)[name].withColumnRenamed("key", "record_id")

    return query


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_pairs(table(spark, sf, "manifest"), "image_id", "latitude", "longitude", NEAR_M)
    return pairs.select(F.col("id_a").alias("image_id_a"), F.col("id_b").alias("image_id_b"))


def p4_links(spark: SparkSession, sf: str) -> DataFrame:
    links = near_links(table(spark, sf, "manifest"), "image_id", "latitude", "longitude", NEAR_M)
    return links.select(F.col("id").alias("image_id"), "place_id", "n_links")


def p4_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The town octagons that hold each image: an octagon around the middle of the
    town's usable positions, as wide as six tenths of their extent."""
    rows = table(spark, sf, "manifest").where(usable(F.col("latitude"), F.col("longitude")))
    points = rows.groupBy("image_id").agg(F.min("latitude").alias("lat"), F.min("longitude").alias("lon"))
    named = rows.select(F.lower(F.trim("city")).alias("town"), "latitude", "longitude").where("town <> ''")
    box = named.groupBy("town").agg(*[f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("low", F.min), ("high", F.max))])
    middle = {c: (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2 for c in ("latitude", "longitude")}
    reach = {c: (F.col(f"high_{c}") - F.col(f"low_{c}")) * 0.3 for c in ("latitude", "longitude")}
    ring = F.array(*[F.array(middle["longitude"] + reach["longitude"] * a, middle["latitude"] + reach["latitude"] * b) for a, b in OCTAGON])
    found = regions_of(points, "image_id", "lon", "lat", box.select("town", ring.alias("ring")), "town", "ring")
    return found.select(F.col("id").alias("image_id"), F.col("region").alias("town"))


OCTAGON = ((1.0, 0.4), (0.4, 1.0), (-0.4, 1.0), (-1.0, 0.4), (-1.0, -0.4), (-0.4, -1.0), (0.4, -1.0), (1.0, -0.4))

QUERIES = {
    "p2_found": p2_found,
    "p2_records": _flat("record"),
    "p2_items": _flat("item"),
    "p2_detections": _flat("detection"),
    "p2_points": _flat("point"),
    "p2_occluders": _flat("occluder"),
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p4_regions": p4_regions,
}

_ITEMS = """
    with firsts as (
      select record_id, arg_min(payload, (received_at, payload)) as p from predictions_raw
      where payload is not null and record_id is not null group by record_id
    ), good as (select record_id, p::json as p from firsts where json_valid(p)
    ), lists as (
      select record_id, case when json_type(p) = 'ARRAY' then json_extract(p, '$[*]')
             when json_type(p, '$.items') = 'ARRAY' then json_extract(p, '$.items[*]')
             else json_extract(p, '$.shards[*].items[*]') end as l from good
    ), items as (
      select record_id, i - 1 as item_pos, l[i] as v from (select record_id, l, unnest(range(1, len(l) + 1)) as i from lists)
    )"""
_TEXT_OR_NUMBER = "('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
_NUMBERS = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
_NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"

_TREE = f"""{_ITEMS.replace("with firsts", "with recursive firsts", 1)}, dets as (
      select record_id, id || '.detection:' || (i - 1)::varchar as id, id as parent_id, 'item' as parent_table, (i - 1)::integer as pos, l[i] as v from (
        select record_id, record_id::varchar || '.item:' || item_pos::varchar as id, json_extract(v, '$.detections[*]') as l, unnest(range(1, len(l) + 1)) as i
        from items where json_type(v, '$.detections') = 'ARRAY')
      union all
      select record_id, id || '.review/detection:' || (i - 1)::varchar, id, 'detection', (i - 1)::integer, l[i] from (
        select record_id, id, json_extract(v, '$.review.detections[*]') as l, unnest(range(1, len(l) + 1)) as i
        from dets where json_type(v, '$.review.detections') = 'ARRAY')
    )"""


def _text(path: str) -> str:
    return f"case when json_type(v, '{path}') = 'VARCHAR' then json_extract_string(v, '{path}') end"


def _number(path: str) -> str:
    said = f"json_extract_string(v, '{path}')"
    return f"case when json_type(v, '{path}') in {_NUMBERS} or (json_type(v, '{path}') = 'VARCHAR' and regexp_matches({said}, '{_NUMBER}')) then try_cast({said} as double) end"


def _below(path: str, tag: str) -> str:
    """Rows of an array inside a detection."""
    return f"""select record_id, id || '.{tag}:' || (i - 1)::varchar as id, id as parent_id, 'detection' as parent_table, (i - 1)::integer as pos, l[i] as v from (
        select record_id, id, json_extract(v, '{path}[*]') as l, unnest(range(1, len(l) + 1)) as i from dets where json_type(v, '{path}') = 'ARRAY')"""


_NEAR = """
        with rows_ as (
          select image_id as id, min(struct_pack(lat := latitude, lon := longitude)) as p from manifest
          where image_id is not null and latitude is not null and longitude is not null and not isnan(latitude)
            and not isnan(longitude) and abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0)
          group by image_id
        ), v as (
          select id, cos(radians(p.lat)) * cos(radians(p.lon)) as x, cos(radians(p.lat)) * sin(radians(p.lon)) as y, sin(radians(p.lat)) as z from rows_
        ), cells as (select *, floor(x * 700000)::bigint as cx, floor(y * 700000)::bigint as cy, floor(z * 700000)::bigint as cz from v
        ), around as (
          select id, x, y, z, cx + dx as cx, cy + dy as cy, cz + dz as cz from cells,
            (select unnest([-1, 0, 1]) as dx), (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dz)
        ), pairs as (
        select a.id as image_id_a, b.id as image_id_b from cells a join around b using (cx, cy, cz)
        where a.id < b.id and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= pow(2 * sin(8.0 / 6371008.8 / 2), 2))"""

ORACLE = {
    "p2_found": f"""{_ITEMS}, dets as (
          select record_id, item_pos, i - 1 as det_pos, d[i] as v from (
            select record_id, item_pos, d, unnest(range(1, len(d) + 1)) as i from (
              select record_id, item_pos, json_extract(v, '$.detections[*]') as d from items
              where json_type(v, '$.image_id') in {_TEXT_OR_NUMBER} and trim(json_extract_string(v, '$.image_id')) <> ''
                and json_type(v, '$.detections') = 'ARRAY'))
        ), good_dets as (
          select *, json_extract(v, '$.polygon_xy[*]') as pts from dets
          where json_type(v, '$.class_name') = 'VARCHAR' and trim(json_extract_string(v, '$.class_name')) <> ''
            and json_type(v, '$.polygon_xy') = 'ARRAY'
            and (json_type(v, '$.confidence') in {_NUMBERS} or (json_type(v, '$.confidence') = 'VARCHAR'
                 and regexp_matches(json_extract_string(v, '$.confidence'), '{_NUMBER}')))
            and try_cast(json_extract_string(v, '$.confidence') as double) > 0
        ), points as (select record_id, item_pos, det_pos, pts, unnest(range(1, len(pts) + 1)) as i from good_dets)
        select record_id, item_pos::integer as item_pos, det_pos::integer as det_pos, (i - 1)::integer as point_pos from points
        where json_type(pts[i]) = 'ARRAY' and json_array_length(pts[i]) = 2
          and json_type(pts[i], '$[0]') in {_NUMBERS} and json_type(pts[i], '$[1]') in {_NUMBERS}""",
    "p2_items": f"""{_ITEMS}
        select record_id, record_id::varchar || '.item:' || item_pos::varchar as id, record_id::varchar as parent_id,
               'record' as parent_table, item_pos::integer as pos,
               case when json_type(v, '$.image_id') in {_TEXT_OR_NUMBER} then json_extract_string(v, '$.image_id') end as image_id,
               case when json_type(v, '$.image_width') in {_NUMBERS} then json_extract_string(v, '$.image_width')::bigint end as image_width,
               case when json_type(v, '$.image_height') in {_NUMBERS} then json_extract_string(v, '$.image_height')::bigint end as image_height
        from items""",
    "p2_records": f"""{_ITEMS}
        select record_id, record_id::varchar as id, null::varchar as parent_id, null::varchar as parent_table, 0 as pos,
               case when json_type(p, '$.run.run_id') in {_TEXT_OR_NUMBER} then json_extract_string(p, '$.run.run_id') end as run_id,
               case when json_type(p, '$.run.device') = 'VARCHAR' then json_extract_string(p, '$.run.device') end as run_device from good""",
    "p2_detections": f"""{_TREE}
        select record_id, id, parent_id, parent_table, pos, {_text("$.class_name")} as class_name, {_number("$.confidence")} as confidence,
               {_number("$.occlusion.ratio")} as occlusion_ratio, {_text("$.review.verdict")} as review_verdict from dets""",
    "p2_points": f"""{_TREE}, points as ({_below("$.polygon_xy", "point")})
        select record_id, id, parent_id, parent_table, pos, case when json_type(v, '$[0]') in {_NUMBERS} then json_extract_string(v, '$[0]')::double end as x,
               case when json_type(v, '$[1]') in {_NUMBERS} then json_extract_string(v, '$[1]')::double end as y,
               case when json_type(v) = 'ARRAY' then json_array_length(v)::integer end as n_values from points""",
    "p2_occluders": f"""{_TREE}, occluders as ({_below("$.occlusion.by", "occlusion/occluder")})
        select record_id, id, parent_id, parent_table, pos, {_text("$.class_name")} as class_name, {_number("$.confidence")} as confidence from occluders""",
    "p4_found": f"""{_NEAR} select * from pairs""",
    "p4_links": f"""{_NEAR}, links as (select image_id_a as id, count(*) as n from pairs group by 1 union all select image_id_b, count(*) from pairs group by 1)
        select r.id as image_id, min(r.id) over (partition by r.p) as place_id, coalesce((select sum(n) from links l where l.id = r.id), 0)::bigint as n_links from rows_ r""",
    "p4_regions": f"""
        with rows_ as (select * from manifest where latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)
            and abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0)),
        points as (select image_id, min(latitude) as lat, min(longitude) as lon from rows_ where image_id is not null group by image_id),
        box as (select lower(trim(city, ' ')) as town, (min(longitude) + max(longitude)) / 2 as mx, (max(longitude) - min(longitude)) * 0.3::double as rx,
            (min(latitude) + max(latitude)) / 2 as my, (max(latitude) - min(latitude)) * 0.3::double as ry from rows_ where trim(city, ' ') <> '' group by 1),
        corners as (select unnest([{", ".join(str(a) for a, _ in OCTAGON)}])::double as a, unnest([{", ".join(str(b) for _, b in OCTAGON)}])::double as b, unnest(range(8)) as i),
        c as (select town, i, mx + rx * a as x, my + ry * b as y from box, corners),
        e as (select p.town, p.x as x0, p.y as y0, q.x as x1, q.y as y1 from c p join c q on p.town = q.town and q.i = (p.i + 1) % 8 where p.y <> q.y)
        select image_id, town from points join e on least(y0, y1) <= lat and lat < greatest(y0, y1) and x0 + (lat - y0) * ((x1 - x0) / (y1 - y0)) < lon
        group by image_id, town having count(*) % 2 = 1""",
}
