"""SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_USABLE = (
    "latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude) "
    "and abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0)"
)

ORACLE: dict[str, str] = {
    "p1_varied_subset": f"""
        with rows_ as (
          select image_id as id, latitude as lat, longitude as lon,
                 case when isnan(compass_angle) then null else compass_angle end as heading
          from manifest where image_id is not null and {_USABLE}
        ), best as (
          select id, min(struct_pack(lat := lat, lon := lon, heading := coalesce(heading, 1e9))) as p from rows_ group by id
        ), one as (
          select id, p.lat as lat, p.lon as lon, case when p.heading < 1e9 then p.heading end as heading from best
        ), cells as (
          select id, r::varchar || '|' || floor(lon * cos(radians(r * (50.0::double / 111195.0::double))) / (50.0::double / 111195.0::double))::bigint::varchar
                 || '|' || s::varchar as cell
          from (select *, floor(lat / (50.0::double / 111195.0::double))::bigint as r,
                       case when heading is null then -1 else least(floor((heading - 360.0::double * floor(heading / 360.0::double)) / 45.0::double)::bigint, 7) end as s from one)
        ), ranked as (
          select *, row_number() over (partition by cell order by md5(id)) as rank_pos from cells
        ), placed as (
          select *, row_number() over (order by rank_pos, md5(cell)) as n, count(*) over () as total from ranked
        )
        select id as image_id, cell, rank_pos from placed where n <= ceil(total * 0.1::double)""",
    "p3_found": f"""
        with recursive rows_ as (
          select image_id as id, min(struct_pack(lat := latitude, lon := longitude)) as p from manifest where image_id is not null and {_USABLE} group by image_id
        ), v as (
          select id, cos(radians(p.lat)) * cos(radians(p.lon)) as x, cos(radians(p.lat)) * sin(radians(p.lon)) as y, sin(radians(p.lat)) as z from rows_
        ), cells as (select *, floor(x * 400000)::bigint as cx, floor(y * 400000)::bigint as cy, floor(z * 400000)::bigint as cz from v
        ), around as (
          select id, x, y, z, cx + dx as cx, cy + dy as cy, cz + dz as cz from cells,
            (select unnest([-1, 0, 1]) as dx), (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dz)
        ), links as (
          select a.id as a, b.id as b from cells a join around b using (cx, cy, cz)
          where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= pow(2 * sin(15.0 / 6371008.8 / 2), 2)
        ), walk as (
          select a as node, b as root from links union select links.a, walk.root from links join walk on links.b = walk.node
        ), groups_ as (select node, min(root) as group_id from walk group by node
        ), recorded as (
          select image_id, min(case when s = 'validation' then 'val' when s <> '' then s end) as s from (
            select image_id, lower(trim(split, ' ')) as s from manifest) group by image_id
        ), torn as (
          select group_id from groups_ join recorded on image_id = node group by group_id having min(s) <> max(s)
        )
        select node as image_id, group_id from groups_ join torn using (group_id)""",
    "p5_found": """
        with rows_ as (
          select distinct trim(image_id, ' ') as image_id, det_id,
                 regexp_replace(regexp_replace(lower(trim(class_name, ' ')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as class_key,
                 list_filter(polygon_xy, lambda p: len(p) = 2) as pts
          from detections where confidence > 0 and not isnan(confidence)
        ), scored as (
          select image_id, class_key, det_id,
                 case when len(pts) < 3 then 0.0::double
                      else abs(list_sum(list_transform(range(1, len(pts) + 1),
                        lambda i: pts[i][1] * pts[i % len(pts) + 1][2] - pts[i % len(pts) + 1][1] * pts[i][2]))) / 2 end as area
          from rows_ where image_id <> '' and class_key <> '' and len(pts) > 0
        ), ranked as (
          select *, row_number() over (partition by image_id, class_key order by area desc, det_id) as rank_pos
          from (select distinct * from scored)
        )
        select image_id, class_key, rank_pos::integer as rank_pos, det_id from ranked where rank_pos <= 3""",
}
