"""Readers: manifests, predictions, label stores, GraphML, tiles of images."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stepfree.operators.images import RAW_IMAGE, hash_split, required_or_fail
from stepfree.operators.nested import PREDICTIONS, is_whole, parse_records, shred

TILE_LIMIT, TILE_WARN = 2000, 1800
NODES = "node_id bigint, x double, y double, elevation double, tags map<string,array<string>>"


def read_manifest(spark: SparkSession, path: str, train: float = 0.85, city: str | None = None) -> DataFrame:
    """Images of a CSV with a header; each field has aliases. A row without id, path
    or position, or with an unreadable position, fails the job, also when another
    city is asked for: rows are checked first and filtered afterwards."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    have = {c.lower(): c for c in raw.columns}
    pick = lambda *names: [have[n] for n in names if n in have]

    def field(what: str, *names: str):  # noqa: ANN202
        found = pick(*names)
        if not found:
            raise ValueError(f"no column for {what}: {', '.join(names)}")
        return required_or_fail(what, *found)

    optional = lambda n: F.nullif(F.trim(F.col(have[n])), F.lit("")) if n in have else F.lit(None).cast("string")
    rows = raw.select(
        field("image_id", "image_id", "id").alias("image_id"), field("image_path", "image_path", "path", "url").alias("image_path"),
        field("latitude", "latitude", "lat").cast("double").alias("latitude"), field("longitude", "longitude", "lon", "lng").cast("double").alias("longitude"),
        optional("city").alias("city"), optional("compass_angle").try_cast("double").alias("compass_angle"), optional("captured_at").alias("captured_at"),
    ).withColumn("split", hash_split(F.col("image_id"), train))
    if not city:
        return rows
    # one condition, so that a pushed-down filter still checks every row before it looks at the city
    sound = F.col("image_id").isNotNull() & F.col("image_path").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return rows.where(F.when(sound, (F.lower(F.trim("city")) == city.lower()) & (F.trim("city") != "")))


def read_predictions(spark: SparkSession, path: str, sizes: bool = False, lines: bool = False) -> DataFrame:
    """(image_id, class_name, confidence, polygon_xy) of prediction files, with image_width
    and image_height if `sizes`; the last document that has an image holds for it.

    A file is one JSON document or has a document on every line; `lines` says that
    all of them have, so that large files are read in parts.
    """
    files = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("file"), F.col("value").alias("payload"))
    if lines:
        records = files.select(F.concat_ws("#", "file", F.format_string("%020d", F.monotonically_increasing_id())).alias("file"), "payload").where(r"payload rlike '\\S'")
    else:
        parts = F.when(is_whole(F.col("payload")), F.array("payload")).otherwise(F.filter(F.split("payload", r"\r?\n"), lambda l: F.trim(l) != ""))
        records = files.select("file", F.posexplode(parts).alias("n", "payload")).select(F.format_string("%s#%012d", "file", "n").alias("file"), "payload")
    # a document may be one image, as `write_predictions` has them
    alone = F.col("payload").rlike(r"^\s*\{") & F.get_json_object("payload", "$.image_id").isNotNull()
    records = records.withColumn("payload", F.when(alone, F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.col("payload")))
    tables = shred(parse_records(records, "file", "payload"), PREDICTIONS, 0)
    points = tables["point"].where("x is not null and y is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.array("x", "y").alias("p")))).alias("s"))
    polygons = points.select(F.col("parent_id").alias("id"), F.transform("s", lambda s: s["p"]).alias("polygon_xy"))
    images = tables["item"].where("trim(image_id) <> ''").groupBy("image_id").agg(F.max(F.struct("key", "pos", "id", "image_width", "image_height")).alias("m"))
    dets = tables["detection"].where("trim(class_name) <> '' and confidence > 0").join(polygons, "id")
    images = images.select("image_id", F.col("m.id").alias("parent_id"), "m.image_width", "m.image_height")
    return dets.join(images, "parent_id").select("image_id", "class_name", "confidence", "polygon_xy", *(["image_width", "image_height"] if sizes else []))


def read_snapshot(spark: SparkSession, path: str, day: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, day) of a dated snapshot, of the latest one by the pointer if no day is given."""
    day = day or spark.read.json(f"{path}/latest").first()["snapshot_date"]
    nodes, edges = (spark.read.parquet(f"{path}/snapshot_date={day}/{name}") for name in ("nodes", "edges"))
    return nodes, edges, day


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, attribute, verdict, note) of a JSON label store keyed by segment|attribute."""
    text = spark.read.text(path, wholetext=True)
    store = text.select(F.explode(F.from_json("value", "map<string, struct<verdict:string,note:string>>")).alias("key", "l"))
    parts = F.split("key", r"\|")
    return store.select(parts[0].alias("segment_id"), parts[1].alias("attribute"), "l.verdict", "l.note")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as maps: (node_id, data map) and (u, v, k, data map), values as
    text. Use `typed` to restore types."""
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    names = {(r["_for"], r["_id"]): r["_attr.name"] for r in keys.collect() if r["_id"] is not None}
    shape = "data array<struct<_VALUE:string,_key:string>>"

    def load(tag: str, attributes: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).schema(f"{attributes}, {shape}").load(path)
        rows = rows.where(F.col(attributes.split()[0]).isNotNull())  # what follows the last element is no element
        lookup = F.create_map(*[F.lit(x) for (kind, key), name in names.items() if kind in (tag, "all") for x in (key, name)] or [F.lit(""), F.lit("")])
        named = F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(F.coalesce(F.try_element_at(lookup, d["_key"]), d["_key"]).alias("k"), d["_VALUE"].alias("v")))
        return rows.withColumn("data", F.map_from_entries(named))

    nodes = load("node", "_id string").select(F.col("_id").cast("bigint").alias("node_id"), "data")
    edges = load("edge", "_source string, _target string, _id string").select(
        F.col("_source").cast("bigint").alias("u"), F.col("_target").cast("bigint").alias("v"), F.coalesce(F.col("_id").try_cast("int"), F.lit(0)).alias("k"), "data"
    )
    return nodes, edges


def typed(df: DataFrame, booleans: list[str] = (), numbers: list[str] = (), texts: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Columns out of the data map; a boolean is true for the text True only, false
    for any other text and null where there is none."""
    value = lambda c: F.try_element_at("data", F.lit(c))
    return df.select(
        *[c for c in df.columns if c != "data"], *[(value(c) == "True").alias(c) for c in booleans],
        *[value(c).try_cast("double").alias(c) for c in numbers], *[value(c).alias(c) for c in texts],
    )


class TileSource(DataSource):
    """spark.read.format("image_tiles").load(folder): raw images of tile files
    (<tile>.json, each {"data": [...]}); every file is one partition. A tile with at
    least 1800 rows is marked near_cap: the service cuts answers at 2000."""

    @classmethod
    def name(cls) -> str:
        return "image_tiles"

    def schema(self) -> str:
        return "tile string, near_cap boolean, json string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TileReader(self.options["path"])


class _TileReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = Path(partition.value)
        rows = json.loads(path.read_text(encoding="utf-8")).get("data") or []
        for row in rows:
            yield path.stem, len(rows) >= TILE_WARN, json.dumps(row)


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Raw images of all tiles, each id once: that of the first tile it appears in."""
    spark.dataSource.register(TileSource)
    rows = spark.read.format("image_tiles").load(folder).withColumn("i", F.from_json("json", RAW_IMAGE)).where("i.id <> ''")
    best = rows.groupBy(F.col("i.id").alias("id")).agg(F.min_by(F.struct("tile", "near_cap", "json"), F.struct("tile", "json")).alias("b"))
    return best.select("id", "b.tile", "b.near_cap", "b.json")


def read_lines(spark: SparkSession, path: str, elevation: str) -> DataFrame:
    """(line_id, z, vertices) of GeoJSON LineString features; other geometries and
    lines without elevation or with fewer than two vertices are dropped."""
    shape = f"features array<struct<geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<`{elevation}`:double>>>"
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", shape).alias("d"))
    rows = text.select("file", F.posexplode("d.features").alias("n", "f"))
    good = rows.where("f.geometry.type = 'LineString'").select(
        F.concat_ws("#", "file", F.col("n").cast("string")).alias("line_id"), F.col(f"f.properties.`{elevation}`").alias("z"), F.col("f.geometry.coordinates").alias("vertices")
    )
    return good.where("z is not null and size(vertices) >= 2")


def segments(lines: DataFrame) -> DataFrame:
    """(line_id, part, x0, y0, x1, y1, z): the straight parts of lines, for `densify`."""
    pair = F.expr("transform(sequence(0, size(vertices) - 2), i -> struct(vertices[i] as a, vertices[i + 1] as b))")
    rows = lines.select("line_id", "z", F.posexplode(pair).alias("part", "s"))
    return rows.select("line_id", "part", *[F.col(f"s.{p}")[i].alias(n) for p, i, n in (("a", 0, "x0"), ("a", 1, "y0"), ("b", 0, "x1"), ("b", 1, "y1"))], "z")


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, content, length) of picture files; the id is the file's name."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("image_id"), "content", "length")
