"""Writers: snapshots, shards, GeoJSON, GraphML, label stores, change logs."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions.labels import CLASSES


#: Labels that one JSON object may hold.
MOST_LABELS = 200_000


def _not_empty(df: DataFrame, what: str) -> None:
    if not df.take(1):
        raise ValueError(f"no rows to write: {what}")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty frame is an error. Arrays, maps and structs are written as JSON."""
    _not_empty(df, path)
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_shards(df: DataFrame, path: str) -> None:
    """Rows with `split` and `shard` as JSON under split=.../shard=..."""
    df.write.mode("overwrite").partitionBy("split", "shard").json(path)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, day: str) -> None:
    """A dated snapshot and the pointer to the latest one."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/snapshot_date={day}/{name}")
    nodes.sparkSession.createDataFrame([(day,)], "snapshot_date string").coalesce(1).write.mode("overwrite").json(f"{path}/latest")


def append_changes(lines: DataFrame, path: str, day: str) -> None:
    """The day's changes; a day without any has one line that says so."""
    spark = lines.sparkSession
    rows = lines if lines.take(1) else spark.createDataFrame([("no changes",)], "line string")
    rows.select(F.lit(day).cast("date").alias("snapshot_date"), "line").write.mode("append").parquet(path)


def geojson(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """(feature): one GeoJSON point feature per row with a position, all other columns as properties."""
    properties = [c for c in points.columns if c not in (lat, lon)]
    shape = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")
    )
    return points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.to_json(shape).alias("feature"))


def write_labels(labels: DataFrame, path: str) -> None:
    """A label store: one JSON object keyed by segment|attribute, keys sorted. Such stores
    are kept by hand; more than `MOST_LABELS` labels are refused and belong in a table."""
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: write them as a table")
    entry = F.struct(F.concat_ws("|", "segment_id", "attribute").alias("k"), F.struct("verdict", "note").alias("l"))
    store = labels.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    store.coalesce(1).write.mode("overwrite").text(path)


def write_predictions(dets: DataFrame, path: str) -> None:
    """One JSON line per image with its detections, and its width and height where `dets`
    has them; images without any are not written. `read_predictions` reads it back."""
    sizes = [c for c in ("image_width", "image_height") if c in dets.columns]
    rows = dets.groupBy("image_id").agg(*[F.max(c).alias(c) for c in sizes], F.collect_list(F.struct("class_name", "confidence", "polygon_xy")).alias("detections"))
    rows.write.mode("overwrite").json(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML file from (node_id, attributes...) and (u, v, k, attributes...),
    one line per element, written by the tasks as text parts in order."""
    def lines(df: DataFrame, head, own: list[str], kind: str) -> tuple[list[str], DataFrame]:  # noqa: ANN001
        columns = [c for c in df.columns if c not in own]
        keys = [f'<key id="{kind}_{i}" for="{kind}" attr.name="{escape(c)}" attr.type="string"/>' for i, c in enumerate(columns)]
        text = lambda c: F.initcap(F.col(c).cast("string")) if dict(df.dtypes)[c] == "boolean" else F.col(c).cast("string")
        safe = lambda c: F.replace(F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        data = [F.coalesce(F.concat(F.lit(f'<data key="{kind}_{i}">'), safe(c), F.lit("</data>")), F.lit("")) for i, c in enumerate(columns)]
        return keys, df.select(F.concat(head, *data, F.lit(f"</{kind}>")).alias("value"))

    nk, nl = lines(nodes, F.format_string('<node id="%d">', "node_id"), ["node_id"], "node")
    ek, el = lines(edges, F.format_string('<edge source="%d" target="%d" id="%d">', "u", "v", "k"), ["u", "v", "k"], "edge")
    spark = nodes.sparkSession
    top = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *nk, *ek, '<graph edgedefault="directed">']
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "value string").coalesce(1)
    one(top).union(nl).union(el).union(one(["</graph></graphml>"])).write.mode("overwrite").text(path)


def dataset_yaml(train: str, val: str) -> str:
    """The data set description a detector is trained with."""
    names = "\n".join(f"  {i}: {c}" for i, c in enumerate(CLASSES))
    return f"train: {train}\nval: {val}\nnc: {len(CLASSES)}\nnames:\n{names}\n"
