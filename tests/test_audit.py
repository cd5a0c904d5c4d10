import json

import pytest
from pyspark.sql import functions as F

from stepfree.operators import audit
from stepfree.operators import network as N
from stepfree.operators import raster as R
from stepfree.sources import files, sinks


def test_boxes():
    assert audit.parse_box("1,2,3,4") == (1.0, 2.0, 3.0, 4.0)
    for text in ("1,2,3", "3,2,1,4", "1,2,1,4", "a,b,c,d"):
        with pytest.raises(ValueError):
            audit.parse_box(text)


def test_value_audit_and_counters(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 2), ("b", None)], "x string, y int")
    got = {r["column"]: r for r in audit.value_audit(df, ["x", "y"], most=1).collect()}
    assert (got["x"].n, got["x"].n_null, got["x"].n_different, got["x"].first_values) == (4, 1, 2, "a")
    assert audit.value_audit(df.limit(0), ["x"]).first().n == 0
    run = audit.run_counters(df, F.col("x").isNull(), F.coalesce(F.col("y"), F.lit(0)) == 0).first()
    assert tuple(run) == (4, 1, 1)


def test_ledger_takes_whole_numbers_exactly(spark):
    expected = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 0.5), ("d", 0.5), ("e", 1.0)], "claim string, expected double")
    figures = spark.createDataFrame([("a", 3.0), ("b", 4.0), ("c", 0.503), ("d", 0.51)], "claim string, value double")
    assert {r.claim: r.holds for r in audit.ledger(figures, expected).collect()} == {"a": True, "b": False, "c": True, "d": False, "e": False}


def test_refresh_can_be_run_again(spark, tmp_path):
    shape = "u bigint, v bigint, k int, tags map<string,array<string>>"
    old, new = spark.createDataFrame([(1, 2, 0, {})], shape), spark.createDataFrame([(1, 2, 0, {"lit": ["yes"]})], shape)
    nodes = spark.createDataFrame([(1,), (2,)], "node_id bigint")
    path = str(tmp_path / "s")
    assert [r.line for r in audit.refresh(None, nodes, old, path, "2024-01-01").collect()] == ["Initial snapshot"]
    assert [r.line for r in audit.refresh(old, nodes, new, path, "2024-01-08").collect()] == ["1-2-0: lit none -> yes"]
    audit.refresh(new, nodes, new, path, "2024-01-08")
    assert spark.read.parquet(path + "/snapshot_date=2024-01-08/edges").count() == 1
    assert spark.read.json(path + "/latest").first().snapshot_date == "2024-01-08"
    assert "no changes" in [r.line for r in spark.read.parquet(path + "/log").collect()]


def test_contour_lines_to_points(spark, tmp_path):
    feature = lambda kind, xy, z: {"geometry": {"type": kind, "coordinates": xy}, "properties": {"h": z}}
    doc = {"features": [feature("LineString", [[0, 0], [10, 0], [10, 4]], 700.0), feature("LineString", [[0, 0]], 1.0), feature("LineString", [[0, 0], [1, 1]], None)]}
    (tmp_path / "c.geojson").write_text(json.dumps(doc))
    lines = files.read_lines(spark, str(tmp_path / "c.geojson"), "h")
    assert lines.count() == 1
    points = R.densify(files.segments(lines), ["line_id", "part"], 2.5).orderBy("part", "i").collect()
    assert [(p.x, p.y) for p in points] == [(0.0, 0.0), (2.5, 0.0), (5.0, 0.0), (7.5, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 2.0), (10.0, 4.0)]


def test_label_store_is_sorted(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", "present", ""), ("a", "x", "absent", "n")], "segment_id string, attribute string, verdict string, note string")
    sinks.write_labels(df, str(tmp_path / "l"))
    text = spark.read.text(str(tmp_path / "l")).first().value
    assert list(json.loads(text)) == ["a|x", "b|x"]
    assert {tuple(r) for r in files.read_labels(spark, str(tmp_path / "l")).collect()} == {tuple(r) for r in df.collect()}


def test_pictures_by_name(spark, tmp_path):
    (tmp_path / "123.jpg").write_bytes(b"abc")
    assert [(r.image_id, r.length) for r in files.read_pictures(spark, str(tmp_path)).collect()] == [("123", 3)]


def test_narrowest_width_and_ramp_slope(spark):
    wide, none = [[0.0, 700.0], [900.0, 700.0], [400.0, 500.0]], [[0.0, 10.0], [900.0, 10.0], [400.0, 5.0]]
    thin = [[0.0, 700.0], [20.0, 700.0], [10.0, 500.0]]
    dets = spark.createDataFrame([("a", "sidewalk", wide), ("a", "pedestrian-area", thin), ("b", "curb-cut", wide), ("c", "sidewalk", none)], "image_id string, class_key string, points array<array<double>>")
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "image_id string")
    slopes = spark.createDataFrame([("a", 5.0), ("b", 7.126)], "image_id string, slope double")
    got = {r.image_id: tuple(r)[1:] for r in N.picture_geometry(images, dets, 720.0, slopes).collect()}
    assert got == {"a": ("under_50cm", None), "b": (None, 7.13), "c": (None, None)}
