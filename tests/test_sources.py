import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stepfree.sources import files, sinks
from stepfree.streaming.labels import current_labels, upsert_labels


def test_manifest_aliases_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,url,lat,lng,city,compass_angle\n1,u,1.5,2.5,Here,\n2,u,1.5,2.5, there ,9\n")
    rows = files.read_manifest(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.image_id, r.latitude, r.compass_angle) for r in rows] == [("1", 1.5, None), ("2", 1.5, 9.0)]
    assert files.read_manifest(spark, str(tmp_path / "a.csv"), city="THERE").count() == 1
    (tmp_path / "b.csv").write_text("id,url,lat,lng,city\n ,u,1.5,2.5,Here\n")
    with pytest.raises(Exception, match="image_id"):
        files.read_manifest(spark, str(tmp_path / "b.csv"), city="There").collect()
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "a.csv"), train=1.5)


def test_predictions_round_trip(spark, tmp_path):
    doc = [{"image_id": "i", "detections": [{"class_name": "Curb", "confidence": 0.5, "polygon_xy": [[1, 2], [3], [4, 5]]}, {"class_name": "", "confidence": 1, "polygon_xy": [[1, 1]]}]}, {"image_id": "j", "detections": []}]
    (tmp_path / "p.json").write_text(json.dumps(doc))
    df = files.read_predictions(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in df.collect()] == [("i", "Curb", 0.5, [[1.0, 2.0], [4.0, 5.0]])]
    sinks.write_predictions(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("image_id", F.size("detections")).collect() == [("i", 1)]


def test_label_store(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"1_2_0|ramp_present": {"verdict": "present", "note": "n"}}))
    assert [tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.json")).collect()] == [("1_2_0", "ramp_present", "present", "n")]


def test_graphml_keeps_booleans(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 2.5, "a & <b>"), (2, None, None)], "node_id bigint, elevation double, name string")
    edges = spark.createDataFrame([(1, 2, 0, True, 7.5), (2, 1, 3, False, None), (2, 1, 4, None, 1.0)], "u bigint, v bigint, k int, ramp_present_imputed boolean, length double")
    sinks.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = files.read_graphml(spark, str(tmp_path / "g"))
    got = {r.k: r for r in files.typed(e, ["ramp_present_imputed"], ["length"]).collect()}
    assert (got[0].u, got[0].v, got[0].ramp_present_imputed, got[0].length) == (1, 2, True, 7.5)
    assert got[3].ramp_present_imputed is False and got[3].length is None and got[4].ramp_present_imputed is None
    assert {r.node_id: (r.elevation, r.name) for r in files.typed(n, [], ["elevation"], ["name"]).collect()} == {1: (2.5, "a & <b>"), 2: (None, None)}


def test_tiles_are_read_once_per_image(spark, tmp_path):
    image = {"id": "1", "geometry": {"coordinates": [1, 2]}}
    (tmp_path / "t0.json").write_text(json.dumps({"data": [image, {"id": ""}]}))
    (tmp_path / "t1.json").write_text(json.dumps({"data": [image] + [{"id": str(i)} for i in range(2, 1801)]}))
    rows = {r.id: r for r in files.read_tiles(spark, str(tmp_path)).collect()}
    assert len(rows) == 1800 and rows["1"].tile == "t0" and not rows["1"].near_cap and rows["2"].near_cap


def test_geojson_csv_shards_and_yaml(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "k string, lat double, lon double")
    (feature,) = [json.loads(r.feature) for r in sinks.geojson(df, "lat", "lon").collect()]
    assert feature["geometry"]["coordinates"] == [2.0, 1.0] and feature["properties"] == {"k": "a"}
    with pytest.raises(ValueError):
        sinks.write_csv(df.limit(0), str(tmp_path / "c"))
    sinks.write_csv(df.withColumn("list", F.array("k")), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    sinks.write_shards(df.withColumns({"split": F.lit("train"), "shard": F.lit(0)}), str(tmp_path / "s"))
    assert os.path.isdir(tmp_path / "s" / "split=train" / "shard=0")
    assert "nc: 10" in sinks.dataset_yaml("t", "v")
    sinks.append_changes(spark.createDataFrame([], "line string"), str(tmp_path / "log"), "2024-01-01")
    assert spark.read.parquet(str(tmp_path / "log")).first().line == "no changes"


def test_label_stream_keeps_the_latest(spark, tmp_path):
    shape = "segment_id string, attribute string, verdict string, note string, labelled_at timestamp"
    base = spark.createDataFrame([("1_2_0", "ramp_present", "present", ""), ("2_1_0", "ramp_present", "absent", "")], "segment_id string, attribute string, verdict string, note string")
    source, store, mark = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "mark")
    base.limit(1).withColumn("labelled_at", F.to_timestamp(F.lit("2024-01-01"))).write.parquet(source)
    for day in ("2024-01-02", None):
        if day:
            upsert_labels(spark.readStream.schema(shape).parquet(source), store, mark).awaitTermination()
            base.where("verdict = 'absent'").withColumn("labelled_at", F.to_timestamp(F.lit(day))).write.mode("append").parquet(source)
        else:
            upsert_labels(spark.readStream.schema(shape).parquet(source), store, mark).awaitTermination()
    assert [tuple(r)[:3] for r in current_labels(spark, store).collect()] == [("1_2_0", "ramp_present", "absent")]


def test_the_library_stands_without_the_training_data_package(tmp_path):
    code = "import sys; sys.modules['stepfree.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_varied_subset' not in q; assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_command_line(spark, tmp_path):
    from stepfree.cli import main

    main(["coverage", "/root/testdata/sf0.001", "--output", str(tmp_path / "o"), "--format", "csv"])
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 14


def test_predictions_of_several_images_come_back(spark, tmp_path):
    rows = [(f"i{k}", "Curb", 0.5, [[1.0, 2.0], [3.0, 4.0]], 640 + k, 480) for k in range(7)] + [("i0", "Pole", 0.25, [[0.0, 1.0]], 640, 480)]
    df = spark.createDataFrame(rows, "image_id string, class_name string, confidence double, polygon_xy array<array<double>>, image_width bigint, image_height bigint")
    sinks.write_predictions(df.coalesce(1), str(tmp_path / "p"))
    for lines in (False, True):
        assert sorted(tuple(r) for r in files.read_predictions(spark, str(tmp_path / "p"), sizes=True, lines=lines).collect()) == sorted(rows)


def test_jobs(spark, tmp_path):
    from stepfree.cli import main

    t, out = "/root/testdata/sf0.001", str(tmp_path / "snap")
    main(["refresh", t, "--output", out, "--day", "2024-01-01"])
    main(["refresh", t, "--output", out, "--day", "2024-01-02"])
    nodes, edges, day = files.read_snapshot(spark, out)
    assert day == "2024-01-02" and nodes.count() > 0 and edges.count() > 0
    assert [r.line for r in spark.read.parquet(f"{out}/log").where("snapshot_date = '2024-01-02'").collect()] == ["no changes"]

    spark.createDataFrame([(r, c, float(10 * c)) for r in range(4) for c in range(5)], "row int, col int, value double").write.parquet(str(tmp_path / "cells"))
    main(["slope", str(tmp_path / "cells"), "--cell", "100", "--output", str(tmp_path / "slope")])
    assert {round(r.slope, 9) for r in spark.read.parquet(str(tmp_path / "slope")).collect()} == {10.0}

    line = lambda y, z: {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, y], [40, y]]}, "properties": {"z": z}}
    (tmp_path / "c.json").write_text(json.dumps({"features": [line(0, 5.0), line(10, 5.0), line(900, 7.0)]}))
    main(["dem", str(tmp_path / "c.json"), "--elevation", "z", "--cell", "10", "--box=-1,-1,50,50", "--output", str(tmp_path / "dem")])
    assert {round(r.value, 6) for r in spark.read.parquet(str(tmp_path / "dem")).collect()} == {5.0}

    (tmp_path / "m.csv").write_text("id,path,lat,lng,city\n" + "".join(f"{i},u,{i / 10},2.5,Here\n" for i in range(40)))
    main(["manifests", str(tmp_path / "m.csv"), "--train", "0.5", "--shard-size", "7", "--city", "here", "--box", "0,0,3,2", "--output", str(tmp_path / "shards")])
    shards = spark.read.json(str(tmp_path / "shards"))
    assert shards.count() == 21 and shards.groupBy("split", "shard").count().agg(F.max("count")).first()[0] <= 7

    main(["experiment", t, "--pairs", "40", "--seed", "3", "--output", str(tmp_path / "e")])
    done = {r.condition: json.loads(r.document) for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert len(done) == 4 and all(x["n_solved"] == 40 and "route_diff_ci95" in x for x in done.values())
