import json

import pytest

from stepfree.operators import nested as N

ITEM = {"image_id": "i1", "image_width": 10, "image_height": 8, "detections": [
    {"class_name": "Curb", "confidence": "0.5", "polygon_xy": [[1, 2], [3], None, [4, 5.5], {"x": 1, "y": 2}, ["a", 1], [True, 1]]},
    {"class_name": " ", "confidence": 0.9, "polygon_xy": [[1, 1]]},
    {"class_name": "Road", "confidence": 0, "polygon_xy": [[1, 1]]},
    {"class_name": "Bench", "confidence": 0.2, "occlusion": {"ratio": 0.1, "by": [{"class_name": "Car", "confidence": 0.3}]},
     "review": {"verdict": "present", "detections": [{"class_name": "Curb", "confidence": 0.5, "polygon_xy": [[7, 7]],
                                                      "review": {"verdict": "absent", "detections": [{"class_name": "Deep", "confidence": 1}]}}]}, "polygon_xy": [[9, 9]]},
]}
BAD = [None, {"image_id": "", "detections": [ITEM["detections"][0]]}, {"image_id": 5, "detections": {"error": 1}}, {"image_id": True, "detections": []}]


def frame(spark, payloads):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p), 1, i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "id bigint, payload string, v int, at int")  # v is a name the operator uses itself


def points(spark, payloads):
    recs = N.parse_records(frame(spark, payloads), "id", "payload", "at")
    return sorted(tuple(r)[:4] for r in N.valid_points(recs).collect())


def test_positions_count_invalid_ones_and_all_three_forms(spark):
    inner = [(0, 0), (0, 3)]
    want = [(*p, q) for p, qs in zip(inner, ([0, 3], [0])) for q in qs]
    plain = [(0, 0, d, q) for (_, d, q) in want]
    assert points(spark, [[ITEM]]) == plain
    assert points(spark, [{"items": [*BAD, ITEM]}]) == [(0, len(BAD), d, q) for (_, _, d, q) in plain]
    shards = {"run": {"run_id": "r"}, "shards": [{"shard": 0, "items": BAD}, {"shard": 1}, 7, {"items": [ITEM]}]}
    assert points(spark, [shards]) == [(0, len(BAD), d, q) for (_, _, d, q) in plain]


@pytest.mark.parametrize("text", [None, "", "  ", "null", "[]", "{}", "5", '[{"image_id":', "[1] [2]", "[] x", '{"items": []} {', '[1],"b":2', "NaN"])
def test_empty_and_damaged_payloads_give_nothing(spark, text):
    assert points(spark, [text]) == []


def test_trailing_text_damages_a_payload(spark):
    assert points(spark, [json.dumps([ITEM]) + "]", json.dumps([ITEM]) + ",1", " " + json.dumps([ITEM]) + " \n"]) == [(2, 0, 0, 0), (2, 0, 0, 3), (2, 0, 3, 0)]


def test_a_record_counts_once(spark):
    df = frame(spark, [[ITEM]])
    assert N.parse_records(df.union(df).union(df), "id", "payload", "at").count() == 1
    assert N.parse_records(df.limit(0), "id", "payload").count() == 0


def test_tables_by_shared_inlining():
    g = N.PREDICTIONS
    assert g.tables() == ["record", "item", "detection", "point", "occluder"]
    assert [e for e, _ in g.inlined("detection")] == ["detection", "occlusion", "review"]
    assert {(c, p) for c, p, _, _ in g.foreign_keys()} == {("item", "record"), ("detection", "item"), ("point", "detection"), ("occluder", "detection"), ("detection", "detection")}


def test_elements_that_contain_each_other_get_one_table():
    g = N.SchemaGraph("r", (N.Edge("r", "a", ("a",)), N.Edge("a", "b", ("b",)), N.Edge("b", "c", ("c",)), N.Edge("c", "b", ("b",))), ())
    assert g.tables() == ["r", "b"]


def test_children_find_their_parents_and_recursion_is_followed(spark):
    recs = N.parse_records(frame(spark, [[ITEM, *BAD], {"items": [ITEM]}]), "id", "payload")
    tables = {k: v.collect() for k, v in N.shred(recs, N.PREDICTIONS).items()}
    ways = {k: sorted(v.collect()) for k, v in N.shred(recs, N.PREDICTIONS, 2).items()}
    assert {k: sorted(v) for k, v in tables.items()} == ways  # two levels of reviews
    fewer = {k: v.count() for k, v in N.shred(recs, N.PREDICTIONS, 1).items()}
    assert fewer["detection"] < len(tables["detection"]) and fewer["item"] == len(tables["item"])
    for rows in tables.values():
        assert len({r.id for r in rows}) == len(rows)
        for r in rows:
            if r.parent_id is not None:
                assert r.parent_id in {p.id for p in tables[r.parent_table]}
    assert len(tables["item"]) == 2 + len(BAD) and len(tables["detection"]) == 2 * (4 + 1 + 1) + 1 and len(tables["occluder"]) == 2
    curb = next(r for r in tables["detection"] if r.class_name == "Curb" and r.parent_table == "item")
    assert curb.confidence == 0.5
    bench = next(r for r in tables["detection"] if r.class_name == "Bench")
    assert bench.occlusion_ratio == 0.1 and bench.review_verdict == "present"
    assert {r.class_name for r in tables["detection"] if r.parent_table == "detection"} == {"Curb", "Deep"}


def test_rows_left_out_take_what_is_below_with_them(spark):
    recs = N.parse_records(frame(spark, [[ITEM, *BAD]]), "id", "payload")
    tables = N.shred(recs, N.PREDICTIONS, 0, {"detection": "class_name = 'Curb'"})
    dets = {r.id for r in tables["detection"].collect()}
    assert dets and {r.parent_id for r in tables["point"].collect()} <= dets
    assert {r.class_name for r in tables["detection"].collect()} == {"Curb"}
