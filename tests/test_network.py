import heapq

import pytest
from pyspark.sql import functions as F

from stepfree.operators import images as I
from stepfree.operators import metrics as M
from stepfree.operators import network as N
from stepfree.operators import raster as R
from stepfree.operators import routing, sampling, snapshots
from stepfree.operators.components import connected_components
from stepfree.operators.ranking import hash_order, spread_rank
from stepfree.plans import journeys, street

DATA = "/root/testdata/sf0.001"
EDGE = "condition string, cfg_id int, u bigint, v bigint, k int, cost double"


def dijkstra(edges, o, d):
    """An independent search: plain costs only."""
    best, heap = {o: 0.0}, [(0.0, o)]
    while heap:
        c, n = heapq.heappop(heap)
        if n == d:
            return c
        if c > best[n]:
            continue
        for u, v, w in edges:
            if u == n and c + w < best.get(v, 1e18):
                best[v] = c + w
                heapq.heappush(heap, (c + w, v))
    return None


def graph(spark):
    e = [(1, 2, 0, 1.0), (1, 2, 1, 0.5), (2, 3, 0, 1.0), (1, 4, 0, 0.75), (4, 3, 0, 0.75), (3, 5, 0, 2.0), (5, 5, 0, 0.1), (6, 1, 0, 1.0), (2, 1, 0, 1.0)]
    return spark.createDataFrame([("c", 0, *x) for x in e], EDGE)


def test_both_routers_agree_and_settle_ties(spark):
    parallel = N.parallel_min(graph(spark))
    pairs = spark.createDataFrame([(1, 1, 3), (2, 1, 5), (3, 1, 1), (4, 1, 6), (5, 6, 5)], "pair_id bigint, o bigint, d bigint")
    a = {r.pair_id: r for r in routing.search_routes(parallel, pairs).collect()}
    b = {r.pair_id: r for r in routing.relax_routes(parallel, pairs).collect()}
    assert set(a) == set(b) == {1, 2, 3, 5}
    for k in a:
        assert (a[k].nodes, a[k].edge_keys, a[k].cost) == (b[k].nodes, b[k].edge_keys, b[k].cost)
    assert a[1].nodes == [1, 2, 3] and a[1].edge_keys[0].k == 1 and a[1].cost == 1.5  # ties with 1 > 4 > 3 on cost and hops
    assert a[3].nodes == [1] and a[3].edge_keys == [] and a[3].cost == 0.0


def test_routes_of_the_tables_are_the_cheapest(spark):
    pairs = sampling.od_pairs(street.nodes(spark, DATA), 40).select("pair_id", "o", "d")
    parallel = N.parallel_min(street.costed(spark, DATA)).where("condition in ('baseline', 'full_raw')")
    edges = {}
    for r in parallel.collect():
        edges.setdefault(r.condition, []).append((r.u, r.v, r.cost))
    found = {(r.condition, r.pair_id): r for r in routing.routes(parallel, pairs).collect()}
    relaxed = {(r.condition, r.pair_id): r.nodes for r in routing.relax_routes(parallel, pairs).collect()}
    for p in pairs.collect():
        for c in edges:
            want = dijkstra(edges[c], p.o, p.d)
            got = found.get((c, p.pair_id))
            assert (want is None) == (got is None)
            if got:
                assert abs(got.cost - want) < 1e-9 and got.nodes[0] == p.o and got.nodes[-1] == p.d and relaxed[c, p.pair_id] == got.nodes


def test_comparison_identities(spark):
    rows = journeys.compare_conditions(spark, DATA).collect()
    assert {r.condition for r in rows} == {"full_validated", "full_raw", "ramp_only", "obstacle_only"}
    for r in rows:
        assert r.n_improvement + r.n_regression + r.n_neutral + r.n_mixed == r.n_differ and r.n_unchanged + r.n_differ == r.n_solved
        if r.condition == "obstacle_only":
            assert r.regressed_by_obstacles == 0 or r.obstacles_full <= r.obstacles_base
        if r.condition == "ramp_only":
            assert r.median_cost_full <= r.median_cost_base
    swept = journeys.threshold_sensitivity(spark, DATA).collect()
    assert len({r.route_diff_rate for r in swept}) == 1 and len(swept) == 12


def test_bootstrap_of_certain_flags(spark):
    df = spark.createDataFrame([("all", 1)] * 5 + [("none", 0)] * 5, "g string, flag int")
    got = {r.g: (r.lo, r.hi) for r in M.bootstrap(df, ["g"], 50).collect()}
    assert got == {"all": (1.0, 1.0), "none": (0.0, 0.0)}
    assert M.bootstrap(df.limit(0), ["g"], 50).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)], "u bigint, v bigint")
    got = {r.node: r.root for r in connected_components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == 100 and got[200] == 200 and None not in got
    assert connected_components(e.limit(0)).count() == 0


def test_components_by_rounds_and_by_one_task(spark, monkeypatch):
    import random

    from stepfree.operators import components

    r = random.Random(2)
    links = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(260)] + [("hub", f"n{i}") for i in range(0, 40)]
    e = spark.createDataFrame(links, "u string, v string").repartition(5)
    one = sorted(connected_components(e).collect())
    monkeypatch.setattr(components, "TASK_LINKS", 7)
    assert sorted(connected_components(e).collect()) == one
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    assert {n.node: n.root for n in one} == {x: find(x) for x in parent}


def test_error_function_and_running_totals(spark):
    import math

    from stepfree.functions.stats import erfc_sql, running_totals

    xs = [i / 8 for i in range(0, 208)]
    got = {x.x: x.e for x in spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{erfc_sql('x')} as e").collect()}
    assert all(abs(got[x] / math.erfc(x) - 1) < 1e-11 for x in xs)
    rows = [(g, (i * 7919 % 1000 - 500) / 3.0, i % 4) for g in (None, "a") for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    for key in (None, "a"):
        total = 0
        for x in sorted((x for x in running_totals(df, ["g"], "x", "w", "upto").collect() if x.g == key), key=lambda x: x.x):
            total += x.w
            assert x.upto == total


def test_spread_rank_equals_a_window(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, null, id % 5) as g").withColumn("o", hash_order("id"))
    got = {r.id: r.rank_pos for r in spread_rank(df, ["g"], "o").collect()}
    rows = df.collect()
    for g in {r.g for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: r.o), 1):
            assert got[r.id] == i
    assert spread_rank(df.limit(0), ["g"], "o").count() == 0


def test_snap_limits_ties_and_twins(spark):
    m = 1 / 111_195.0
    nodes = spark.createDataFrame([(1, -61.0, -23.0), (2, -61.0, -23.0 + 100 * m), (3, 10.0, 50.0)], "node_id bigint, x double, y double")
    edges = spark.createDataFrame([(2, 1, 0), (1, 2, 0), (3, 3, 0)], "u bigint, v bigint, k int")
    lon = m / 0.92050485  # a metre of longitude at 23 degrees
    images = spark.createDataFrame([("near", -23.0 + 50 * m, -61.0 + 10 * lon), ("far", -23.0 + 50 * m, -61.0 + 27 * lon), ("end", -23.0 - 20 * m, -61.0), ("loop", 50.0, 10.0)], "image_id string, latitude double, longitude double")
    got = {r.image_id: r for r in N.snap(images, edges, nodes).collect()}
    assert set(got) == {"near", "end", "loop"} and (got["near"].u, got["near"].v) == (1, 2) and abs(got["near"].dist - 10) < 0.1 and abs(got["end"].dist - 20) < 0.1
    twins = sorted((r.image_id, r.u, r.v) for r in N.mirror(N.snap(images, edges, nodes), edges).collect())
    assert twins == [("end", 1, 2), ("end", 2, 1), ("loop", 3, 3), ("near", 1, 2), ("near", 2, 1)]
    assert N.snap(images.limit(0), edges, nodes).count() == 0 and N.snap(images, edges.limit(0), nodes).count() == 0


def test_without_pictures_fusion_is_the_map_alone(spark):
    edges, from_map = street.edges(spark, DATA), street.from_map(spark, DATA)
    none = N.image_evidence(street.mirrored(spark, DATA).limit(0), street.dets(spark, DATA))
    rows = N.fuse(edges, from_map, none).collect()
    known = {(r.u, r.v, r.k): r for r in from_map.collect()}
    for r in rows:
        assert r.n_images_observed == 0
        for a, default in N.DEFAULTS.items():
            said = known[r.u, r.v, r.k][a]
            assert r[a] == (default if said in (None, "unknown") else said) and r[f"{a}_imputed"] == (said in (None, "unknown"))
            assert r[f"{a}_source"] == (None if said is None else "osm")


def test_labels_reach_both_twins_and_the_latest_holds(spark):
    rows = [("2_1_0", "ramp_present", "Absent ", "x", "2024-01-02"), ("1_2_0", "ramp_present", "present", None, "2024-01-01"), ("1_2_0", "fixed_obstacle_present", "uncertain", "", "2024-01-01"),
            ("1_2_0", "fixed_obstacle_present", " ", "", "2024-02-01"), ("1_2", "ramp_present", "present", "", "2024-01-01"), (None, "ramp_present", "present", "", "2024-01-01")]
    df = spark.createDataFrame(rows, "segment_id string, attribute string, verdict string, note string, at string").withColumn("labelled_at", F.to_timestamp("at"))
    got = {(r.segment_id, r.attribute): (r.verdict, r.note) for r in N.latest_labels(df).collect()}
    assert got == {("1_2_0", "ramp_present"): ("absent", "x"), ("1_2_0", "fixed_obstacle_present"): ("uncertain", "")}
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (2, 1, 1)], "u bigint, v bigint, k int")
    done = {(r.u, r.v, r.k): r.ramp_present_validated_value for r in N.apply_labels(edges, N.latest_labels(df)).collect()}
    assert done == {(1, 2, 0): "absent", (2, 1, 0): "absent", (2, 1, 1): None}


def test_snapshot_lines(spark):
    shape = "u bigint, v bigint, k int, tags map<string,array<string>>"
    old = spark.createDataFrame([(1, 2, 0, {"kerb": ["raised"]}), (2, 3, 0, {}), (3, 4, 0, None)], shape)
    new = spark.createDataFrame([(1, 2, 0, {"surface": ["sett", "gravel"]}), (3, 4, 0, {}), (9, 9, 0, {})], shape)
    got = sorted(r.line for r in snapshots.lines(snapshots.diff(old, new)).collect())
    assert got == ["1-2-0: kerb raised -> none", "1-2-0: surface none -> sett;gravel", "added 9-9-0", "removed 2-3-0"]
    assert [r.line for r in snapshots.lines(snapshots.diff(None, new)).collect()] == ["Initial snapshot"]
    assert snapshots.diff(new, new).count() == 0


def test_slope_of_a_plane_with_a_hole(spark):
    cells = spark.createDataFrame([(r, c, -9999.0 if (r, c) == (2, 2) else 3.0 * c + 4.0 * r) for r in range(5) for c in range(5)], "row int, col int, value double")
    got = {(r.row, r.col): r.slope for r in R.slope(R.clean_cells(cells), 5, 5, 100.0).collect()}
    assert got[2, 2] is None and got[2, 1] is None and got[1, 2] is None
    assert all(abs(got[p] - 5.0) < 1e-9 for p in got if p not in {(2, 2), (2, 1), (2, 3), (1, 2), (3, 2)})


def test_image_operators_refuse_bad_arguments(spark):
    with pytest.raises(ValueError):
        I.tiles(spark, 0, 0, 1, 1, cell=0.02)
    with pytest.raises(ValueError):
        I.tiles(spark, 1, 0, 0, 1)
    with pytest.raises(ValueError):
        I.hash_split(F.lit("x"), 1.0)
    with pytest.raises(ValueError):
        I.shards(spark.createDataFrame([("a", "b")], "i string, s string"), "i", "s", 0)


def test_downselect_prefers_the_newest_and_null_text_first(spark):
    rows = [("a", -23.0, -61.0, 10.0, "2"), ("b", -23.0, -61.0, 370.0, "10"), ("c", -23.0, -61.0, None, None), ("d", -23.0, -61.0, 95.0, "1"), ("e", None, -61.0, 95.0, "9")]
    df = spark.createDataFrame(rows, "image_id string, latitude double, longitude double, compass_angle double, captured_at string")
    assert sorted(r.image_id for r in I.downselect(df).collect()) == ["c", "d"]
    assert sorted(r.image_id for r in I.downselect(df, most=2).collect()) == ["a", "c", "d"]


def test_greedy_order():
    assert N.greedy_order([("a", 0.0, 0.0), ("b", 2.0, 0.0), ("c", 1.0, 0.0), ("d", 2.0, 0.5)]) == ["b", "d", "c", "a"]
    assert N.greedy_order([]) == []


def test_images_at_a_seam_of_zones_find_edges_on_both_sides(spark):
    # the seam at -60 degrees: an edge over it, one on its east side, and images on either side
    nodes = spark.createDataFrame([(1, -60.0005, -23.0), (2, -59.9995, -23.0), (3, -59.9999, -23.001), (4, -59.9990, -23.001), (5, 179.9999, 10.0), (6, -179.9999, 10.0)], "node_id bigint, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 4, 0), (5, 6, 0)], "u bigint, v bigint, k int")
    spots = [("west", -23.0001, -60.0002), ("east", -23.0001, -59.9998), ("across", -23.00101, -60.00002), ("line", 10.00005, 180.0), ("none", -23.1, -60.0)]
    images = spark.createDataFrame(spots, "image_id string, latitude double, longitude double")
    got = {r.image_id: (r.u, r.v, round(r.dist)) for r in N.snap(images, edges, nodes).collect()}
    assert set(got) == {"west", "east", "across", "line"}
    assert got["west"] == got["east"] == (1, 2, 11) and got["across"][:2] == (3, 4) and 10 <= got["across"][2] <= 14 and got["line"][:2] == (5, 6)


def test_long_edges_are_laid_only_near_images(spark):
    """Edges of 2,000 km across a plane: the same hits as by comparing all with all, and no cells where there is no image."""
    nodes = spark.createDataFrame([(1, -63.0, -20.0), (2, -63.0, -2.0), (3, -61.0, -20.0), (4, -64.0, -2.0), (5, -62.9995, -19.9995)], "node_id bigint, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 4, 1), (1, 5, 0)], "u bigint, v bigint, k int")
    beside = [(f"m{i}", -20.0 + 18 * i / 400 if i < 40 else -20.0 + i * 1e-5, -63.0 + (i * 37 % 81 - 40) / 1.06e5) for i in range(400)]
    images = spark.createDataFrame([*beside, ("end", -20.0, -61.0), ("none", 40.0, 7.0)], "image_id string, latitude double, longitude double")
    at = N.add_projection(images, "latitude", "longitude")
    near = at.join(N.in_zones(edges, nodes), "zone").withColumn("dist", N.segment_distance("east", "north", "east_u", "north_u", "east_v", "north_v")).where("dist <= 25")
    want = {r.image_id: tuple(r.b) for r in near.groupBy("image_id").agg(F.min(F.struct("dist", *N.KEY)).alias("b")).collect()}

    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    got = {r.image_id: (r.dist, r.u, r.v, r.k) for r in N.snap(images, edges, nodes).collect()}
    moved = sum(n for k, n in shuffled().items() if k not in before)
    assert {i: x[1:] for i, x in got.items()} == {i: x[1:] for i, x in want.items()} and all(abs(got[i][0] - want[i][0]) < 1e-6 for i in want)
    assert {r[1:] for r in got.values()} == {(1, 2, 0), (3, 4, 1), (1, 5, 0)} and sum(i[0] == "m" and int(i[1:]) < 40 for i in got) > 10 and "none" not in got
    assert moved < 150_000
