"""Operators that once did a part of their job only."""

import json
import math
from collections import Counter

from pyspark.sql import functions as F

from stepfree.operators import metrics as M
from stepfree.operators import network as N
from stepfree.operators import routing, sampling
from stepfree.plans import journeys, street

DATA = "/root/testdata/sf0.001"


def test_every_point_has_its_nearest_node(spark):
    import numpy as np

    from stepfree.functions.geo import EARTH_RADIUS_M, project

    rng = np.random.default_rng(5)
    spots = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(np.column_stack([rng.uniform(-23.32, -23.28, 400), rng.uniform(-60.02, -59.98, 400)]))]
    spots += [(900, spots[0][1], spots[0][2]), (901, 10.0, 179.999)]
    nodes = spark.createDataFrame([(i, x, y) for i, y, x in spots], "node_id bigint, x double, y double")
    near = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(np.column_stack([rng.uniform(-23.5, -23.1, 300), rng.uniform(-60.2, -59.8, 300)]))]
    near += [("line", 10.0, -179.999), ("globe", 60.0, 20.0), ("pole", 90.0, 0.0), ("twin", spots[0][1], spots[0][2])]
    points = spark.createDataFrame([*near, ("none", None, 1.0), ("nan", float("nan"), 1.0)], "id string, lat double, lon double")
    got = {r.id: r for r in N.nearest_node(points, nodes, "id", "lat", "lon").collect()}
    assert set(got) == {n for n, _, _ in near} and got["twin"].node_id == 1 and got["twin"].dist == 0.0 and got["line"].node_id == 901
    ids, y, x = (np.array(c) for c in zip(*spots))
    for name, lat, lon in near:
        arc = np.sin(np.radians(y - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(y)) * np.sin(np.radians(x - lon) / 2) ** 2
        want = 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(arc))
        if want.min() < 90_000:
            meridian = min(np.floor((lon + 180) / 6), 59) * 6 - 177
            want = np.hypot(*(project(y, x, meridian) - project(np.array([lat]), np.array([lon]), meridian)).T)
        assert got[name].node_id == ids[np.lexsort((ids, want))[0]] and abs(got[name].dist - want.min()) < 1e-6 * max(1.0, want.min())
    split = N.NODE_BLOCK
    try:
        N.NODE_BLOCK = 50
        assert {r.id: r for r in N.nearest_node(points, nodes, "id", "lat", "lon").collect()} == got
    finally:
        N.NODE_BLOCK = split
    assert N.nearest_node(points, nodes.limit(0), "id", "lat", "lon").count() == 0 and N.nearest_node(points.limit(0), nodes, "id", "lat", "lon").count() == 0


def test_least_costs_from_all_nodes_under_all_conditions(spark):
    got = {(r.condition, r.o, r.node): r.dist for r in journeys.shortest_path_hops(spark, DATA).collect()}
    edges, nodes = {}, [r.node_id for r in street.nodes(spark, DATA).collect()]
    for r in N.parallel_min(street.costed(spark, DATA)).collect():
        edges.setdefault(r.condition, {}).setdefault(r.u, []).append((r.v, r.cost))
    want = {}
    for c in edges:
        for o in nodes:
            best, left = {o: 0.0}, [o]
            while left:  # until nothing improves, in any order
                u = left.pop()
                for v, w in edges[c].get(u, ()):
                    if best[u] + w < best.get(v, 1e18) - 1e-12:
                        best[v] = best[u] + w
                        left.append(v)
            want |= {(c, o, n): x for n, x in best.items()}
    assert len(edges) == 5 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_searched_labels_equal_relaxed_ones(spark):
    e = [("c", 0, 1, 2, 0, 1.0), ("c", 0, 2, 3, 1, 1.0), ("c", 0, 1, 4, 0, 1.0), ("c", 0, 4, 3, 0, 1.0), ("d", 1, 3, 1, 0, 2.0)]
    parallel = spark.createDataFrame(e, "condition string, cfg_id int, u bigint, v bigint, k int, cost double")
    origins = spark.createDataFrame([(1,), (3,), (9,)], "o bigint")
    a, b = (sorted(f(parallel, origins).collect(), key=str) for f in (routing.search_labels, routing.relax_labels))
    assert a == b and len(a) == 10


def test_sweeps_run_over_all_pairs_seeds_and_quantities(spark):
    pairs = sampling.od_pairs(street.nodes(spark, DATA), 1000)
    n = pairs.count()
    swept = journeys.weight_sweep(spark, DATA).collect()
    assert n > 800 and len(swept) == 9 and {r.n_solved for r in swept} == {n}  # the network is strongly connected
    assert all(abs(r.improvement_rate_of_all * r.n_solved - r.improvement_rate_of_differ * r.n_differ) < 1e-6 for r in swept)
    base = street.weight_grid_cost(spark, DATA).where("condition = 'baseline'").collect()
    assert len(base) == 9 and len({r.total for r in base}) == 1
    got = {r.metric: r for r in journeys.seed_stability(spark, DATA).collect()}
    assert set(got) == {"route_diff_rate", "improvement_rate_of_differ", "net_improvement_rate_of_all", "obstacles_avoided"}
    assert len(journeys.SEEDS) == 10 and got["obstacles_avoided"].least <= got["obstacles_avoided"].mean <= got["obstacles_avoided"].most
    models = {r.model: r.n_solved for r in journeys.slope_models(spark, DATA).collect()}
    assert models == {"naive": n, "protected": n}


def test_the_experiment_has_1000_pairs_and_the_whole_grid(spark):
    rows = journeys.od_sample(spark, DATA).collect()
    assert len(rows) == 1000 and sorted(Counter(r.band for r in rows).values()) == [250] * 4
    assert len({frozenset((r.o, r.d)) for r in rows}) == 1000
    grid = {(r.margin, r.steep) for r in journeys.threshold_sensitivity(spark, DATA).collect()}
    assert grid == {(m, t) for m in (0.0, 5.0, 10.0, 20.0) for t in (0.05, 0.0833, 0.12)}


def test_more_draws_keep_the_first(spark):
    nodes, whole = street.nodes(spark, DATA), sampling.ATTEMPTS
    try:
        found = []
        for attempts in ((20,), (100,), (500,), whole):
            sampling.ATTEMPTS = attempts
            found.append(sorted(sampling.od_pairs(nodes, 200, seeds=[1, 2]).collect()))
        assert found[1] == found[2] == found[3] and len(found[3]) == 400
    finally:
        sampling.ATTEMPTS = whole


def test_comparison_has_intervals_and_tests(spark):
    axes = [*M.AXES, "ramp_access", "cost"]
    shape = "condition string, pair_id bigint, changed boolean, " + ", ".join(f"{a}_{w} double" for a in axes for w in ("base", "full"))
    def row(c, i, changed, obstacles=0.0, cost=0.0):
        return (c, i, changed, 0.0, 0.0, 5.0, 5.0 + obstacles, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 100.0, 100.0 + cost)
    rows = [row("some", i, i < 60, -1.0 if i < 45 else 0.0, -1.0 - i if i < 60 else 0.0) for i in range(100)] + [row("none", i, False) for i in range(30)]
    pairs = spark.createDataFrame(rows, shape)
    done = M.with_tests(M.compare(pairs, ["condition"]), pairs, ["condition"])
    got = {r.condition: r for r in done.collect()}
    some, none = got["some"], got["none"]
    assert 0.45 < some.route_diff_rate_lo < 0.56 and 0.64 < some.route_diff_rate_hi < 0.75  # 0.6 -+ 1.96 * 0.049
    assert 0.58 < some.improvement_rate_of_differ_lo < 0.70 and 0.80 < some.improvement_rate_of_differ_hi < 0.90  # 0.75 -+ 1.96 * 0.056
    assert some.wilcoxon_stat == 0.0
    for p, n, ties in ((some.wilcoxon_p, 60, 0), (some.obstacle_wilcoxon_p, 45, 45**3 - 45)):
        want = math.erfc(n * (n + 1) / 4 / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / math.sqrt(2))
        assert abs(p - want) < 2e-7
    assert (none.route_diff_rate_lo, none.route_diff_rate_hi, none.improvement_rate_of_differ_lo, none.improvement_rate_of_differ_hi) == (0.0, 0.0, 0.0, 0.0)
    assert none.wilcoxon_stat is None and none.wilcoxon_p is None and none.obstacle_wilcoxon_p is None
    documents = {r.condition: json.loads(r.document) for r in M.results_json(done).collect()}
    assert documents["some"]["route_diff_ci95"] == [some.route_diff_rate_lo, some.route_diff_rate_hi] and documents["none"]["wilcoxon_p"] is None


def test_images_with_nan_are_flattened_too(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/manifest.parquet").where("latitude is not null and not isnan(latitude) and image_path <> ''").dropDuplicates(["image_id"]).limit(3).withColumn("i", F.monotonically_increasing_id())
    rows = spark.createDataFrame([r | {"image_id": ["a", "bNaN", "c"][n], "compass_angle": [float("nan"), 1.0, 2.0][n], "latitude": 1.0, "longitude": [1.0, 1.0, float("nan")][n]} for n, r in enumerate(r.asDict() for r in rows.collect())], rows.schema)
    rows.drop("i").write.parquet(f"{tmp_path}/manifest.parquet")
    (got,) = street.image_flatten(spark, str(tmp_path)).collect()
    assert (got.n, got.n_heading, got.n_usable) == (3, 2, 2)


def test_validated_edges_are_written_step_by_step(spark):
    """As one plan over all tables they filled the driver's memory; the steps give the same edges."""
    got = street.validated(spark, DATA)
    assert {f.rstrip("/").split("/")[-1] for f in got.inputFiles()} == {"seg_labels.parquet"}
    want = N.apply_labels(street.fused(spark, DATA), street.labels(spark, DATA))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() > 0 and got.where("n_images_observed > 0").count() > 0


def test_validated_edges_need_little_disk(spark, monkeypatch):
    """Every detection was shuffled by its number, every edge laid in both directions, every image projected again in a filter."""
    seen, laid = [], []
    evidence, snap = N.image_evidence, N.snap
    monkeypatch.setattr(N, "image_evidence", lambda a, d: seen.append(evidence(a, d)) or seen[-1])
    monkeypatch.setattr(N, "snap", lambda i, e, n: laid.append(snap(i, e, n)) or laid[-1])
    got = sorted(map(str, street.validated(spark, DATA).collect()))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "det_id" not in plan and "SortAggregate" not in plan
    plan = laid[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not [row for row in plan.splitlines() if "Filter" in row and "SINH" in row.upper()]
    monkeypatch.undo()
    want = N.apply_labels(street.fused(spark, DATA), street.labels(spark, DATA))
    assert got == sorted(map(str, want.collect()))


def test_twins_and_parallel_edges_are_one_line(spark):
    nodes = spark.createDataFrame([(i, -61.4 + 0.001 * i, -23.3) for i in (1, 2, 3)], "node_id bigint, x double, y double")
    edges = spark.createDataFrame([(2, 1, 3), (2, 1, 1), (3, 2, 0), (2, 3, 5), (2, 3, 4), (3, 3, 0), (None, 1, 0)], "u bigint, v bigint, k int")
    images = spark.createDataFrame([("a", -23.30001, -61.3985), ("b", -23.30001, -61.3975), ("c", -23.3, -61.3968), ("d", None, -61.3975)], "image_id string, latitude double, longitude double")
    got = {r.image_id: (r.u, r.v, r.k) for r in N.snap(images, edges, nodes).collect()}
    assert got == {"a": (2, 1, 1), "b": (2, 3, 4), "c": (2, 3, 4)}
