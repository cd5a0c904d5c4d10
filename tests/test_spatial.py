import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stepfree.functions.geo import EARTH_RADIUS_M, chord
from stepfree.operators.kdtree import KDTree, Planes, merge_labels
from stepfree.operators.spatial import fit_planes, near_groups, near_links, near_pairs


def sphere_m(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def brute(points, metres):
    ids = sorted(points)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sphere_m(points[a], points[b]) <= metres}


def groups_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=120), st.sampled_from([1.0, 2.5, 9.0]))
def test_tree_equals_brute_force(xy, radius):
    pts = np.array([(x, y, 0.0) for x, y in xy], float).reshape(-1, 3)
    tree = KDTree(pts, bucket=3)
    got = [(min(i, j), max(i, j)) for a, b in tree.pairs(radius) for i, j in zip(a.tolist(), b.tolist())]
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if ((pts[i] - pts[j]) ** 2).sum() <= radius**2}
    assert len(got) == len(set(got)) and set(got) == want
    roots = groups_of(range(len(pts)), want)
    assert tree.components(radius).tolist() == [roots[i] for i in range(len(pts))]


def test_components_of_a_spot_need_no_pairs():
    r = np.random.default_rng(1)
    pts = r.normal(0, 0.01, (200_000, 3))
    pts[-1] = 50
    labels = KDTree(pts).components(1.0)
    assert set(labels[:-1]) == {0} and labels[-1] == len(pts) - 1


def test_merge_labels_keeps_the_least():
    assert merge_labels(np.arange(5), np.array([4, 3]), np.array([3, 1])).tolist() == [0, 1, 2, 1, 1]


def test_planes_give_every_point_one_home_and_reach_its_neighbours():
    r = np.random.default_rng(2)
    pts = r.random((500, 3))
    row, leaf, home = Planes(pts[:200], 16).assign(pts, 0.1)
    assert sorted(row[home]) == list(range(500))
    at = {}
    for i, x in zip(row, leaf):
        at.setdefault(x, set()).add(i)
    where = dict(zip(row[home], leaf[home]))
    for i in range(500):
        for j in np.nonzero(((pts - pts[i]) ** 2).sum(axis=1) <= 0.01)[0]:
            assert j in at[where[i]]


def test_pairs_and_groups_over_date_line_pole_copies_and_bad_rows(spark):
    m = 1 / 111_195.0
    points = {
        "a": (-16.4, 179.99999), "b": (-16.4, -179.99999), "c": (89.99999, 10.0), "d": (89.99999, -170.0), "e": (10.0, 10.0), "f": (10.0 + 6 * m, 10.0),
        "g": (10.0 + 12 * m, 10.0), "h": (10.0, 10.0), "i": (50.0, 50.0),
    }
    rows = [(k, *v, 1) for k, v in points.items()]
    rows += [("a", -16.4, 179.99999, 2), (None, 10.0, 10.0, 1), ("x", None, 10.0, 1), ("y", float("nan"), 10.0, 1), ("z", 0.0, 0.0, 1), ("w", 95.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double, leaf int")  # leaf, lat and lon are names the operator uses itself
    for size in (2, 8192):
        got = {tuple(r) for r in near_pairs(df, "id", "lat", "lon", 8.0, leaf_rows=size).collect()}
        assert got == brute(points, 8.0)
        found = near_groups(df, "id", "lat", "lon", 8.0, leaf_rows=size)
        assert {r.id: r.group_id for r in found.collect()} == groups_of(points, brute(points, 8.0))
    assert near_pairs(df.limit(0), "id", "lat", "lon", 8.0).count() == 0
    assert near_groups(df.limit(0), "id", "lat", "lon", 8.0).count() == 0


def test_a_long_chain_over_many_leaves_is_one_group(spark):
    m = 1 / 111_195.0
    rows = [(i, 20.0 + i * 10 * m, 30.0) for i in range(400)] + [(1000 + i, 21.0 + i * 20 * m, 30.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k bigint, lat double, lon double")
    got = {r.id: r.group_id for r in near_groups(df, "k", "lat", "lon", 15.0, leaf_rows=20).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 + i for i in range(50))


def test_chord_of_a_short_way():
    assert math.isclose(chord(8.0) * EARTH_RADIUS_M, 8.0, rel_tol=1e-9)


def test_links_equal_the_pairs(spark):
    r = np.random.default_rng(8)
    spots = [(10 + a, 20 + b) for a, b in r.normal(0, 0.0001, (60, 2)).tolist()]
    rows = [(f"i{k:04}", *spots[int(r.integers(60))]) for k in range(400)] + [("far", -50.0, 100.0), (None, 10.0, 20.0), ("nan", float("nan"), 1.0), ("i0000", 10.5, 20.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    pairs = near_pairs(df, "k", "a", "b", 8.0).collect()
    for leaf_rows in (40, 100_000):
        got = {x.id: x for x in near_links(df, "k", "a", "b", 8.0, leaf_rows, 300).collect()}
        want = dict.fromkeys(got, 0)
        for p in pairs:
            want[p.id_a] += 1
            want[p.id_b] += 1
        assert len(got) == 401 and {k: x.n_links for k, x in got.items()} == want
        places = {}
        for k, a, b in rows[:401]:
            if k not in ("i0000", None):
                places.setdefault((a, b), set()).add(k)
        assert all({got[k].place_id for k in ks} == {got[min(ks)].place_id} for ks in places.values())
    assert near_links(df.limit(0), "k", "a", "b", 8.0).count() == 0


def test_a_hot_place_is_divided(spark):
    """All pairs of one place come out whole when its leaf is divided into blocks."""
    rows = [(i, 5.0 if i < 900 else 5.0 + (i - 900) * 0.00002, 5.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, a double, b double")
    planes, blocks = fit_planes(df, "a", "b", 50, 2000)
    assert blocks.max() > 4
    got = [(x.id_a, x.id_b) for x in near_pairs(df, "k", "a", "b", 8.0, 50, 2000).collect()]
    want = brute({k: (a, b) for k, a, b in rows}, 8.0)
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_at_one_place_are_held_in_small_parts():
    """80,000 points at one place: 3.2 billion pairs, of which few are held at a time."""
    import tracemalloc

    tree = KDTree(np.zeros((80_000, 3)))
    tracemalloc.start()
    most = 0
    for n, (i, _) in enumerate(tree.pairs(1.0)):
        most = max(most, len(i))
        if n == 20:
            break
    assert most <= 2_000_000 and tracemalloc.get_traced_memory()[1] < 500_000_000
    tracemalloc.stop()


def test_a_crowd_is_counted_without_its_pairs():
    r = np.random.default_rng(3)
    points = np.vstack([r.normal(0, 0.01, (200_000, 3)), [[50.0, 0, 0]]])
    got = KDTree(points).weights_near(1.0, np.full(len(points), 2))
    assert set(got[:-1]) == {400_000} and got[-1] == 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=120), st.sampled_from([1.0, 2.5, 9.0, 40.0]))
def test_weights_and_two_trees_equal_brute_force(xy, radius):
    pts = np.array([(x, y, 0.0) for x, y in xy], float).reshape(-1, 3)
    near = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2) <= radius**2
    weight = np.arange(1, len(pts) + 1)
    assert KDTree(pts, bucket=3).weights_near(radius, weight).tolist() == (near * weight[None, :]).sum(axis=1).tolist()
    half = len(pts) // 3
    depth = KDTree.fitting(len(pts), 3)
    a, b = KDTree(pts[:half], 3, depth), KDTree(pts[half:], 3, depth)
    got = sorted((i, j + half) for x, y in a.pairs_with(b, radius) for i, j in zip(x.tolist(), y.tolist()))
    assert got == [(i, j) for i in range(half) for j in range(half, len(pts)) if near[i, j]]
