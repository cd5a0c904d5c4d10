import random

from stepfree.operators.regions import regions_of


def holds(ring, x, y):
    inside = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 <= y < y1 or y1 <= y < y0) and x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) < x:
            inside = not inside
    return inside


def test_regions_equal_brute_force(spark):
    r = random.Random(3)
    rings = {}
    for i in range(40):
        cx, cy, n = r.uniform(0, 10), r.uniform(0, 10), r.randrange(3, 12)
        rings[f"r{i}"] = [(cx + r.uniform(-2, 2), cy + r.uniform(-2, 2)) for _ in range(n)]  # crosses itself at times
    rings["square"] = [(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]
    points = {i: (r.uniform(-1, 11), r.uniform(-1, 11)) for i in range(1500)} | {2000 + i: (2.0, 2.0) for i in range(500)} | {3000: (1.0, 1.0), 3001: (4.0, 4.0)}
    want = {(k, n) for k, (x, y) in points.items() for n, ring in rings.items() if holds(ring, x, y)}
    rows = [(k, float(x), float(y), 0) for k, (x, y) in points.items()] + [(None, 1.0, 1.0, 0), (9000, None, 1.0, 0), (9001, float("nan"), 1.0, 0)]
    p = spark.createDataFrame(rows, "k bigint, x double, y double, strip int")
    q = spark.createDataFrame([(n, [list(c) for c in ring]) for n, ring in rings.items()] + [("thin", [[0.0, 0.0], [1.0, 1.0]]), ("none", None), (None, [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]])], "n string, ring array<array<double>>")
    for size in (100, 50_000):
        got = regions_of(p, "k", "x", "y", q, "n", "ring", leaf_rows=size).collect()
        assert {(g.id, g.region) for g in got} == want and len(got) == len(want)
    assert regions_of(p.limit(0), "k", "x", "y", q, "n", "ring").count() == 0
    assert regions_of(p, "k", "x", "y", q.limit(0), "n", "ring").count() == 0
