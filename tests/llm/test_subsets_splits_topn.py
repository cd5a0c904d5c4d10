import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepfree.llm import diverse, splits, topn


def cells(spark, sizes):
    rows = [(f"{c}-{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, cell string")


@pytest.mark.parametrize("k", [0, 1, 3, 4, 7, 12, 30, 99])
def test_round_robin_takes_rounds(spark, k):
    sizes = {"a": 1, "b": 2, "c": 20, "d": 7}
    got = diverse.round_robin(cells(spark, sizes), count=k).collect()
    assert len(got) == len({r.id for r in got}) == min(k, sum(sizes.values()))
    taken = {c: sum(r.cell == c for r in got) for c in sizes}
    top = max(taken.values(), default=0)
    assert all(n >= min(sizes[c], top - 1) for c, n in taken.items())
    again = diverse.round_robin(cells(spark, sizes).repartition(3), count=k).collect()
    assert {r.id for r in again} == {r.id for r in got}


def test_round_robin_of_nothing_and_bad_arguments(spark):
    assert diverse.round_robin(cells(spark, {"a": 1}).limit(0), share=0.1).count() == 0
    with pytest.raises(ValueError):
        diverse.round_robin(cells(spark, {"a": 1}))


def test_view_cells_of_odd_rows(spark):
    rows = [("a", 10.0, 10.0, 5.0), ("b", 10.0, 10.0, 365.0), ("c", 10.0, 10.0, None), ("d", 10.0, 10.0, float("nan")), ("e", 10.0, 10.0, -1.0), ("e", 10.0, 10.0, None),
            ("f", None, 10.0, 1.0), (None, 10.0, 10.0, 1.0), ("g", 10.0, 10.0, 720.0)]
    df = spark.createDataFrame(rows, "k string, lat double, lon double, heading double").withColumn("cell", F.lit("mine"))
    got = {r.id: r.cell.split("|")[-1] for r in diverse.view_cells(df, "k", "lat", "lon", "heading").collect()}
    assert got == {"a": "0", "b": "0", "c": "-1", "d": "-1", "e": "7", "g": "0"}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 400), st.integers(1, 60), min_size=1, max_size=25), st.integers(2, 24))
def test_largest_differencing_places_every_group_and_balances(classes, bins):
    loads, left = splits.largest_differencing(classes, bins)
    assert set(left) == {(w, i) for w, n in classes.items() for i in range(n % bins)}
    want = np.full(bins, float(sum(w * (n // bins) for w, n in classes.items())))
    for (w, _), b in left.items():
        want[b] += w
    assert np.allclose(loads, want) and loads.max() - loads.min() <= max(classes)


def test_splits_keep_groups_and_shares(spark):
    sizes = [1] * 3000 + [2] * 500 + [7] * 200 + [40] * 30 + [300]
    rows = [(f"{g}.{i}", f"g{g}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, group_id string")
    got = splits.split_by_group(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    for name, share in splits.SHARES.items():
        assert abs(sum(r.split == name for r in got) / len(rows) - share) < 0.01
    again = splits.split_by_group(df.repartition(7)).collect()
    assert {(r.id, r.split) for r in again} == {(r.id, r.split) for r in got}


def test_splits_of_one_giant_few_groups_and_none(spark):
    df = spark.createDataFrame([(str(i), "big") for i in range(90)] + [(f"s{i}", f"s{i}") for i in range(9)] + [("n", None)], "id string, group_id string")
    got = splits.split_by_group(df).collect()
    assert len(got) == 99 and len({r.split for r in got if r.group_id == "big"}) == 1
    assert splits.split_by_group(df.limit(0)).count() == 0


def test_torn_groups(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")], "id string, group_id string")
    recorded = spark.createDataFrame([("a", "train"), ("b", None), ("c", "val"), ("d", "test"), ("e", None)], "id string, recorded string")
    assert sorted(r.id for r in splits.torn_groups(members, recorded).collect()) == ["a", "b", "c"]


def brute_top(rows, n):
    groups = {}
    for g, k, s in {(g, k, s) for g, k, s in rows if g is not None and k is not None and s is not None and s == s}:
        groups.setdefault(g, []).append((-s, k))
    return {(g, i, k) for g, x in groups.items() for i, (_, k) in enumerate(sorted(x)[:n], 1)}


@pytest.mark.parametrize("n", [1, 3, 70])
def test_top_n_equals_brute_force_with_hot_groups_ties_and_copies(spark, n):
    r = np.random.default_rng(n)
    rows = [("hot", int(i), float(int(r.integers(0, 400)))) for i in range(4000)] + [("flat", int(i), 7.0) for i in range(3000)]
    rows += [(f"g{int(r.integers(0, 900))}", 10_000 + int(i), float(r.normal() * 50)) for i in range(2500)]
    rows += [("copies", 99_999, 5.0)] * 2000 + [("copies", 99_998, 4.0), ("copies", 99_997, 3.0)]
    rows += [(None, 1, 1.0), ("g1", None, 1.0), ("g1", 5, None), ("g1", 6, float("nan"))] + rows[:50]
    df = spark.createDataFrame(rows, "g string, k bigint, s double").repartition(6).withColumn("_bin", F.lit("clash"))
    got = topn.top_n(df, ["g"], "k", "s", n).collect()
    assert {(x.g, x.rank_pos, x.k) for x in got} == brute_top(rows, n) and len(got) == len(brute_top(rows, n))


def test_top_n_of_nothing(spark):
    assert topn.top_n(spark.createDataFrame([], "g string, k bigint, s double"), ["g"], "k", "s", 3).count() == 0


def test_score_bin_never_falls(spark):
    values = sorted([0.0, -1e-9, 1e-9, -5.0, 5.0, 1e12, -1e12, 0.5, 3.14, 3.15, -0.5])
    rows = spark.createDataFrame([(v,) for v in values], "s double").select("s", topn.score_bin(F.col("s")).alias("b")).orderBy("s").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
